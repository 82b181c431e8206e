"""The Mersenne twister MT19937 from any place of its sequence, without the draws before it.

A step of the generator is a linear map over GF(2) with a minimal polynomial of degree 19937. J steps are that map's J-th power, which is
x**J modulo the polynomial, put to the state: the sum of those of the next words that the remainder's bits name (Haramoto et al.,
2008). Polynomials are Python integers, a bit a coefficient.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

# Fixed values of MT19937.
WORDS, MIDDLE, DEGREE = 624, 397, 19937
TWIST, UPPER, LOWER = 0x9908B0DF, 0x80000000, 0x7FFFFFFF


def following(state: np.ndarray, n: int) -> np.ndarray:
    """The WORDS words of state and the n words that follow, before tempering."""
    x = np.empty(WORDS + n, np.uint32)
    x[:WORDS] = state
    span = WORDS - MIDDLE  # so many new words need no other new one
    for at in range(0, n, span):
        k = min(span, n - at)
        y = (x[at : at + k] & np.uint32(UPPER)) | (x[at + 1 : at + 1 + k] & np.uint32(LOWER))
        x[WORDS + at : WORDS + at + k] = x[at + MIDDLE : at + MIDDLE + k] ^ (y >> np.uint32(1)) ^ ((y & np.uint32(1)) * np.uint32(TWIST))
    return x


@lru_cache(maxsize=1)
def polynomial() -> int:
    """The minimal polynomial of a step, from 2 * DEGREE bits of its words by the Berlekamp-Massey algorithm."""
    state = np.array(random.Random(1).getstate()[1][:WORDS], np.uint32)
    bits = (following(state, 2 * DEGREE + 2)[WORDS:] & np.uint32(1)).tolist()
    now, old, length, since, seen = 1, 1, 0, 1, 0
    for k, bit in enumerate(bits):
        seen = (seen << 1) | bit
        if not (now & seen).bit_count() & 1:
            since += 1
        elif 2 * length <= k:
            now, old, length, since = now ^ (old << since), now, k + 1 - length, 1
        else:
            now, since = now ^ (old << since), since + 1
    assert length == DEGREE
    return int(format(now, f"0{DEGREE + 1}b")[::-1], 2)


@lru_cache(maxsize=1)
def _multiples() -> list[int]:
    """The multiple of the polynomial whose eight bits from DEGREE up are k, for each k."""
    p = polynomial()
    out = []
    for k in range(256):
        m = 0
        for bit in range(7, -1, -1):
            if ((m >> DEGREE) ^ k) >> bit & 1:
                m ^= p << bit
        out.append(m)
    return out


def reduced(a: int) -> int:
    """a modulo the polynomial."""
    multiples = _multiples()
    for shift in range((max(a.bit_length() - DEGREE, 0) + 7) // 8 * 8 - 8, -1, -8):
        a ^= multiples[a >> (DEGREE + shift) & 255] << shift
    return a


def power(j: int) -> int:
    """x**j modulo the polynomial. The digits of a number in base 2, read in base 4, are its square."""
    out = 1
    for bit in format(j, "b"):
        out = reduced(int(format(out, "b"), 4) << (bit == "1"))
    return out


def jumped(state: np.ndarray, j: int) -> np.ndarray:
    """The state j steps later. One step is made as such: the words after it depend on no bit that a step forgets."""
    if j == 0:
        return state
    g = power(j - 1)
    x = following(state, DEGREE + WORDS)[1:]
    out = np.zeros(WORDS, np.uint32)
    for k, bit in enumerate(reversed(format(g, "b"))):
        if bit == "1":
            out ^= x[k : k + WORDS]
    return out


def generator(seed: int, draws: int) -> random.Random:
    """random.Random(seed) after so many calls of random()."""
    rng = random.Random(seed)
    version, inner, gauss = rng.getstate()
    state = jumped(np.array(inner[:WORDS], np.uint32), 2 * draws)  # a fresh state has no word left; each call takes two
    rng.setstate((version, (*state.tolist(), WORDS), gauss))
    return rng
