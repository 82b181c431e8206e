"""A linear-chain conditional random field with two states, trained and decoded in NumPy over many sequences at once."""

from __future__ import annotations

import numpy as np


class ChainCRF:
    """States 0 and 1; the score of a sequence y over feature rows x is sum(x_t . w[y_t]) + sum(trans[y_t-1, y_t]).

    w has a row per state; only its difference matters, so w[0] stays 0. Features are standardised by mean and scale.
    """

    def __init__(self, n_features: int):
        self.w, self.trans = np.zeros(n_features + 1), np.zeros((2, 2))
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """The score of state 1 over state 0 for each row."""
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def fit(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, chunk: int = 32, steps: int = 200, ridge: float = 1e-3) -> ChainCRF:
        """x: rows of all sequences; y: their states; first: where each sequence begins, and the total at the end.

        Maximises the conditional likelihood by Adam. Longer sequences are trained in pieces of `chunk` rows, all of them.
        """
        if not len(x):
            return self
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        place = np.arange(len(x)) - np.repeat(first[:-1], np.diff(first))
        begin = np.flatnonzero(place % chunk == 0)
        row = np.cumsum(place % chunk == 0) - 1
        shape = (len(begin), chunk)
        z, gold, real = np.zeros((*shape, x.shape[1] + 1)), np.zeros(shape, int), np.zeros(shape, bool)
        z[row, place % chunk, :-1] = (x - self.mean) / self.scale
        z[row, place % chunk, -1] = 1
        gold[row, place % chunk], real[row, place % chunk] = y, True
        both = real[:, 1:] & real[:, :-1]
        seen = np.zeros((2, 2))
        np.add.at(seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        theta = np.concatenate([self.w, self.trans.ravel()])
        m, v, n = np.zeros_like(theta), np.zeros_like(theta), real.sum()
        for step in range(1, steps + 1):
            w, trans = theta[:-4], theta[-4:].reshape(2, 2)
            e = np.zeros((*shape, 2))
            e[..., 1] = z @ w
            alpha, beta = np.zeros((*shape, 2)), np.zeros((*shape, 2))
            alpha[:, 0] = e[:, 0]
            for t in range(1, chunk):
                s = alpha[:, t - 1, :, None] + trans
                alpha[:, t] = np.where(real[:, t, None], np.logaddexp(s[:, 0], s[:, 1]) + e[:, t], alpha[:, t - 1])
            norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
            for t in range(chunk - 2, -1, -1):
                s = trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
                beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp(s[..., 0], s[..., 1]), 0)
            p = np.where(real, np.exp(alpha[..., 1] + beta[..., 1] - norm[:, None]), 0)
            pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None])
            grad = np.concatenate([np.einsum("sc,scf->f", np.where(real, gold, 0) - p, z), (seen - (pair * both[..., None, None]).sum((0, 1))).ravel()]) / n - ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w, self.trans = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def decode(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The Viterbi states of all rows; sequences as in fit(). Ties go to state 1."""
        out = np.zeros(len(x), np.int8)
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        e, starts, size = self.emissions(x), first[:-1][order], size[order]
        at = starts[size > 0]
        score = np.stack([np.zeros(len(at)), e[at]], 1)
        back = []
        for t in range(1, size[0] if len(size) else 0):
            n = np.searchsorted(-size, -t)  # sequences with a row t, the longest first
            s = score[:n, :, None] + self.trans
            best = s[:, 1] >= s[:, 0]
            back.append(best)
            score[:n] = np.where(best, s[:, 1], s[:, 0])
            score[:n, 1] += e[starts[:n] + t]
        state = (score[:, 1] >= score[:, 0]).astype(np.int8)
        for t in range(len(back), 0, -1):
            n = len(back[t - 1])
            out[starts[:n] + t] = state[:n]
            state[:n] = back[t - 1][np.arange(n), state[:n]]
        out[at] = state
        return out
