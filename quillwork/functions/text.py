"""Scalar text functions as Column expressions."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Fixed values.
CEDILLA, COMMA = "ţşŢŞ", "țșȚȘ"
DIACRITICS_1 = ("ăâșțĂÂȘȚ", "aastAAST")
DIACRITICS_2 = ("ăâșțĂÂȘȚîÎ", "aastAAStiI")
PUNCT = ".,;:!?-–—()[]{}\"'„”"
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Characters that Python's str.strip() and str.split() take for white space; the class is the same under (?U), by the properties of a character.
_WS_CHARS = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_WS = r"[\s\x1C-\x1F]"


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once: inside a lambda an expression over outer columns would be evaluated for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sanitize(c: Column) -> Column:
    """Letters with cedilla become letters with comma below."""
    return F.translate(c, CEDILLA, COMMA)


def strip_diacritics(c: Column, table: tuple[str, str] = DIACRITICS_1) -> Column:
    return F.translate(c, *table)


def strip_space(c: Column) -> Column:
    return F.btrim(c, F.lit(_WS_CHARS))


def lstrip_space(c: Column) -> Column:
    return F.ltrim(c, F.lit(_WS_CHARS))


def strip_punct(c: Column) -> Column:
    """Without punctuation at both ends, then without white space at both ends."""
    return strip_space(F.btrim(c, F.lit(PUNCT)))


def tokens(c: Column) -> Column:
    """Words between Unicode white space, without empty ones."""
    return F.array_remove(F.split(c, f"(?U){_WS}+"), "")


def has_word(c: Column) -> Column:
    """Whether tokens(c) has any: the first character that is no white space decides."""
    return c.rlike(f"(?Us)(?!{_WS}).")


def span_text(toks: Column, start: Column, end: Column) -> Column:
    """The words start..end-1 joined by a space; bounds are clamped."""
    return F.array_join(span(toks, start, end), " ")


def span(toks: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, F.slice(toks, start + 1, end - start)).otherwise(F.array().cast("array<string>"))


def diacritic_fix(orig: Column, cor: Column, table: tuple[str, str] = DIACRITICS_1) -> Column:
    """Equal but for case and diacritics, and not by case alone."""
    o, c = F.lower(orig), F.lower(cor)
    return (F.translate(o, *table) == F.translate(c, *table)) & (o != c)


def punct_only(orig: Column, cor: Column) -> Column:
    """First pass: equal without punctuation, or one side has nothing else."""
    o, c = strip_punct(orig), strip_punct(cor)
    return (o == c) | (o == "") | (c == "")


def punct_only_nocase(orig: Column, cor: Column) -> Column:
    """Second pass: equal without punctuation and case, though the raw strings differ."""
    return (F.lower(strip_punct(orig)) == F.lower(strip_punct(cor))) & (orig != cor)


def case_fix(orig: Column, cor: Column) -> Column:
    return (F.lower(orig) == F.lower(cor)) & (orig != cor)


def whitespace_fix(orig: Column, cor: Column) -> Column:
    return (F.translate(orig, " ", "") == F.translate(cor, " ", "")) & (orig != cor)


def positional_ratio(orig: Column, cor: Column) -> Column:
    """The share of equal characters at equal places over the longer length; 0 for two empty strings."""
    n = F.least(F.length(orig), F.length(cor))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(orig, i, F.lit(1)) == F.substr(cor, i, F.lit(1)))))
    longer = F.greatest(F.length(orig), F.length(cor))
    return F.when(longer > 0, same / longer).otherwise(F.lit(0.0))


def is_alpha(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\p{L}+$"), F.lit(False))


def is_punct_token(c: Column) -> Column:
    """A (possibly empty) piece of the ASCII punctuation string."""
    return F.contains(F.lit(ASCII_PUNCT), c)


def split_fields(c: Column) -> Column:
    """The fields of an annotation line, empty ones included."""
    return F.split(c, r"\|\|\|", -1)


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def extension(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./]*)$", 1))


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two strings; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
