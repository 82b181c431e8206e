"""Types of edits from annotated tokens, as Column expressions over array<struct<text,lemma,pos,tag,dep>>."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.tables import dealt
from quillwork.functions.text import is_alpha, let, similarity_ratio

# Fixed values.
RARE = ("INTJ", "NUM", "SYM", "X")
INFLECTED = ("ADJ", "ADV", "AUX", "DET", "PRON", "PROPN", "NOUN", "VERB")
DEPENDENCIES = (("case", "ADP"), ("mark", "SCONJ"), ("punct", "PUNCT"))
PRONOUN_DEPS = ("nsubj", "nsubj:pass", "obj", "iobj")
DETERMINER_DEPS = ("nmod", "nmod:poss", "det")


def _get(toks: Column, field: str) -> Column:
    return F.transform(toks, lambda t: t[field])


def _mapped(dep: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for d, cat in DEPENDENCIES:
        out = out.when(dep == d, cat)
    return out


def _joined(toks: Column, lower: bool = True) -> Column:
    text = F.array_join(_get(toks, "text"), "")
    return F.lower(text) if lower else text


def one_sided(toks: Column) -> Column:
    """The category of an insertion's or deletion's tokens."""
    pos, dep = F.array_distinct(_get(toks, "pos")), F.array_distinct(_get(toks, "dep"))
    p, d = F.try_element_at(pos, F.lit(1)), F.try_element_at(dep, F.lit(1))
    return F.when((F.size(pos) == 1) & ~p.isin(*RARE), p).when((F.size(dep) == 1) & _mapped(d).isNotNull(), _mapped(d)).when(F.array_sort(pos) == F.array(F.lit("PART"), F.lit("VERB")), "VERB").otherwise("OTHER")


def _unknown(o: Column, c: Column, in_list: Column) -> Column:
    """Whether one word that no list knows is replaced by one of another lemma."""
    a, b = F.try_element_at(o, F.lit(1)), F.try_element_at(c, F.lit(1))
    return (F.size(o) == 1) & (F.size(c) == 1) & is_alpha(a["text"]) & ~in_list & (a["lemma"] != b["lemma"])


def _alike(o: Column, c: Column, in_list: Column) -> Column:
    unknown = _unknown(o, c, in_list)
    return similarity_ratio(F.when(unknown, F.try_element_at(o, F.lit(1))["text"]), F.when(unknown, F.try_element_at(c, F.lit(1))["text"])) > 0.5


def two_sided(o: Column, c: Column, in_list: Column, stem: Callable | None = None, alike: Column | None = None) -> Column:
    """The category of a replacement, the first rule that holds. in_list: whether the original word or its lower case is known; alike:
    whether an unknown word is like its replacement, if that is a column already."""
    one = (F.size(o) == 1) & (F.size(c) == 1)
    a, b = F.try_element_at(o, F.lit(1)), F.try_element_at(c, F.lit(1))
    pos = F.array_distinct(F.concat(_get(o, "pos"), _get(c, "pos")))
    dep = F.array_distinct(F.concat(_get(o, "dep"), _get(c, "dep")))
    low = lambda toks: F.array_sort(F.transform(toks, lambda t: F.lower(t["text"])))
    unknown = _unknown(o, c, in_list)
    alike = _alike(o, c, in_list) if alike is None else alike
    inflected = a["pos"].isin(*INFLECTED) & b["pos"].isin(*INFLECTED)
    stems = (stem(a) == stem(b)) if stem else F.lit(False)
    p, d = F.try_element_at(pos, F.lit(1)), F.try_element_at(dep, F.lit(1))
    return (
        F.when(_joined(o) == _joined(c), "ORTH").when(low(o) == low(c), "WO")
        .when(unknown & alike, "SPELL").when(unknown & (a["pos"] == b["pos"]) & ~a["pos"].isin(*RARE), a["pos"]).when(unknown, "OTHER")
        .when(one & (a["lemma"] == b["lemma"]) & inflected, F.when(a["pos"] == b["pos"], F.concat(a["pos"], F.lit(":FORM"))).when(b["pos"] == "VERB", "VERB:FORM").otherwise("MORPH"))
        .when(one & stems & inflected, "MORPH").when(one & (a["pos"] == b["pos"]) & ~a["pos"].isin(*RARE), a["pos"])
        .when(one & (a["dep"] == b["dep"]) & _mapped(a["dep"]).isNotNull(), _mapped(a["dep"])).when(one & ((pos == F.array(F.lit("ADP"))) | (dep == F.array(F.lit("case")))), "ADP")
        .when(one & (F.array_sort(pos) == F.array(F.lit("DET"), F.lit("PRON"))) & b["dep"].isin(*PRONOUN_DEPS), "PRON")
        .when(one & (F.array_sort(pos) == F.array(F.lit("DET"), F.lit("PRON"))) & b["dep"].isin(*DETERMINER_DEPS), "DET")
        .when(one & (F.array_sort(pos) != F.array(F.lit("DET"), F.lit("PRON"))), "OTHER")
        .when((F.size(pos) == 1) & ~p.isin(*RARE), p).when((F.size(dep) == 1) & _mapped(d).isNotNull(), _mapped(d))
        .when(F.array_sort(pos) == F.array(F.lit("PART"), F.lit("VERB")), F.when(F.try_element_at(o, F.lit(-1))["lemma"] == F.try_element_at(c, F.lit(-1))["lemma"], "VERB:FORM").otherwise("VERB"))
        .otherwise("OTHER")
    )


def trimmed(o: Column, c: Column) -> Column:
    """How many last tokens both sides share (case aside) before the type is judged: trimming goes on while the texts differ and
    a side has more than one token left."""
    last = F.least(F.size(o), F.size(c))

    def stops(k: Column) -> Column:
        i, j = F.size(o) - k, F.size(c) - k
        left, right = F.slice(o, 1, i), F.slice(c, 1, j)
        same = _get(left, "text") == _get(right, "text")
        tail = F.lower(F.try_element_at(o, F.greatest(i, F.lit(1)))["text"]) == F.lower(F.try_element_at(c, F.greatest(j, F.lit(1)))["text"])
        return (i == 0) | (j == 0) | same | ~(tail & ((i > 1) | (j > 1)))

    return F.when(last > 0, F.array_min(F.filter(F.sequence(F.lit(0), last), stops))).otherwise(F.lit(0))


def with_type(df: DataFrame, out: str, orig: Column, cor: Column, o_start: Column, o_end: Column, c_start: Column, c_end: Column, in_list: Column, stem: Callable | None = None) -> DataFrame:
    """df with out: M:, U:, R: with a category, or UNK, for the spans of two annotated sentences. The span itself is not trimmed.

    The trimmed sides are a column, and so is the likeness of their words, which is the one Python step: the rules ask for them many times.
    """
    empty = F.array().cast("array<struct<text:string,lemma:string,pos:string,tag:string,dep:string>>")
    part = lambda toks, a, b: F.when(b > a, F.slice(toks, a + 1, b - a)).otherwise(empty)
    cut = lambda s, k: F.struct(*[F.slice(s[x], 1, F.size(s[x]) - k).alias(x) for x in ("o", "c")])
    sides = let(F.struct(part(orig, o_start, o_end).alias("o"), part(cor, c_start, c_end).alias("c")), lambda s: let(trimmed(s["o"], s["c"]), lambda k: cut(s, k)))
    df = df.withColumn("_in", in_list).withColumn("_sides", sides)
    o, c = F.col("_sides.o"), F.col("_sides.c")
    df = df.withColumn("_alike", _alike(o, c, F.col("_in")))
    kind = (
        F.when((F.size(o) == 0) & (F.size(c) == 0), "UNK").when(F.size(o) == 0, F.concat(F.lit("M:"), one_sided(c))).when(F.size(c) == 0, F.concat(F.lit("U:"), one_sided(o)))
        .when(_get(o, "text") == _get(c, "text"), "UNK").otherwise(F.concat(F.lit("R:"), two_sided(o, c, F.col("_in"), stem, F.col("_alike"))))
    )
    return df.withColumn(out, kind).drop("_in", "_sides", "_alike")


def typed_edits(pairs: DataFrame, word_list: DataFrame | None = None, merge: str = "rules", stem: Callable | None = None) -> DataFrame:
    """sent_id, o_start, o_end, err_type, correction, c_start, c_end for pairs (sent_id, orig, cor: annotated token arrays).

    word_list: a table (word); an original word is known if it or its lower case is in it. Equal sentences have no rows.
    """
    from .align import align

    e = dealt(pairs).select("sent_id", "orig", "cor", F.posexplode_outer(align(F.col("orig"), F.col("cor"), merge)).alias("n", "e"))  # not outer, a filter would align again
    part = lambda toks, a, b: F.when(b > a, F.slice(toks, a + 1, b - a)).otherwise(F.array().cast("array<struct<text:string,lemma:string,pos:string,tag:string,dep:string>>"))
    own = part(F.col("orig"), F.col("e.o_start"), F.col("e.o_end")).alias("_o"), part(F.col("cor"), F.col("e.c_start"), F.col("e.c_end")).alias("_c")  # an edit goes on with its own words, not with two sentences
    e = e.where("e is not null").select("sent_id", "e.*", *own)
    e = e.withColumn("_w", F.try_element_at("_o", F.lit(1))["text"])
    if word_list is not None:
        known = word_list.select(F.col("word").alias("_w"), F.lit(True).alias("_k")).distinct()
        e = e.join(known, "_w", "left")
        low = known.select(F.col("_w").alias("_l"), F.col("_k").alias("_kl"))
        e = e.withColumn("_l", F.lower("_w")).join(low, "_l", "left")
        in_list = F.coalesce("_k", "_kl", F.lit(False))
    else:
        in_list = F.lit(False)
    e = with_type(e, "err_type", F.col("_o"), F.col("_c"), F.lit(0), F.size("_o"), F.lit(0), F.size("_c"), in_list, stem)
    words = _get(F.col("_c"), "text")
    return e.select("sent_id", "o_start", "o_end", "err_type", F.array_join(words, " ").alias("correction"), "c_start", "c_end")
