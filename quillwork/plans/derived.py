"""Inputs of the queries that the tables don't hold: edits, taggings and pairs made from them by arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions import text as X
from quillwork.functions.tables import dealt, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_tokens(spark: SparkSession, sf_dir: str, some: bool = False) -> DataFrame:
    """doc_id, source, text, toks; some: only documents with a word, which is known before they are split."""
    d = table(spark, sf_dir, "documents")
    return (d.where(X.has_word(F.col("text"))) if some else d).select("doc_id", "source", "text", X.tokens(F.col("text")).alias("toks"))


TOKENS_SQL = r"t AS (SELECT doc_id, source, text, list_filter(string_split_regex(text, '[\t-\r ]+'), lambda x: x <> '') AS toks FROM documents)"


def derived_edits(spark: SparkSession, sf_dir: str, some: bool = False, orig: bool = True) -> DataFrame:
    """doc_id, source, toks, edits: an edit at each place p of a document with (doc_id + p) mod 17 = 0, of one of four kinds; orig: with
    the words that it replaces."""
    t = doc_tokens(spark, sf_dir, some)

    def every(toks):
        n = F.size(toks)
        first = F.pmod(17 - F.col("doc_id") % 17, F.lit(17)).cast("int")
        places = F.when(first < n, F.sequence(first, F.greatest(n - 1, first), F.lit(17))).otherwise(F.array().cast("array<int>"))

        def one(p):
            kind, way = (F.col("doc_id") + 3 * p) % 4, (F.col("doc_id") + p) % 5
            tok = F.element_at(toks, p + 1)
            high = F.upper(F.translate(tok, "ß", "s"))
            following = F.element_at(toks, F.least(p + 2, n))
            changed = F.when(way == 0, X.strip_diacritics(tok)).when(way == 1, F.concat(tok, F.lit(","))).when(way == 2, high).when(way == 3, F.concat(tok, F.lit("s"))).otherwise(following)
            end = F.when(kind == 2, p).when(kind == 3, F.least(p + 2, n)).otherwise(p + 1)
            err = F.when(kind == 0, "R:OTHER").when(kind == 1, "U:OTHER").when(kind == 2, "M:OTHER").otherwise("R:SPELL")
            cor = F.when(kind == 0, changed).when(kind == 1, "").when(kind == 2, tok).otherwise(high)
            return F.struct(p.cast("int").alias("start"), end.cast("int").alias("end"), err.alias("err_type"), cor.alias("correction"), *([X.span_text(toks, p, end).alias("orig")] if orig else []))

        return F.transform(places, one)

    return t.select("doc_id", "source", "toks", X.let(F.col("toks"), every).alias("edits"))


#: doc_id, toks, start, "end", err_type, correction; use after TOKENS_SQL.
EDITS_SQL = """p AS (SELECT doc_id, toks, len(toks)::INT AS n, unnest(generate_series(0, len(toks) - 1))::INT AS p FROM t),
e AS (SELECT doc_id, toks, n, p AS "start",
  CASE (doc_id + 3 * p) % 4 WHEN 2 THEN p WHEN 3 THEN least(p + 2, n) ELSE p + 1 END AS "end",
  CASE (doc_id + 3 * p) % 4 WHEN 0 THEN 'R:OTHER' WHEN 1 THEN 'U:OTHER' WHEN 2 THEN 'M:OTHER' ELSE 'R:SPELL' END AS err_type,
  CASE (doc_id + 3 * p) % 4
    WHEN 0 THEN CASE (doc_id + p) % 5 WHEN 0 THEN translate(toks[p + 1], 'ăâșțĂÂȘȚ', 'aastAAST') WHEN 1 THEN toks[p + 1] || ',' WHEN 2 THEN upper(translate(toks[p + 1], 'ß', 's')) WHEN 3 THEN toks[p + 1] || 's' ELSE toks[least(p + 2, n)] END
    WHEN 1 THEN '' WHEN 2 THEN toks[p + 1] ELSE upper(translate(toks[p + 1], 'ß', 's')) END AS correction
  FROM p WHERE (doc_id + p) % 17 = 0)"""


def flat(edits: DataFrame) -> DataFrame:
    """doc_id, orig, start, end, err_type, correction. The edits are dealt by an outer explode, which makes no filter on their number: such a
    filter would make all edits a second time."""
    return edits.select("doc_id", F.explode_outer("edits").alias("e")).where("e is not null").select("doc_id", "e.orig", "e.start", "e.end", "e.err_type", "e.correction")


def hypotheses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """hyp and ref edits (sent_id, coder, start, end, err_type, correction): the derived edits as reference; of them, those with
    (doc_id + start) mod 3 > 0 as hypothesis, every fifth with another correction. They are written, as scoring reads them several times."""
    ref = written(flat(derived_edits(spark, sf_dir)).select(F.col("doc_id").alias("sent_id"), F.lit(0).alias("coder"), "start", "end", "err_type", "correction"), "edits")
    hyp = ref.where((F.col("sent_id") + F.col("start")) % 3 > 0).withColumn("correction", F.when((F.col("sent_id") + F.col("start")) % 5 == 0, F.concat("correction", F.lit("x"))).otherwise(F.col("correction")))
    return hyp, ref


def hypotheses_by_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, hyp, ref: what hypotheses() has, a row a document with both sides as arrays."""
    e = derived_edits(spark, sf_dir, orig=False).select(F.col("doc_id").alias("sent_id"), "edits")
    place = lambda x: F.col("sent_id") + x["start"]
    changed = lambda x: x.withField("correction", F.when(place(x) % 5 == 0, F.concat(x["correction"], F.lit("x"))).otherwise(x["correction"]))
    return e.select("sent_id", F.transform(F.filter("edits", lambda x: place(x) % 3 > 0), changed).alias("hyp"), F.col("edits").alias("ref"))


HYP_SQL = """h AS (SELECT doc_id, "start", "end", err_type, CASE WHEN (doc_id + "start") % 5 = 0 THEN correction || 'x' ELSE correction END AS correction FROM e WHERE (doc_id + "start") % 3 > 0)"""


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, k, s: the sentences of all conversations. Turns are dealt to all cores first: the table is small, so that its bytes
    may be one task's, while what is made of its words costs far more than moving them."""
    c = dealt(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))
    return c.select("conv_id", "turn", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("k", "s"))


def sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, orig, cor (array<TOKEN>): the sentences of all conversations against themselves with words dropped, doubled, exchanged,
    without diacritics, or capitalised, by arithmetic on place."""
    from quillwork.operators.align import TOKEN

    c = _sentences(spark, sf_dir)
    c = c.select((F.col("conv_id") * 1000000 + F.col("turn") * 1000 + F.col("k")).alias("sent_id"), X.tokens(F.col("s")).alias("toks")).where(F.size("toks") > 0)

    def worse(t, i):
        k = F.col("sent_id") + i
        return F.when(k % 17 == 0, F.array().cast("array<string>")).when(k % 13 == 0, F.array(t, t)).when(k % 7 == 0, F.array(F.upper(t))).when(k % 5 == 0, F.array(X.strip_diacritics(t, ("éèêàçñáíóúüöäß", "eeeacnaiouuoas")))).when(k % 19 == 0, F.array(F.reverse(t))).otherwise(F.array(t))

    def annotated(toks):
        def one(w):
            low = F.lower(w)
            pos = F.when(low.rlike(r"^[\p{Punct}]+$"), "PUNCT").when(F.length(low) <= 3, "DET").when(low.rlike("(ing|ion|tion|ment|heit|keit|ción)[.,]?$"), "NOUN").when(low.rlike("(ed|er|ar|en)[.,]?$"), "VERB").when(F.length(low) % 2 == 0, "ADJ").otherwise("X")
            dep = F.when(pos == "PUNCT", "punct").when(pos == "DET", "det").when(pos == "NOUN", "obj").otherwise("dep")
            return F.struct(w.alias("text"), F.regexp_replace(low, "[.,!?]+$", "").alias("lemma"), pos.alias("pos"), F.lit("").alias("tag"), dep.alias("dep"))

        return F.transform(toks, one).cast(f"array<{TOKEN}>")

    return c.select("sent_id", annotated(F.flatten(F.transform("toks", worse))).alias("orig"), annotated(F.col("toks")).alias("cor"))


#: Treebank tags of tagged_sentences() and their universal parts of speech.
TAG_MAP = ((".", "PUNCT"), ("DT", "DET"), ("NN", "NOUN"), ("VB", "VERB"), ("JJ", "ADJ"), ("FW", "X"))


def tagged_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sent_id, words, tags of the sentences of all conversations: tags by the ending and length of a word, and a verb after a
    determiner is a noun, so that words alone don't tell all."""
    c = _sentences(spark, sf_dir)
    c = c.select((F.col("conv_id") * 1000000 + F.col("turn") * 1000 + F.col("k")).alias("sent_id"), X.tokens(F.col("s")).alias("words")).where(F.size("words") > 0)

    def tag(w):
        low = F.lower(w)
        return F.when(low.rlike(r"^[\p{Punct}]+$"), ".").when(F.length(low) <= 3, "DT").when(low.rlike("(ing|ion|ment|heit|keit|ción)[.,]?$"), "NN").when(low.rlike("(ed|er|ar|en)[.,]?$"), "VB").when(low.rlike("[aeiouéèäöü][.,]?$"), "JJ").otherwise("FW")

    first = c.withColumn("t", F.transform("words", tag))
    last = F.transform("t", lambda t, i: F.when((t == "VB") & (F.coalesce(F.get("t", i - 1), F.lit("")) == "DT"), "NN").otherwise(t))
    return first.select("sent_id", "words", last.alias("tags"))
