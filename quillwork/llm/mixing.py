"""Mixing sources to target weights by Efraimidis-Spirakis sampling: whole epochs first, then a weighted sample of the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, materialize, whole_row
from .prefix import running

#: Source weights by position, repeating; the mix's size over the corpus's; most copies of a document.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Rows of the corpus for each ordered bucket of a source's keys, and the least number of buckets.
BUCKET_ROWS, BUCKETS = 20_000, 1024
#: Rates of the exponentials whose mean distribution cuts the buckets: whatever a source's weights, its keys spread over many buckets.
_RATES = (1.0, 0.5, 0.25, 0.125, 0.05)


def quality_weight(text: Column, size: Column) -> Column:
    """The sampling weight, 0.05 to 1: one less the symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.05), F.when(size > 0, F.lit(1.0) - symbols / size).otherwise(F.lit(1.0)))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, key for each row: key is exponential with the document's weight as its rate (Efraimidis-Spirakis).

    Its randomness is a hash of doc_id and text, so that rows of one id or none differ unless their texts are equal.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text.cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("long") + 1) / F.lit(float(2**52))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), quality_weight(text, size).alias("_w"), u.alias("_u")).select("doc_id", "source", "size", (-F.log("_u") / F.col("_w")).alias("key"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """position, source, source_size, target for each source of rows (source, size).

    Sources are ordered by code point, null last. share of all words is dealt out by weight; a target stops at most times its
    source's size, and what it can't take is dealt out anew by weight among the others, until none is above.
    """
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)  # one row a source
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", "position").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    others = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / others)
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "position", "level"))).over(every)["level"]
    return s.withColumn("final", level).select("position", "source", "source_size", F.when(F.col("final").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (0 to MOST), taken (copies * size) for each row of docs.

    A source's target holds so many complete epochs; the words left over are its budget. Its documents are taken in the order of
    their keys while their prefix sum stays within the budget. The document that would pass it is left out, and further passes fill
    the gap with later documents small enough, until none fits. Keys hang on doc_id and text alone, so reruns agree; equal keys are
    ordered by doc_id and size, so that only equal rows can stand for each other. Null texts have no words and aren't taken beyond
    the epochs; null sources are one source, the last; other columns of docs aren't looked at; an empty table gives an empty result.
    """
    rows = materialize(sized(docs), "mix-sized")
    sources = materialize(targets(rows), "mix-targets")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    now = rows.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source")).select("r.doc_id", "r.source", "r.size", "r.key", "position", "source_size", "target")
    now = now.withColumn("copies", epochs).withColumn("gap", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("epochs", F.col("copies"))
    buckets = max(BUCKETS, rows.count() // BUCKET_ROWS)
    share = sum((1 - F.exp(-rate * F.col("key")) for rate in _RATES), F.lit(0.0)) / len(_RATES)
    now = materialize(now.withColumn("bucket", F.floor(share * buckets).cast("int")), "mix-rows")
    open_ = (F.col("copies") == F.col("epochs")) & (F.col("size") <= F.col("gap")) & (F.col("size") > 0)
    while now.where(open_).limit(1).count():  # the first of them in order is taken, so that the passes end
        run = running(now.where(open_), "position", "bucket", [F.col("key"), F.col("doc_id"), F.col("size")], F.col("size"), "upto")
        run = run.withColumn("copies", F.col("copies") + F.when(F.col("upto") <= F.col("gap"), 1).otherwise(0)).drop("upto")
        then = materialize(now.where(~open_).unionByName(run.select(now.columns)), "mix-pass")
        took = then.groupBy("position").agg(F.sum(F.when(F.col("copies") > F.col("epochs"), F.col("size")).otherwise(0)).alias("took"))
        full = materialize(then.join(took, "position").withColumn("gap", F.col("target") - F.col("epochs") * F.col("source_size") - F.col("took")).drop("took"), "mix-gaps")
        discard(now)
        discard(then)
        now = full
    return now.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def remixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, whole, each as often as mixed() takes it (0 to MOST copies); its columns may have any names.

    A row is told from others by doc_id, source and words; of rows equal in these, each stands for any other. Null and empty texts,
    null sources and ids, repeated rows and empty tables are as in mixed().
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = ("doc_id", "source", "size")
    own = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    own = own.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("h")))
    plan = mixed(docs).select(*keys, "copies")
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("copies")))).where("copies > 0")
    joined = own.join(plan, [own[c].eqNullSafe(plan[c]) for c in (*keys, "nth")]).select("row", "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
