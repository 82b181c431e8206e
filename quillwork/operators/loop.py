"""Correction in rounds: predict tags, apply them, until nothing changes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.tables import shared_dir
from quillwork.functions.text import sanitize, tokens

from .tags import apply_tags, mask

#: predictor: DataFrame(sent_id, tokens) -> DataFrame(sent_id, tags array<string>, confs array<double>); words beyond the tags are kept.
Predictor = Callable[[DataFrame], DataFrame]
#: Names of datasets broadcast at most.
DATASETS = 100_000


def masked(tags, confs, threshold: float):
    return F.zip_with(tags, confs, lambda t, c: mask(t, c, threshold))


def correct_once(sentences: DataFrame, predictor: Predictor, threshold: float = 0.8) -> DataFrame:
    """sent_id, text after one round."""
    toks = sentences.select("sent_id", "text", tokens(F.col("text")).alias("tokens"))
    tagged = toks.join(predictor(toks.select("sent_id", "tokens")), "sent_id", "left")
    empty = F.array().cast("array<string>")
    return tagged.select("sent_id", apply_tags(F.col("tokens"), F.coalesce(masked(F.col("tags"), F.col("confs"), threshold), empty)).alias("text"))


def correct(sentences: DataFrame, predictor: Predictor, threshold: float = 0.8, rounds: int = 3) -> DataFrame:
    """sent_id, iteration (1..rounds), text: every round's result.

    Sentences (sent_id, text) are sanitised and blank ones dropped. Rounds are a driver loop; each result is written to the checkpoint
    folder, so the plan stays short and a lost executor costs one round. When no sentence changes the remaining rounds repeat it.
    """
    spark = sentences.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillwork-"))
    now = sentences.select("sent_id", sanitize(F.trim("text")).alias("text")).where("text <> ''")
    out, steady = None, False
    for i in range(1, rounds + 1):
        if not steady:
            then = correct_once(now, predictor, threshold).checkpoint()
            steady = not then.join(now.withColumnRenamed("text", "was"), "sent_id").where("text <> was").limit(1).count()
            now = then
        step = now.withColumn("iteration", F.lit(i))
        out = step if out is None else out.unionByName(step)
    return out.select("sent_id", "iteration", "text")


def correct_datasets(sentences: DataFrame, predictor: Predictor, threshold: float = 0.8, rounds: int = 3, path: str | None = None) -> DataFrame:
    """dataset, sent_id, iteration (1..rounds), text: every round's result, the rounds of each dataset being its own.

    sentences: dataset, sent_id, text; a sent_id may stand in several datasets. A dataset none of whose sentences changed in a round has
    settled: later rounds repeat its result and only the others are predicted, all in one job a round. What is kept by dataset is one
    number, its last round of work. Each round is written once, by dataset and iteration, under path or the shared folder.
    """
    spark = sentences.sparkSession
    out = path or f"{shared_dir(spark)}/quillwork/datasets-{uuid.uuid4().hex}"
    text = sanitize(F.trim("text")).alias("text")
    written = sentences.select("dataset", "sent_id", text, F.lit(0).alias("iteration")).where("text <> ''")
    schema = written.select("sent_id", "text", "dataset", "iteration").schema
    written.write.partitionBy("dataset", "iteration").parquet(out)

    def step(i: int) -> DataFrame:
        return spark.read.schema(schema).parquet(out).where(F.col("iteration") == i).drop("iteration")

    settled = None
    for i in range(1, rounds + 1):
        now = step(i - 1)
        if settled is not None:
            now = now.join(F.broadcast(settled) if settled.count() <= DATASETS else settled, "dataset", "left_anti")
        if not now.limit(1).count():
            break
        own = now.select(F.struct("dataset", "sent_id").alias("sent_id"), "text")
        correct_once(own, predictor, threshold).select("sent_id.sent_id", "text", "sent_id.dataset", F.lit(i).alias("iteration")).write.mode("append").partitionBy("dataset", "iteration").parquet(out)
        moved = step(i).join(now.withColumnRenamed("text", "was"), ["dataset", "sent_id"]).groupBy("dataset").agg(F.max(F.col("text") != F.col("was")).alias("moved"))
        quiet = moved.where("not moved").select("dataset")
        settled = spark.createDataFrame(quiet.collect() + (settled.collect() if settled is not None else []), quiet.schema)  # a name a dataset
    done = spark.read.schema(schema).parquet(out).where("iteration > 0")
    last = done.groupBy("dataset").agg(F.max("iteration").alias("last"))
    again = done.join(last, "dataset").withColumn("more", F.when(F.col("iteration") == F.col("last"), F.sequence(F.col("iteration"), F.lit(rounds))).otherwise(F.array("iteration")))
    return again.select("dataset", "sent_id", F.explode("more").alias("iteration"), "text")


def dictionary_predictor(fixes: DataFrame) -> Predictor:
    """A stand-in for a trained tagger: fixes (word, tag, conf) by exact word; other words are kept with certainty."""

    def predict(toks: DataFrame) -> DataFrame:
        each = toks.select("sent_id", F.posexplode("tokens").alias("pos", "word"))
        tagged = each.join(fixes, "word", "left").select("sent_id", "pos", F.coalesce("tag", F.lit("$KEEP")).alias("tag"), F.coalesce("conf", F.lit(1.0)).alias("conf"))
        rows = tagged.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag", "conf"))).alias("a"))
        return rows.select("sent_id", F.transform("a", lambda e: e["tag"]).alias("tags"), F.transform("a", lambda e: e["conf"]).alias("confs"))

    return predict


def first_piece_labels(encoded: DataFrame) -> DataFrame:
    """encoded (sent_id, word_ids array<int>, tags array<string>) with labels: a word's first piece gets its tag ($KEEP beyond the tags),
    other and special pieces (word id null) get null. Tokenisers are hooks that provide word_ids."""
    w = F.col("word_ids")
    label = F.transform(w, lambda x, i: F.when(x.isNull() | ((i > 0) & x.eqNullSafe(F.try_element_at(w, i))), F.lit(None)).otherwise(F.coalesce(F.try_element_at(F.col("tags"), x + 1), F.lit("$KEEP"))))
    return encoded.withColumn("labels", label)


def weighted_loss(rows: DataFrame, weights: list[float], batch: str = "batch") -> DataFrame:
    """batch, n, loss for rows (batch, logits array<double>, label int): the cross-entropy weighted by class, over the rows with a label
    (ignored ones are null). A batch without labels has no row."""
    x = F.col("logits")
    top = F.array_max(x)
    log_sum = top + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, v: a + v))
    w = F.get(F.array(*[F.lit(float(v)) for v in weights]), F.col("label"))
    each = rows.where("label is not null").select(F.col(batch), w.alias("w"), (log_sum - F.get(x, F.col("label"))).alias("nll"))
    return each.groupBy(batch).agg(F.count("w").alias("n"), (F.sum(F.col("w") * F.col("nll")) / F.sum("w")).alias("loss"))


def epoch_losses(batches: DataFrame) -> DataFrame:
    """epoch, mean_loss: the mean over an epoch's batches (epoch, loss)."""
    return batches.groupBy("epoch").agg(F.avg("loss").alias("mean_loss"))
