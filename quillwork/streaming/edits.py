"""The row-local steps over a stream of annotated sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators.reclass import pass_one_blocks
from quillwork.operators.tags import edits_to_tags, reconstruct_target
from quillwork.sources.io import parse_m2


def tag_stream(spark: SparkSession, folder: str, line_sep: str = "\n\n", max_files: int = 64) -> DataFrame:
    """A streaming DataFrame tokens, tags, source, target from annotation files as they arrive in a folder."""
    raw = spark.readStream.option("lineSep", line_sep).option("maxFilesPerTrigger", max_files).text(folder)
    return tag_blocks(raw.select(parse_m2(F.col("value")).alias("b")).where("b is not null").select("b.*"))


def tag_blocks(blocks: DataFrame) -> DataFrame:
    """Pass-one reclassification, tags and target of blocks; the same plan for a batch and for a stream."""
    b = pass_one_blocks(blocks)
    return b.select("tokens", edits_to_tags(F.col("tokens"), F.col("edits")).alias("tags"), "source", reconstruct_target(F.col("tokens"), F.col("edits")).alias("target"))


def error_counts(events: DataFrame, watermark: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """n by window and error type over a stream (ts, err_type); rows later than the watermark are left out."""
    return events.withWatermark("ts", watermark).groupBy(F.window("ts", window), "err_type").agg(F.count("*").alias("n")).select("window.start", "window.end", "err_type", "n")
