"""The corpus pipeline: quality rules, near-duplicates, decontamination, mixing and sharding, one stage after another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillwork.llm import decontam, mixing, near, quality, sharding
from quillwork.llm.common import materialize, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the line CRF learns from the labelled rows among docs. Null and empty texts go."""
    return quality.kept(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id (null being the largest), of each group of near-duplicates.

    Groups are those of SimHash (op3) joined with those of five-word shingles of similarity 0.8 or more, which the fingerprints alone
    don't reach (README). Null and empty texts are one group, repeated rows are copies.
    """
    return near.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts, null ids and repeated rows stay."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them: not, once or twice (rows repeat). A null source is one source."""
    return mixing.remixed(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix with each row's size, text_crc32, law, shard and slot, which take the place of columns of these names."""
    return sharding.with_shards(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharded),
]

#: Trained labelling, components and label propagation are not SQL; tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table; each stage is written and read again as the next one's docs."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
