"""The queries of the corpus operators: each applies its operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, chosen, codes, decontam, html_extract, licenses, mixing, quality, repair, sharding, simhash, substring, toxicity
from .common import read


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.factored(read(spark, sf_dir, "documents")).drop("factors", "spans")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.assess(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(read(spark, sf_dir, "documents"))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).drop("source", "copies")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.scored(docs, *toxicity.train(docs, read(spark, sf_dir, "labels")))


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(read(spark, sf_dir, "conversations"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read(spark, sf_dir, "pages"), html_extract.train())


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen.near_duplicates(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(read(spark, sf_dir, "conversations"), damage=True)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.coded(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_tool_call_linking": op1_tool_call_linking,
    "op2_license_scan": op2_license_scan,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_sharding": op4_sharding,
    "op5_toxicity": op5_toxicity,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_html_extraction": op10_html_extraction,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_vector_codes": op13_vector_codes,
}
