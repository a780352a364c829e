"""The queries of this subpackage: one for each of its operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import elias_fano, identifiers, ivf_pq, jaccard_join, line_templates, mixing, packing, quality, suffix_repeats, va_file
from .common import documents

#: The searches' stated query set.
EVERY = 50


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_lines(documents(spark, sf_dir), counted="n_dropped").select("doc_id", "text", "n_chars", "n_dropped")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op2_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by EVERY; all rows are searched."""
    return ivf_pq.search(embeddings(spark, sf_dir), every=EVERY)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repeats.repeats(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with its probability that each is clean."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep(documents(spark, sf_dir), labels, score="p_clean").select("doc_id", "lang", "source", "n_chars", "p_clean")


def op6_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are all rows whose id is divisible by EVERY; all rows are searched."""
    return va_file.search(embeddings(spark, sf_dir), every=EVERY)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(documents(spark, sf_dir))


def op8_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identifiers.find(documents(spark, sf_dir))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elias_fano.token_shards(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_ivf_pq": op2_ivf_pq,
    "op3_packing": op3_packing,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_va_file": op6_va_file,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_identifiers": op8_identifiers,
    "op9_token_ids": op9_token_ids,
    "op10_mixing": op10_mixing,
}

SQL: dict[str, str] = {
    "op1_line_dedup": line_templates.sql(),
    "op4_suffix_repeats": suffix_repeats.sql(),
    "op6_va_file": va_file.sql(every=EVERY),
    "op7_jaccard_join": jaccard_join.sql(),
}
