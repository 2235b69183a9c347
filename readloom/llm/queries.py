"""The registered queries of the corpus operators: one opN_<name> each, with
production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontaminate import contaminated
from .line_quality import LINE_QUALITY_SQL, line_quality
from .packing import best_fit_packing
from .rule_quality import rule_quality
from .sharding import shard_by_bytes
from .simhash import simhash_components
from .string_kernel import identify_languages
from .substrings import duplicate_passages
from .surrogates import with_surrogates
from .warc import WARC_SQL, warc_round_trip


#: Key of the registered query; for private data take one that is secret.
DEMO_KEY = "public key of the registered query"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_passages(table(spark, sf_dir, "documents"))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(table(spark, sf_dir, "documents")).drop("removed_lines")


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op7_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op8_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op9_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_quality(docs, table(spark, sf_dir, "labels")).drop("text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_frequency": LINE_QUALITY_SQL, "op6_warc_round_trip": WARC_SQL}
