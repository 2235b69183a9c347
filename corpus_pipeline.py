"""The corpus pipeline over ``documents``: what is of low quality goes, one
document of each near-duplicate group stays, documents with benchmark passages
go, personal data is replaced, and what is left is packed.

Stages are functions of (spark, docs, sf_dir); :func:`run` writes what each
returns to the shared folder and reads it again as the docs of the next.
Every stage keeps the rows that its operator does not speak against, null
texts and ids included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import Scratch, connected_components, table
from readloom.llm.decontaminate import contaminated
from readloom.llm.near_copies import near_copies
from readloom.llm.packing import best_fit_packing
from readloom.llm.rule_quality import rule_quality
from readloom.llm.simhash import simhash_components
from readloom.llm.surrogates import with_surrogates

#: Rows that are looked up by broadcast; more are joined.
LOOKUP_LIMIT = 1_000_000
#: Key of the surrogates; for private data take one that is secret.
KEY = "public key of the registered pipeline"


def _packed(docs: DataFrame, *more) -> DataFrame:
    """docs as one column _row, so that no column's name can meet another's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *more)


def _as(frame: DataFrame, docs: DataFrame) -> DataFrame:
    return frame.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts to be of label 1, a null text
    as an empty one. Without labels of both kinds all stay."""
    scored = rule_quality(_packed(docs, F.col("doc_id"), F.col("text")), table(spark, sf_dir, "labels"))
    return _as(scored.where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component over SimHash links and near copies (Jaccard
    0.8 or more of five-word shingles): that with the smallest id, null ids
    last. Documents are told apart by id and text, so that one of a null or
    repeated id goes only if its own text is near another's. Null and wordless
    texts are copies of one another. Of rows that have id and text in common
    the least stays, by all columns as JSON in their order."""
    scratch, key = Scratch(spark), F.struct(F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash"))
    found = scratch.cut(simhash_components(docs.select(key.alias("_key"), "text"), "_key").select("_key", "component_id"))
    links = found.select(F.col("_key.hash").alias("a"), F.col("component_id.hash").alias("b")).unionByName(near_copies(docs.select("text")).toDF("a", "b"))
    roots = connected_components(scratch, links)
    found = found.join(roots, F.col("_key.hash") == F.col("node"), "left").withColumn("root", F.coalesce("root", "_key.hash"))
    least = found.groupBy("root").agg(F.min("component_id").alias("least"))
    found = scratch.cut(found.join(least, "root").select("_key", F.col("least").alias("component_id")))
    gone = scratch.cut(found.where("_key <> component_id").select(F.col("_key").alias("_gone")).distinct())
    kept = _without(_packed(docs, key.alias("_mark")), gone, F.col("_mark") == F.col("_gone"))
    if not found.groupBy("_key").count().where("count > 1").isEmpty():
        kept = kept.withColumn("_json", F.to_json("_row", {"ignoreNullFields": "false"})).groupBy("_mark").agg(F.min_by("_row", "_json").alias("_row"))
    return _as(kept, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window is similar to a benchmark item; null texts
    stay."""
    found = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct()
    marked = _packed(docs, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"))
    return _as(_without(marked, Scratch(spark).cut(found), F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash"))), docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in place of personal data; n_chars, if
    there is one, is that of the new text."""
    out = with_surrogates(_packed(docs, F.col("text").alias("_text")), KEY, text_col="_text", count_col="_entities")
    new = {"text": F.col("_text"), "n_chars": F.coalesce(F.length("_text"), F.lit(0)).cast("long")}
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in bins."""
    return best_fit_packing(docs.select("doc_id", "text", "source"))


def _without(docs: DataFrame, gone: DataFrame, same) -> DataFrame:
    """docs but for those that have a row in gone, a table of keys."""
    return docs.join(F.broadcast(gone) if gone.count() <= LOOKUP_LIMIT else gone, same, "left_anti")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("pack", pack)]

#: Keyed hashes, SimHash components and trained rules are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
