"""Alignment text without a header: eleven columns and tags, parted by tabs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of the format.
COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
_NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The columns and tags (array<string>) of text files, a row per line; lines
    that begin with @ and empty ones are passed over. Of a line with fewer
    columns those that are missing are null, as are numbers that are none.
    Files are split by Spark, as a line is a record."""
    lines = spark.read.text(path).where("value <> '' AND NOT startswith(value, '@')")
    parts = lines.select(F.split("value", "\t", -1).alias("p"))
    column = lambda i, c: F.get("p", F.lit(i)).try_cast("bigint" if c in _NUMBERS else "string").alias(c)
    return parts.select(*[column(i, c) for i, c in enumerate(COLUMNS)], F.slice("p", len(COLUMNS) + 1, F.greatest(F.size("p") - len(COLUMNS), F.lit(0))).alias("tags"))


def primary(alignments: DataFrame) -> DataFrame:
    """One row per read: neither secondary nor supplementary (flags 256, 2048)."""
    return alignments.where(F.col("flag").bitwiseAND(F.lit(256 | 2048)) == 0)
