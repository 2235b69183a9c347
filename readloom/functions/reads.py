"""Column and DataFrame functions over reads (name, seq, qual), JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.views import BINS, PHRED


def revcomp(seq: Column) -> Column:
    """Reverse complement; keeps case and what is not a base."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, revcomp(kmer))


def kmers(seq: Column, k: int) -> Column:
    """The k-mers of a sequence in order; empty if it is shorter."""
    return F.when(F.length(seq) < k, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(seq) - k + 1), lambda i: F.substr(seq, i, F.lit(k))))


def bin_quality(qual: Column, table: str) -> Column:
    """Qualities under one of the tables bin8, bin4, bin2, ont, hifi."""
    pairs = [(a, chr(33 + q)) for a, q in zip(PHRED, BINS[table], strict=True) if a != chr(33 + q)]
    return F.translate(qual, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def strip_mate(name: Column) -> Column:
    return F.regexp_replace(name, "/[12]$", "")


def content_stats(reads: DataFrame) -> DataFrame:
    """One row: reads, bases, min_len, max_len, a, c, g, t, n, other, gc,
    mean_len, mean_quality, qual_hist (94 counts). One aggregation with no
    row per base: counts are taken as length differences."""
    long = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    count = lambda column, ch: F.sum(F.length(column) - F.length(F.replace(F.col(column), F.lit(ch), F.lit(""))))
    bases = [long(count("seq", b)).alias(b.lower()) for b in "ACGTN"]
    hist = F.array(*[long(count("qual", ch)) for ch in PHRED]).alias("qual_hist")
    out = reads.agg(F.count("*").alias("reads"), long(F.sum(F.length("seq"))).alias("bases"), F.min(F.length("seq")).alias("min_len"), F.max(F.length("seq")).alias("max_len"), *bases, hist)
    acgt = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    total = F.aggregate(F.zip_with("qual_hist", F.sequence(F.lit(0), F.lit(93)), lambda n, q: n * q), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        "reads", "bases", "min_len", "max_len", "a", "c", "g", "t", "n", (F.col("bases") - acgt - F.col("n")).alias("other"), F.try_divide(F.col("g") + F.col("c"), acgt).alias("gc"),
        F.try_divide("bases", "reads").alias("mean_len"), F.try_divide(total, F.col("bases")).alias("mean_quality"), "qual_hist",
    )
