"""Sharding by sampled splitters.

Records are ordered by (md5 of the text, id, place in the table). A sample
drawn in proportion to record sizes gives quantile boundaries, and records are
range-partitioned between them, the copies of a text first of all together. The
ranges are measured, and those that are overfull in bytes or rows are
subdivided by a denser sample of their own, those of a single text by id and
place, until none is left that can be. Ranges are small against a shard; each
shard is a run of whole ranges, so the boundaries decide where a record goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARDS, OVERHEAD = 40, 16
#: Ranges of a shard and rows of a range aimed at; a range with over OVERFULL
#: times either is subdivided.
FINE, RANGE_ROWS, OVERFULL = 64, 1_000_000, 2
#: Sampled keys per range. The driver holds so many for each range, that is one
#: for 62,500 rows of a large table.
PER_RANGE = 16
_LEAST = -(1 << 63)
_ORDER = ["k", "i", "nth"]


def locate(bounds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How many bounds, sorted rows of three, are at or below each row."""
    low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(bounds), np.int64)
    while (open_ := low < high).any():
        mid = np.where(open_, (low + high) // 2, 0)
        b = bounds[mid]
        at_or_below = (b[:, 0] < rows[:, 0]) | (b[:, 0] == rows[:, 0]) & ((b[:, 1] < rows[:, 1]) | (b[:, 1] == rows[:, 1]) & (b[:, 2] <= rows[:, 2]))
        low, high = np.where(open_ & at_or_below, mid + 1, low), np.where(open_ & ~at_or_below, mid, high)
    return low


def _placed(keys: DataFrame, bounds: list[tuple[int, int, int]]) -> DataFrame:
    """keys with part, the range that a record lies in."""
    known = keys.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64).reshape(-1, 3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy() for c in _ORDER])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(locate(known.value, rows).astype(np.int32))], names=[*batch.schema.names, "part"])

    return keys.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in keys.dtypes) + ", part int")


def splitters(drawn: list[tuple[tuple[int, int, int], float]]) -> list[tuple[int, int, int]]:
    """The quantile boundaries of sampled (key, ranges that it stands for);
    equal keys stay together."""
    out, held, weights = [], 0.0, {}
    for key, weight in drawn:
        weights[key] = weights.get(key, 0.0) + weight
    for key in sorted(weights):
        if held and held + weights[key] > 1:
            out.append(key)
            held = 0.0
        held += weights[key]
    return out


def ranges(keys: DataFrame, target_bytes: float, target_rows: float) -> tuple[list[tuple[int, int, int]], list]:
    """The boundaries, and (part, s, n) of the ranges that have records, so that
    none has over OVERFULL times a target that can be subdivided."""
    weight = F.greatest(F.col("size") / target_bytes, F.lit(1 / target_rows))
    bounds, open_, dense = [], None, PER_RANGE
    while True:
        rate = F.least(F.lit(1.0), weight * float(dense))
        draw = F.pmod(F.xxhash64(*_ORDER, F.lit(dense)), F.lit(1 << 30)) / float(1 << 30)
        rows = keys if open_ is None else _placed(keys, bounds).where(F.col("part").isin(list(open_)))
        part = F.lit(0) if open_ is None else F.col("part")
        drawn: dict[int, list] = {}
        for r in rows.where(draw < rate).select(part.alias("part"), *_ORDER, (weight / rate).alias("w")).collect():
            drawn.setdefault(r.part, []).append(((r.k, r.i, r.nth), r.w))
        for p, sample in drawn.items():
            single = open_ is not None and open_[p]
            bounds += splitters(sample if single else [((key[0], _LEAST, _LEAST), w) for key, w in sample])
        bounds = sorted(set(bounds))
        held = _placed(keys, bounds).groupBy("part").agg(F.sum("size").alias("s"), F.count("*").alias("n"), F.min("k").alias("k0"), F.max("k").alias("k1")).collect()
        open_ = {r.part: r.k0 == r.k1 for r in held if r.n > 1 and (r.s > OVERFULL * target_bytes or r.n > OVERFULL * target_rows)}
        if dense >= max(target_rows, target_bytes / OVERHEAD):  # every record was drawn
            open_ = {}
        if not open_:
            return bounds, sorted((r.part, r.s, r.n) for r in held)
        dense *= 8


def shard_by_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard), a row per row
    of docs; id_col is a long.

    size: bytes of the UTF-8 text plus 16. slot: 0, 1, .. within a shard, in
    key order. grown_shard is null, as the law is ``bytes``: a shard holds its
    even share but for two ranges, a 32nd of it, or one record if that is more.
    The copies of a text share a shard unless they overfill a range. Null texts have size
    16 and no CRC, and are ordered by their ids' md5; rows equal in id and text
    are ordered by their place, so even those of one id are parted where they
    are many. An empty table gives an empty result; other columns, whatever
    their names, are not looked at.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    body = F.col(text_col).cast("binary")
    key = F.md5(F.coalesce(body, F.concat(F.lit("null text of "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")))
    keys = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(body), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("crc"),
        F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("i"), F.monotonically_increasing_id().alias("nth"),
    )
    keys = scratch.cut(keys)
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bounds, held = ranges(keys, max(1.0, total / (shards * FINE)), float(range_rows)) if rows else ([], [])
    bases, before, slots = [], 0, [0] * shards
    for part, s, n in held:
        shard = min(shards - 1, int((before + s / 2) * shards // max(total, 1)))
        bases.append((part, shard, slots[shard]))
        before, slots[shard] = before + s, slots[shard] + n
    bases = spark.createDataFrame(bases, "part int, shard int, base long")  # a row per range
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*_ORDER)) - 1
    numbered = _placed(keys, bounds).select("id", "size", "crc", "part", nth.alias("place"))
    return numbered.join(F.broadcast(bases), "part").select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
