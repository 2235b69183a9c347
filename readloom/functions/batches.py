"""Kernels over Arrow batches of reads: the bases of a batch are one array of
bytes, so that what looks at every base costs no row and no shuffle for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CODE = np.full(256, 255, np.uint8)
_CODE[list(b"ACGT")] = range(4)
#: Bases that are looked at at a time.
PIECE = 1 << 22


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings, null as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8), at - at[0]


def pieces(batch: pa.RecordBatch, by: int = 0) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about PIECE bytes in a column."""
    _, offsets = flat(batch.column(by))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def _counts(frame: DataFrame, bins: int, of) -> DataFrame:
    """(code, n): a sum over batches of the codes below bins that ``of`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bins, np.int64)
        for batch in batches:
            for part in pieces(batch):
                held += np.bincount(of(part), minlength=bins)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], names=["code", "n"])

    return frame.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def context_counts(reads: DataFrame, k: int, column: str = "seq") -> DataFrame:
    """(code, n): how often a base follows k others, in base 4; a read begins
    behind k times A and bases other than ACGT are passed over. k: 10 at most,
    as a task holds 4 ** (k + 1) counts."""
    if not 0 <= k <= 10:
        raise ValueError("contexts of 0 to 10 bases")

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = flat(batch.column(0))
        code = _CODE[data]
        keep = code < 4
        sizes = np.diff(np.concatenate(([0], np.cumsum(keep)))[offsets])
        starts = np.cumsum(sizes + k) - sizes  # of the bases, behind those that are put before them
        where = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        padded = np.zeros(int((sizes + k).sum()), np.int64)
        padded[where] = code[keep]
        out = np.zeros(len(where), np.int64)
        for j in range(k + 1):
            out = out * 4 + padded[where - k + j]
        return out

    return _counts(reads.select(column), 4 ** (k + 1), codes)


def context_bits(counts: DataFrame, symbols: int) -> DataFrame:
    """The bits of an ideal code of the symbols given their contexts."""
    per = counts.groupBy((F.col("code") / symbols).cast("long").alias("ctx")).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("own"))
    return per.agg(F.round(F.sum(F.col("t") * F.log2("t") - F.col("own")), 6).alias("bits"))


def quality_counts(reads: DataFrame, column: str = "qual") -> DataFrame:
    """(code, n) of the Phred value behind another, 128 times that; zero is
    taken to be before a read."""

    def codes(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = flat(batch.column(0))
        q = (data.astype(np.int64) - 33) & 127
        before = np.concatenate(([0], q[:-1])) if len(q) else q
        before[offsets[:-1][np.diff(offsets) > 0]] = 0
        return before * 128 + q

    return _counts(reads.select(column), 128 * 128, codes)


def _firsts(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(offsets[:-1], np.diff(offsets))


def homopolymers(reads: DataFrame, most: int = 7) -> DataFrame:
    """(read_id, i, run): the length, ``most`` at most, of the run of equal bases
    that ends at base i."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, offsets = flat(part.column(0))
                at, first = np.arange(len(data)), _firsts(offsets)
                new = np.concatenate(([True], data[1:] != data[:-1])) | (at == first) if len(data) else np.empty(0, bool)
                began = np.maximum.accumulate(np.where(new, at, 0))
                ids = np.repeat(part.column(1).to_numpy(), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(at - first + 1), pa.array(np.minimum(most, at - began + 1))], names=["read_id", "i", "run"])

    return reads.select("seq", F.col("read_id").cast("long").alias("read_id")).mapInArrow(run, "read_id bigint, i bigint, run bigint")


def quality_contexts(reads: DataFrame) -> DataFrame:
    """(read_id, i, q1, q2, q3, delta): the last three qualities before base i,
    the second in steps of 4 and the third of 16, and how often, 3 at most, the
    first two were unlike so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                data, offsets = flat(part.column(0))
                q, at, first = data.astype(np.int64) - 33, np.arange(len(data)), _firsts(offsets)
                back = [np.where(at - first >= k, np.concatenate((np.zeros(k, np.int64), q))[: len(q)], 0) for k in (1, 2, 3)]
                unlike = np.cumsum(back[0] != back[1])
                base = np.concatenate(([0], unlike))[first]
                ids = np.repeat(part.column(1).to_numpy(), np.diff(offsets))
                cols = [ids, at - first + 1, back[0].astype(np.int32), (back[1] // 4).astype(np.int32), (back[2] // 16).astype(np.int32), np.minimum(3, unlike - base)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["read_id", "i", "q1", "q2", "q3", "delta"])

    return reads.select("qual", F.col("read_id").cast("long").alias("read_id")).mapInArrow(run, "read_id bigint, i bigint, q1 int, q2 int, q3 int, delta bigint")


def differences(pairs: DataFrame, one: str, two: str) -> DataFrame:
    """(read_id, n, changed, total, squares, worst) of two strings of one length
    a read: how many bytes differ, and their absolute differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                (a, offsets), (b, other) = flat(part.column(0)), flat(part.column(1))
                if not np.array_equal(offsets, other):
                    raise ValueError("strings of unequal lengths")
                d = np.abs(a.astype(np.int64) - b)
                upto = lambda v: np.diff(np.concatenate(([0], np.cumsum(v)))[offsets])
                worst, full = np.zeros(part.num_rows, np.int64), np.diff(offsets) > 0
                if full.any():
                    worst[full] = np.maximum.reduceat(d, offsets[:-1][full])
                cols = [part.column(2).to_numpy(), np.diff(offsets), upto(d > 0), upto(d), upto(d * d), worst]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["read_id", "n", "changed", "total", "squares", "worst"])

    return pairs.select(one, two, F.col("read_id").cast("long").alias("read_id")).mapInArrow(run, "read_id bigint, n bigint, changed bigint, total bigint, squares bigint, worst bigint")


def letter_counts(frame: DataFrame, column: str) -> DataFrame:
    """(letter, n) over all strings: a row per string and letter, not per base."""
    letters = F.array_distinct(F.split(F.col(column), ""))
    some = F.filter(letters, lambda x: x != "")
    count = lambda x: F.struct(x.alias("letter"), (F.length(column) - F.length(F.replace(F.col(column), x, F.lit("")))).cast("long").alias("n"))
    return frame.select(F.explode(F.transform(some, count)).alias("c")).select("c.*").groupBy("letter").agg(F.sum("n").alias("n"))
