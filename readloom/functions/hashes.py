"""Exact 64-bit and CRC-32C hashes, vectorised in numpy; Arrow-batched UDFs
where Spark has no function of the same values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GOLDEN, _M1, _M2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: The Castagnoli polynomial, bits reversed.
POLY = 0x82F63B78


def hash64(x: np.ndarray) -> np.ndarray:
    """splitmix64 of unsigned 64-bit values."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + _GOLDEN
        z = (z ^ (z >> np.uint64(30))) * _M1
        z = (z ^ (z >> np.uint64(27))) * _M2
        return z ^ (z >> np.uint64(31))


def multiplicative(x: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of x times the golden ratio: a slot in 0 to 2^bits - 1."""
    with np.errstate(over="ignore"):
        return (x.astype(np.uint64) * _GOLDEN) >> np.uint64(64 - bits)


def _byte_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(POLY), out >> 1)
    return out


_TABLE = _byte_table()
_TABLE_INTS = _TABLE.tolist()


def crc32c(data: bytes, crc: int = 0) -> int:
    """CRC-32C of bytes, continuing a checksum."""
    crc ^= 0xFFFFFFFF
    for b in data:
        crc = _TABLE_INTS[(crc ^ b) & 255] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's, x^0 in the top bit."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = (b >> 1) ^ POLY if b & 1 else b >> 1
    return out


def crc32c_combine(a: int, b: int, len_b: int) -> int:
    """CRC-32C of two joined texts from the checksum of each and the length of
    the second: the first is multiplied by x to the power of 8 len_b."""
    power, square, n = 1 << 31, 1 << 30, 8 * len_b
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(power, a) ^ b


def crc32c_column(values: list[bytes]) -> np.ndarray:
    """CRC-32C of many texts at once, a byte position at a time; the longest
    come first, so that those not yet at their end are a prefix."""
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-lengths, kind="stable")
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1][order]
    flat, left = np.frombuffer(b"".join(values), np.uint8), lengths[order]
    crc = np.full(len(values), 0xFFFFFFFF, np.uint32)
    live = len(values)
    for at in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= at:
            live -= 1
        now = crc[:live]
        crc[:live] = _TABLE[(now ^ flat[starts[:live] + at]) & 255] ^ (now >> 8)
    out = np.empty(len(values), np.int64)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_of(column: Column) -> Column:
    """CRC-32C of a string column's UTF-8, as a long; null stays null."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype="Int64", index=texts.index)
        out[known] = crc32c_column([t.encode() for t in texts[known]])
        return out

    return run(column)


def crc32c_in_order(reads: DataFrame, value: Column, order: str = "read_id") -> tuple[int, int]:
    """(CRC-32C, length) of the values joined in the order of a column.

    Each range partition gives one row (its checksum and length), which the
    driver combines; it never sees the values.
    """
    rows = reads.select(F.col(order).alias("at"), value.alias("v")).repartitionByRange("at").sortWithinPartitions("at")

    def run(frames):
        crc, size, first = 0, 0, None
        for frame in frames:
            parts = [v.encode() for v in frame["v"]]
            if parts and first is None:
                first = int(frame["at"].iloc[0])
            for one, part in zip(crc32c_column(parts).tolist(), parts, strict=True):
                crc, size = crc32c_combine(crc, one, len(part)), size + len(part)
        if first is not None:
            yield pd.DataFrame({"first": [first], "crc": [crc], "size": [size]})

    crc, size = 0, 0
    for r in rows.mapInPandas(run, "first long, crc long, size long").orderBy("first").toLocalIterator():
        crc, size = crc32c_combine(crc, r.crc, r.size), size + r.size
    return crc, size


def xxh3_of(column: Column) -> Column:
    """XXH3 of a string column's UTF-8 as 16 hex digits; null stays null."""
    import xxhash

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: xxhash.xxh3_64_hexdigest(t.encode()), na_action="ignore")

    return run(column)
