"""Minimizers, closed syncmers and seed occurrences with exact 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.hashes import hash64

#: Presets: window, k, and s of the syncmers (none for minimizers).
PRESETS = {"ont": (10, 15, 5), "hifi": (19, 19, None)}
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
_TOP = np.uint64(2**64 - 1)


def packed(seq: str, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each k-mer of a read: canonical value (two bits a base), whether the
    forward strand gives it, and whether it has nothing but A, C, G and T."""
    code = _CODE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    n = len(code) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, bool), np.empty(0, bool)
    bad = np.concatenate(([0], np.cumsum(code > 3)))
    two = (code & 3).astype(np.uint64)
    forward, reverse = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        forward = (forward << np.uint64(2)) | two[j : j + n]
        reverse |= (np.uint64(3) - two[j : j + n]) << np.uint64(2 * j)
    return np.minimum(forward, reverse), forward <= reverse, bad[k:] == bad[:n]


def minimizers(seq: str, w: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, forward) of the window minimizers.

    Of equal hashes in a window the last counts. Windows end at positions from
    w - 1 on; after a break of other bases they are short at first. One with
    the hash of the one before is left out, across breaks too.
    """
    value, forward, good = packed(seq, k)
    n = len(value)
    if not good.any():
        return value[:0], np.empty(0, np.int64), forward[:0]
    hashes = hash64(value)
    at = np.arange(n)
    start = np.maximum.accumulate(np.where(good, 0, at + 1))  # of the run a k-mer is in
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.full(w - 1, _TOP), hashes)), w)
    reach = at[:, None] - np.arange(w)[None, :]  # positions, the last first
    seen = np.where(reach >= start[:, None], windows[:, ::-1], _TOP)
    best = at - seen.argmin(axis=1)
    best = best[good & (at + 1 >= w)]
    if not len(best):
        return value[:0], best, forward[:0]
    new = np.concatenate(([True], hashes[best[1:]] != hashes[best[:-1]]))
    best = best[new]
    return hashes[best], best, forward[best]


def syncmers(seq: str, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, forward) of the k-mers whose smallest canonical s-mer
    hash is that of their first or last s-mer."""
    value, forward, good = packed(seq, k)
    if not good.any():
        return value[:0], np.empty(0, np.int64), forward[:0]
    small = np.lib.stride_tricks.sliding_window_view(hash64(packed(seq, s)[0]), k - s + 1)
    least = small.min(axis=1)
    at = np.flatnonzero(good & ((small[:, 0] == least) | (small[:, -1] == least)))
    return hash64(value[at]), at, forward[at]


def seeds(reads: DataFrame, preset: str = "hifi") -> DataFrame:
    """(read_id, hash, pos, forward, length): a row per seed of a read; the
    hash's unsigned bits are kept in a signed long. Null reads have none."""
    w, k, s = PRESETS[preset]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(i, len(q), *(syncmers(q, k, s) if s else minimizers(q, w, k))) for i, q in zip(frame["read_id"], frame["seq"], strict=True) if isinstance(q, str)]
            sizes = [len(f[2]) for f in found]
            if sum(sizes):
                yield pd.DataFrame({
                    "read_id": np.repeat([f[0] for f in found], sizes), "hash": np.concatenate([f[2] for f in found]).view(np.int64), "pos": np.concatenate([f[3] for f in found]),
                    "forward": np.concatenate([f[4] for f in found]), "length": np.repeat([f[1] for f in found], sizes),
                })

    return reads.where("seq IS NOT NULL").select("read_id", "seq").mapInPandas(run, "read_id long, hash long, pos long, forward boolean, length long")
