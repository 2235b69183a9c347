"""Near copies of whole texts: five-word shingles, Jaccard 0.8 or more.

Candidates share one of 16 bands of three min-hashes; at a similarity of 0.8 a
pair has none in common with a chance of 1e-5. Texts come with the sketch of
all 48 min-hashes; a pair of which fewer than half agree is no candidate, which
at 0.8 happens with a chance below 1e-6. The texts of a band are first verified
along a spanning forest of largest agreement, and only pairs that are then in
different classes follow: all of a band of few texts, a second forest of one of
many. If two texts are similar, the path between them in such a forest is of
texts that agree as much or more. Bands of more texts than are compared at once
are dealt again under further min-hashes. The exact similarity of the shingle
sets decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components
from .substrings import _ODD, SIMILARITY, Shingler, _by_groups, _changes, _jaccard, _mix, _rooted, _with_texts

BANDS, ROWS = 16, 3
#: Texts of a band that are all paired, and that are compared at once.
ALL_PAIRS, AT_ONCE = 16, 8192
#: Min-hashes that must agree, and those under which a large band is dealt again.
AGREE, AGAIN = BANDS * ROWS // 2, 8
_ROW = "key bigint, depth int, tid bigint, sketch binary"


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a text."""
    return np.array([_mix(shingles ^ np.uint64((j + 1) * int(_ODD) & (1 << 64) - 1)).min() for j in range(BANDS * ROWS)], np.uint64)


def bands(least: np.ndarray) -> np.ndarray:
    """A hash for each band."""
    rows = least.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = _mix(out * _ODD + rows[:, k])
    return out.view(np.int64)


def _rows(keys, depth, tids, sketches) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(depth, pa.int32()), pa.array(tids, pa.int64()), pa.array(sketches, pa.binary())], names=["key", "depth", "tid", "sketch"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tid)."""
    shingler = Shingler()
    for batch in batches:
        keys, tids = [np.empty(0, np.int64)], []
        for tid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shingles = shingler(text.as_py())
            if len(shingles):
                keys.append(bands(sketch(shingles)))
                tids.append(tid)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(tids, np.int64), BANDS))], names=["key", "tid"])


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, sketch)."""
    shingler = Shingler()
    for batch in batches:
        held = [sketch(shingler(text.as_py())).astype(np.uint16).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.binary())], names=["tid", "sketch"])


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (key, tid), sorted, of bands that several texts have."""

    def go_on(rows: np.ndarray, _: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (0, 1)], names=["key", "tid"])

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        group = np.cumsum(_changes(rows[:, 0])) - 1
        yield from go_on(rows[np.bincount(group)[group] > 1], rows)

    return _by_groups(batches, solve, 1, go_on)


def forest(sketches: np.ndarray, left_out: np.ndarray | None = None) -> np.ndarray:
    """For each row the earlier reached row that it is tied to, in a spanning
    forest of largest agreement over pairs that agree in AGREE places or more;
    -1 for a tree's first. left_out: ties of another forest, that are not taken."""
    n = len(sketches)
    best, tie, open_ = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.ones(n, bool)
    for _ in range(n):
        i = int(np.where(open_, best, -2).argmax())
        if best[i] < AGREE:
            tie[i] = -1
        open_[i] = False
        agree = (sketches == sketches[i]).sum(axis=1)
        if left_out is not None:
            agree[left_out == i] = 0
            if left_out[i] >= 0:
                agree[left_out[i]] = 0
        nearer = open_ & (agree > best) & (agree >= AGREE)
        best[nearer], tie[nearer] = agree[nearer], i
    return tie


def group_pairs(sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j) and their round: 1 for the ties of a forest, 2 for the
    other pairs of few texts that agree enough, or for a second forest of many."""
    n = len(sketches)
    one = forest(sketches)
    i = np.flatnonzero(one >= 0)
    if n <= ALL_PAIRS:
        k, m = np.triu_indices(n, 1)
        ok = ((sketches[k] == sketches[m]).sum(axis=1) >= AGREE) & (one[k] != m) & (one[m] != k)
        k, m = k[ok], m[ok]
    else:
        two = forest(sketches, one)
        k = np.flatnonzero(two >= 0)
        m = two[k]
    return np.concatenate([i, k]), np.concatenate([one[i], m]), np.repeat([1, 2], [len(i), len(k)])


def _pair_rows(at_once: int):
    """Rows (x, y, round, and null or a row to be dealt again) of rows sorted by key."""
    names = ["x", "y", "round", "key", "depth", "tid", "sketch"]

    def found(x, y, nth) -> pa.RecordBatch:
        none = lambda t: pa.nulls(len(x), t)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(nth, pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.int64()), none(pa.binary())], names=names)

    def again(part: pa.Table, first: int) -> Iterator[pa.RecordBatch]:
        tids, depth, key = part.column("tid").to_numpy(), part.column("depth")[0].as_py(), part.column("key")[0].as_py()
        if (depth + 1) * AGAIN > BANDS * ROWS:  # what agrees in all places is compared with one
            yield found(tids, np.full(len(tids), first, np.int64), np.ones(len(tids), np.int32))
            return
        held = part.column("sketch").to_pylist()
        for at in range(0, len(held), 4096):
            some = np.frombuffer(b"".join(held[at : at + 4096]), np.uint16).reshape(-1, BANDS * ROWS)[:, depth * AGAIN : (depth + 1) * AGAIN]
            keys = _mix(np.uint64(key & (1 << 64) - 1) * _ODD + some.astype(np.uint64) * np.uint64(AGAIN) + np.arange(AGAIN, dtype=np.uint64)).view(np.int64)
            n = len(some) * AGAIN
            rows = _rows(keys.ravel(), [depth + 1] * n, np.repeat(tids[at : at + 4096], AGAIN), [v for v in held[at : at + 4096] for _ in range(AGAIN)])
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *rows.columns], names=names)

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, tids = table.column("key").to_numpy(), table.column("tid").to_numpy()
        cuts = [*np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist(), len(key)]
        x, y, nth = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                sketches = np.frombuffer(b"".join(table.column("sketch").slice(a, b - a).to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
                i, j, k = group_pairs(sketches)
                x.append(tids[a + i])
                y.append(tids[a + j])
                nth.append(k)
        if x:
            yield found(np.concatenate(x), np.concatenate(y), np.concatenate(nth).astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            while held is not None and len(held):
                key = held.column("key").to_numpy()
                if large is not None:
                    end = int(np.searchsorted(key != large[0], True))
                    if end:
                        yield from again(held.slice(0, end), large[1])
                    held = held.slice(end)
                    if len(held):
                        large = None
                        continue
                    break
                last = int(np.flatnonzero(key == key[-1])[0])
                if last:
                    yield from solve(held.slice(0, last).combine_chunks())
                    held = held.slice(last)
                if len(held) > at_once:
                    large = (int(key[-1]), held.column("tid")[0].as_py())
                    continue
                break
        if held is not None and len(held):
            yield from solve(held.combine_chunks())

    return run


def _whole_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, side, tid, text) from (tid, text, parts), parts being (pair, side)."""
    kinds = pa.schema([("pair", pa.int64()), ("side", pa.int32()), ("tid", pa.int64()), ("text", pa.binary())])
    for batch in batches:
        for tid, text, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            parts, step = parts.as_py(), max(1, (1 << 24) // max(1, len(text)))
            for at in range(0, len(parts), step):
                yield pa.RecordBatch.from_pylist([{"pair": p["pair"], "side": p["side"], "tid": tid, "text": text} for p in parts[at : at + step]], kinds)


def _checked_rows(similarity: float):
    """The pairs (x, y) that are similar, from rows sorted by pair and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(), None
        for batch in batches:
            x, y = [], []
            for pair, side, tid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if side == 0:
                    last = (pair, tid, shingler(text))
                elif last and last[0] == pair and _jaccard(last[2], shingler(text)) >= similarity:
                    x.append(last[1])
                    y.append(tid)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return run


def _similar(scratch: Scratch, pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of a written table that are similar."""
    numbered = pairs.withColumn("pair", F.monotonically_increasing_id())
    part = lambda side, t: F.struct(F.col(t).alias("tid"), F.struct("pair", F.lit(side).alias("side")).alias("part"))
    parts = numbered.select(F.explode(F.array(part(0, "x"), part(1, "y"))).alias("p")).select("p.*")
    sides = _with_texts(scratch, texts, parts, "part", "parts").mapInArrow(_whole_rows, "pair bigint, side int, tid bigint, text binary")
    out = scratch.cut(sides.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(_checked_rows(similarity), "x bigint, y bigint"))
    scratch.release()
    return out


def near_copies(docs: DataFrame, text_col: str = "text", similarity: float = SIMILARITY, at_once: int = AT_ONCE) -> DataFrame:
    """(x, y): pairs of different texts, known by xxhash64, whose closure is
    that of the near copies. Texts of fewer than five words match nothing."""
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(text_col).alias("tid"), F.col(text_col).cast("binary").alias("text"))
    light = texts.mapInArrow(_band_rows, "key bigint, tid bigint").distinct().repartition("key").sortWithinPartitions("key", "tid")
    light = scratch.cut(light.mapInArrow(_shared_rows, "key bigint, tid bigint"))
    sketches = texts.join(light.select("tid").distinct(), "tid", "left_semi").dropDuplicates(["tid"]).mapInArrow(_sketch_rows, "tid bigint, sketch binary")
    rows, found = light.join(sketches, "tid").select("key", F.lit(0).alias("depth"), "tid", "sketch"), None
    while found is None or not rows.isEmpty():
        dealt = rows.repartition("key").sortWithinPartitions("key", "tid")
        some = scratch.cut(dealt.mapInArrow(_pair_rows(at_once), "x bigint, y bigint, round int, " + _ROW))
        here = some.where("x <> y").select("x", "y", "round")
        found = here if found is None else found.unionByName(here)
        rows = some.where("key is not null").select("key", "depth", "tid", "sketch").distinct()
    found = scratch.cut(found.groupBy("x", "y").agg(F.min("round").alias("round")))
    first = _similar(scratch, scratch.cut(found.where("round = 1").select("x", "y")), texts, similarity)
    roots = scratch.cut(connected_components(scratch, first.toDF("a", "b")))
    rest = _rooted(_rooted(found.where("round = 2").select("x", "y"), roots, "x", "rx"), roots, "y", "ry").where("rx <> ry").select("x", "y")
    return first.unionByName(_similar(scratch, scratch.cut(rest), texts, similarity))
