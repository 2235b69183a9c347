"""Overlaps of reads: an index of seeds, anchors from it, and colinear chains."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import marks
from .sketch import PRESETS, seeds

#: Repeats dropped, occurrences kept, chaining and ranking limits.
REPEATS, FANOUT, LOOKBACK, REACH, MIN_SCORE, MIN_ANCHORS, RANK = 0.0002, 512, 50, 5000, 40, 3, 512
OVERLAP = "q long, t long, same boolean, score long, anchors long, q_start long, q_end long, t_start long, t_end long"


def seed_index(found: DataFrame) -> DataFrame:
    """Seeds without those of the floor(REPEATS * distinct) most frequent
    hashes, ties by the smaller unsigned hash, and of each hash every
    ceil(n / FANOUT)-th occurrence. The frequent hashes are told by a
    histogram of the counts, so nothing is sorted over all hashes."""
    counts = found.groupBy("hash").agg(F.count("*").alias("n"))
    room = math.floor(REPEATS * counts.count())
    if room:
        cuts, before = [], 0
        for r in counts.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
            cuts.append((r.n, room - before))
            before += r.c
            if before >= room:
                break
        lowest, left = cuts[-1]
        order = Window.partitionBy("n").orderBy((F.col("hash") < 0), "hash")
        tied = counts.where(F.col("n") == lowest).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= left).select("hash")
        found = found.join(counts.where(F.col("n") > lowest).select("hash").unionByName(tied), "hash", "left_anti")
    kept = found.join(counts, "hash").withColumn("step", F.ceil(F.col("n") / FANOUT))
    rare = kept.where("step = 1")  # no order is needed where all stay
    dense = kept.where("step > 1").withColumn("rn", F.row_number().over(Window.partitionBy("hash").orderBy("read_id", "pos")))
    return rare.unionByName(dense.where("(rn - 1) % step = 0").drop("rn")).drop("n", "step")


def anchors(found: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(q, t, same, tpos, qpos) of equal seeds in different reads; positions on
    the other strand are counted from the target's end."""
    a = found.select(F.col("hash"), F.col("read_id").alias("q"), F.col("pos").alias("qpos"), F.col("forward").alias("qf"))
    b = index.select(F.col("hash"), F.col("read_id").alias("t"), F.col("pos").alias("p"), F.col("forward").alias("tf"), "length")
    same = F.col("qf") == F.col("tf")
    return a.join(b, "hash").where("q <> t").select("q", "t", same.alias("same"), F.when(same, F.col("p")).otherwise(F.col("length") - F.col("p") - k).alias("tpos"), "qpos")


def gap_cost(gap: int, k: int) -> int:
    return int(0.01 * k * gap + 0.5 * math.log2(gap)) if gap else 0


def chains(points: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, int, int, int]]:
    """(score, anchors, q_start, q_end, t_start, t_end) of the colinear chains
    of anchors (tpos, qpos), which are in order. A link looks back at LOOKBACK
    anchors; chains are taken best first and share no anchor."""
    n = len(points)
    at = np.array(points, np.int64).reshape(-1, 2)
    best, parent = np.full(n, k, np.int64), [-1] * n
    for i in range(1, n):
        low = max(0, i - LOOKBACK)
        dt, dq = (at[i] - at[low:i]).T
        gap = np.abs(dt - dq)
        ok = (dt > 0) & (dt <= REACH) & (dq > 0) & (dq <= REACH) & (gap <= REACH)
        if not ok.any():
            continue
        cost = np.where(gap > 0, (0.01 * k * gap + 0.5 * np.log2(np.maximum(gap, 1))).astype(np.int64), 0)
        value = np.where(ok, best[low:i] + np.minimum(np.minimum(dt, dq), k) - cost, -1)
        j = len(value) - 1 - int(value[::-1].argmax())  # the nearest of equal ones
        if value[j] > k:
            best[i], parent[i] = value[j], low + j
    score = best.tolist()
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda i: (-score[i], i)):
        if used[end] or score[end] < MIN_SCORE:
            continue
        path, at = [], end
        while at >= 0 and not used[at]:
            path.append(at)
            at = parent[at]
        gained = score[end] - (score[at] if at >= 0 else 0)
        for i in path:
            used[i] = True
        if len(path) >= MIN_ANCHORS and gained >= MIN_SCORE:
            first, last = points[path[-1]], points[end]
            out.append((gained, len(path), first[1], last[1] + k, first[0], last[0] + k))
    return out


#: Anchors of a pair up to which pairs are chained side by side; a row each.
BESIDE = 24


def _costs(gap: np.ndarray, k: int) -> np.ndarray:
    return np.where(gap > 0, (0.01 * k * gap + 0.5 * np.log2(np.maximum(gap, 1))).astype(np.int64), 0)


def chains_beside(tpos: np.ndarray, qpos: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """:func:`chains` of many pairs at once: (pair, score, anchors, q_start, q_end,
    t_start, t_end), by pair and then the order in which they are taken. The anchors of a
    pair, sizes of them, are one behind another."""
    out: list[tuple[np.ndarray, ...]] = []
    firsts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes >= MIN_ANCHORS]).tolist():
        pair = np.flatnonzero(sizes == n)
        if n > BESIDE:
            for p in pair.tolist():
                at = slice(firsts[p], firsts[p] + n)
                rows = chains(list(zip(tpos[at].tolist(), qpos[at].tolist(), strict=True)), k)
                if rows:
                    out.append((np.full(len(rows), p), np.arange(len(rows)), *np.array(rows, np.int64).T))
            continue
        at = firsts[pair] + np.arange(n)[:, None]  # a row for each place in a pair
        t, q, here = tpos[at], qpos[at], np.arange(len(pair))
        best, parent = np.full(t.shape, k, np.int64), np.full(t.shape, -1, np.int64)
        for i in range(1, n):
            dt, dq = t[i] - t[:i], q[i] - q[:i]
            gap = np.abs(dt - dq)
            ok = (dt > 0) & (dt <= REACH) & (dq > 0) & (dq <= REACH) & (gap <= REACH)
            value = np.where(ok, best[:i] + np.minimum(np.minimum(dt, dq), k) - _costs(gap, k), -1)
            j = i - 1 - value[::-1].argmax(axis=0)  # the nearest of equal ones
            top = value[j, here]
            better = top > k
            best[i][better], parent[i][better] = top[better], j[better]
        used = np.zeros(t.shape, bool)
        ends = np.argsort(-best, axis=0, kind="stable")
        for nth in range(n):
            end = ends[nth]
            live = np.flatnonzero(~used[end, here] & (best[end, here] >= MIN_SCORE))
            if not len(live):
                continue
            now, first, length, active = end[live].copy(), end[live].copy(), np.zeros(len(live), np.int64), np.ones(len(live), bool)
            while active.any():
                some = np.flatnonzero(active)
                used[now[some], live[some]] = True
                first[some], length[some] = now[some], length[some] + 1
                now[some] = parent[now[some], live[some]]
                active[some] = (now[some] >= 0) & ~used[now[some], live[some]]
            score = best[end[live], live]
            gained = score - np.where(now >= 0, best[now, live], 0)
            good = np.flatnonzero((length >= MIN_ANCHORS) & (gained >= MIN_SCORE))
            col, a, z = live[good], first[good], end[live[good]]
            out.append((pair[col], np.full(len(good), nth), gained[good], length[good], q[a, col], q[z, col] + k, t[a, col], t[z, col] + k))
    if not out:
        return (np.empty(0, np.int64),) * 7
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    order = np.lexsort((columns[1], columns[0]))
    return tuple(c[order] for i, c in enumerate(columns) if i != 1)


def chained(points: DataFrame, k: int) -> DataFrame:
    """Chains of all anchors. Rows of a pair of reads come in one run of a
    sorted partition and are folded as they pass, so a task holds one pair;
    pairs, not queries, are hashed, so a read with many partners is spread."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []

        def close() -> None:
            if len(held) >= MIN_ANCHORS:
                out.extend((*key, *c) for c in chains(held, k))

        for frame in frames:
            for q, t, same, tpos, qpos in zip(*(frame[c].tolist() for c in ("q", "t", "same", "tpos", "qpos")), strict=True):
                if (q, t, same) != key:
                    close()
                    key, held = (q, t, same), []
                held.append((tpos, qpos))
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=_COLUMNS)
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=_COLUMNS)

    return points.repartition("q", "t", "same").sortWithinPartitions("q", "t", "same", "tpos", "qpos").mapInPandas(run, OVERLAP)


_COLUMNS = [c.split()[0] for c in OVERLAP.split(", ")]


def best_chains(found: DataFrame, index: DataFrame, k: int, rank: int, last: bool = False) -> DataFrame:
    """The first ``rank`` chains of every read: score falling, target (falling if
    ``last``) and start rising, and their rank. Reads of the same seeds are chained once and told
    apart by themselves only, against an index held in memory, part by part."""
    target = F.desc("t") if last else F.asc("t")
    order = Window.partitionBy("q").orderBy(F.desc("score"), target, "q_start", "same")

    def of(held: marks.Index, mark: np.ndarray):
        own_hash, pos, forward = mark[: len(mark) // 2], mark[len(mark) // 2 :] >> 1, mark[len(mark) // 2 :] & 1 == 1
        which, entry = held.of(own_hash)
        t, same, p, qpos = held.read[entry], held.forward[entry] == forward[which], held.pos[entry], pos[which]
        tpos = np.where(same, p, held.length[entry] - p - k)
        at = np.lexsort((qpos, tpos, same, t))
        t, same, tpos, qpos = t[at], same[at], tpos[at], qpos[at]
        new = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (same[1:] != same[:-1])))) if len(t) else np.empty(0, np.int64)
        pair, score, n, *ends = chains_beside(tpos, qpos, np.diff(np.append(new, len(t))), k)
        t, same = t[new][pair], same[new][pair]
        best = np.lexsort((same, ends[0], -t if last else t, -score))
        columns = [c[best] for c in (t, same, score, n, *ends)]

        def own(read: int) -> tuple[np.ndarray, ...]:
            some = np.flatnonzero(columns[0] != read)[:rank]
            return (np.full(len(some), read, np.int64), *[c[some] for c in columns], np.arange(1, len(some) + 1, dtype=np.int32))

        return own

    parts = marks.index_parts(index)
    if parts is None:
        return chained(anchors(found, index, k), k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rank)
    listed = found.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", F.col("forward").cast("long").alias("f")))).alias("s"))
    lists = listed.select("read_id", F.concat(F.col("s.hash"), F.transform("s", lambda x: 2 * x["pos"] + x["f"])).alias("mark"))
    if len(parts) > 1:
        lists = written(lists)
    out = [marks.met(lists, p.select(F.col("hash").alias("code"), "read_id", "pos", "forward", "length"), of, f"{OVERLAP}, rank int") for p in parts]
    if len(out) == 1:
        return out[0]
    return marks.united(out).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rank)


def overlaps(reads: DataFrame, preset: str = "hifi", rank: int = RANK) -> DataFrame:
    """The best chained overlaps of every read with the others: score falling,
    target and start rising; at most rank a read."""
    found = written(seeds(reads, preset))
    return best_chains(found, written(seed_index(found)), PRESETS[preset][1], rank)
