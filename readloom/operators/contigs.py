"""Clustered reads folded into contigs: each read is a MATCH of the one before,
part of the CONTIG at hand, or a LITERAL that begins a new one."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least overlap, and how far from the anchor's place is searched.
OVERLAP, SEARCH = 16, 8
_BASES = "ACGT"
OPS = "read_id long, canon string, op string, contig long, start long, mismatches long, novel long"


_CODES = np.full(256, 4, np.uint8)
_CODES[list(b"ACGT")] = range(4)


class Contig:
    """Votes of the reads placed so far, a column each; a column's base is the
    one with most votes, the first of A, C, G, T among equals. Reads are arrays
    of bytes."""

    def __init__(self, seq: np.ndarray, anchor: int):
        self.votes = np.zeros((max(64, 2 * len(seq)), 5), np.int32)
        self.held = np.zeros(len(self.votes), np.uint8)
        self.size, self.anchor = 0, anchor
        self.place(seq, 0)

    def place(self, seq: np.ndarray, start: int) -> None:
        end = start + len(seq)
        if end > len(self.held):
            more = max(end, 2 * len(self.held)) - len(self.held)
            self.votes = np.concatenate([self.votes, np.zeros((more, 5), np.int32)])
            self.held = np.concatenate([self.held, np.zeros(more, np.uint8)])
        if end > self.size:
            self.held[max(start, self.size) : end] = seq[max(0, self.size - start) :]
            self.size = end
        code = _CODES[seq]
        at = np.arange(start, end)[code < 4]
        self.votes[at, code[code < 4]] += 1
        self.held[at] = np.frombuffer(b"ACGT", np.uint8)[self.votes[at, :4].argmax(axis=1)]

    def fit(self, seq: np.ndarray, start: int) -> tuple[int, int] | None:
        """(mismatches, new bases) at a place, None if it isn't good enough."""
        overlap = min(self.size - start, len(seq))
        if start < 0 or overlap < min(OVERLAP, len(seq)):
            return None
        wrong = int(np.count_nonzero(seq[:overlap] != self.held[start : start + overlap]))
        novel = len(seq) - overlap
        return (wrong, novel) if wrong <= overlap // 4 and novel + 2 * wrong < len(seq) else None

    def find(self, seq: np.ndarray, anchor: int) -> tuple[int, int, int] | None:
        """(start, mismatches, new bases): where the anchors say, else the place
        near it with fewest mismatches, the nearest of equal ones."""
        want = self.anchor - anchor
        hit = self.fit(seq, want)
        if hit:
            return want, *hit
        near = [(f[0], abs(d), d, f[1]) for d in range(-SEARCH, SEARCH + 1) if d and (f := self.fit(seq, want + d))]
        if not near:
            return None
        wrong, _, d, novel = min(near)
        return want + d, wrong, novel


def folded(plan: DataFrame) -> DataFrame:
    """An operation per read of a plan (read_id, canon, anchor, oriented).

    Contigs end with their minimizer. Reads pass through a sorted partition one
    by one, so a task holds one contig and not its bucket. Reads without a
    minimizer are literals. A group of copies is one contig and many matches.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, contig, nth, last = None, None, -1, None
        for frame in frames:
            out = []
            for read, canon, anchor, seq in zip(*(frame[c].tolist() for c in ("read_id", "canon", "anchor", "oriented")), strict=True):
                if canon != key:
                    key, contig, nth, last = canon, None, -1, None
                if not isinstance(canon, str):
                    out.append((read, None, "LITERAL", -1, 0, 0, len(seq or "")))
                    continue
                data = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8) if seq != last else None
                hit = contig and data is not None and contig.find(data, anchor)
                if contig and seq == last:
                    out.append((read, canon, "MATCH", nth, start, 0, 0))
                elif hit:
                    start = hit[0]
                    contig.place(data, start)
                    out.append((read, canon, "CONTIG", nth, *hit))
                else:
                    contig, nth, start = Contig(data, anchor), nth + 1, 0
                    out.append((read, canon, "LITERAL", nth, 0, 0, len(seq)))
                last = seq
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OPS.split(", ")])

    keyed = plan.selectExpr("read_id", "canon", "CAST(anchor AS BIGINT) AS anchor", "oriented", "coalesce(canon, CAST(read_id AS STRING)) AS _spread")
    return keyed.repartition("_spread").drop("_spread").sortWithinPartitions("canon", "anchor", "oriented", "read_id", ascending=[True, False, True, True]).mapInPandas(run, OPS)


def op_statistics(ops: DataFrame) -> DataFrame:
    """Reads, new bases and mismatches of each operation."""
    return ops.groupBy("op").agg(F.count("*").alias("reads"), F.sum("novel").alias("novel"), F.sum("mismatches").alias("mismatches"))


class Joined:
    """Union-find over contigs that accepts an edge unless it closes a circle
    or its ends have a follower or a forerunner already."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.after: dict[int, int] = {}
        self.before: dict[int, int] = {}

    def find(self, x: int) -> int:
        while self.root.get(x, x) != x:
            self.root[x] = x = self.root.get(self.root[x], self.root[x])
        return x

    def accept(self, a: int, b: int) -> bool:
        ra, rb = self.find(a), self.find(b)
        if ra == rb or a in self.after or b in self.before:
            return False
        self.root[rb], self.after[a], self.before[b] = ra, b, a
        return True


def consensus(draft: str, votes: list[list[str]], min_votes: int = 3) -> str:
    """A draft under the votes on each of its places, ``-`` being a deletion:
    fewer than min_votes keep the draft's base, a deletion needs strictly more
    votes than the best base, the first of A, C, G, T wins among equals."""
    out = []
    for base, seen in zip(draft, votes, strict=True):
        count = Counter(seen)
        if sum(count.values()) < min_votes:
            out.append(base)
            continue
        best = max(_BASES, key=lambda b: count[b])
        if count["-"] > count[best]:
            continue
        out.append(best if count[best] else base)
    return "".join(out)


def cover(spans: list[tuple[int, int]], overlap: int = 2000) -> list[int]:
    """Spans (start, end), in order of start, that tile a layout: of those that
    begin overlap before the end at hand the one that reaches furthest, the first
    of equal ones; where none goes on, the next span after them."""
    if not spans:
        return []
    picked, at, end = [0], 1, spans[0][1]
    while at < len(spans):
        best, i = None, at
        while i < len(spans) and spans[i][0] + overlap <= end:  # spans begin in order, so none behind reaches back
            if spans[i][1] > end and (best is None or spans[i][1] > spans[best][1]):
                best = i
            i += 1
        if best is None:
            if i >= len(spans):
                break
            best = i  # nothing goes on: the next span after the gap
        picked.append(best)
        at, end = best + 1, spans[best][1]
    return picked
