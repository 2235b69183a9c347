"""SimHash near-duplicate detection over pigeonhole blocks.

Every text gets a 64-bit SimHash of its word shingles. Two fingerprints that
differ in at most three bits leave at least two of five blocks untouched, so
each distinct fingerprint is dealt out under the ten pairs of blocks, and
Hamming distances are measured only among fingerprints with equal blocks.
A bucket that is too large for one pass is dealt out again over four parts of
its remaining bits, of which a close pair shares one; 11 free bits or fewer
can't hold more fingerprints than a pass takes. No pair is lost either way.
Copies share a fingerprint, so groups of copies cost one row per bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of one bucket that are compared in one pass; no less than 2048.
BUCKET = 4096
#: Shingles hashed before their bits are counted.
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8, dtype=np.uint16) * 256)[None, :]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text, unsigned; zero for a text without words."""
    words = text.lower().split() if text else []  # bytes: A-Z only, ASCII blanks only
    if not words:
        return 0
    width = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros((8, 256), np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = b"".join([digest(joined[a:b], SEED)[::-1] for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)])
        counts += np.bincount((np.frombuffer(hashes, np.uint8).reshape(-1, 8) + _LANE).ravel(), minlength=2048).reshape(8, 256)
    set_bits = (counts @ _BITS).ravel() * 2 > len(starts)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) with fp as a signed long, one row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def _masks() -> list[int]:
    """Of each pair of the five blocks, as signed longs."""
    cuts = [0, 13, 26, 39, 52, 64]
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [int(np.uint64(x | y).astype(np.int64)) for x, y in combinations(blocks, 2)]


def _stars(fps: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges that join the linked fingerprints of a bucket as stars, found by
    breadth-first search; each round compares with what is not yet reached."""
    out, left = [], fps
    while left.size > 1:
        root, front, left = left[0], left[:1], left[1:]
        while front.size and left.size:
            hit = np.zeros(left.size, bool)
            step = max(1, (1 << 20) // left.size)
            for at in range(0, front.size, step):
                open_ = np.flatnonzero(~hit)
                if not open_.size:
                    break
                near = np.bitwise_count(front[at : at + step, None] ^ left[None, open_]) <= radius
                hit[open_[near.any(axis=0)]] = True
            front, left = left[hit], left[~hit]
            if front.size:
                out.append((np.full(front.size, root, np.uint64), front))
    return out


def _finer(mask: int, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A bucket's rows under radius + 1 finer masks."""
    free = [i for i in range(64) if not mask >> i & 1]
    parts = np.array_split(free, radius + 1)
    masks = [mask | sum(1 << int(i) for i in part) for part in parts]
    return np.repeat(np.array(masks, np.uint64), fps.size), np.tile(fps, len(masks))


def _link(radius: int, bucket: int):
    names = ["again", "a", "b"]

    def pack(again: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(a.size, again)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    def solve(mask: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole buckets, one after another."""
        key = fp & mask
        first = np.flatnonzero(np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))))
        sizes = np.diff(np.append(first, fp.size))
        where = np.repeat(np.arange(first.size), sizes)
        small = np.repeat((sizes > 1) & (sizes <= 8), sizes)
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for step in range(1, 8):
            i = np.flatnonzero(small[:-step] & (where[:-step] == where[step:]))
            i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= radius]
            a.append(fp[i])
            b.append(fp[i + step])
        for g in np.flatnonzero((sizes > 8) & (sizes <= bucket)):
            for x, y in _stars(fp[first[g] : first[g] + sizes[g]], radius):
                a.append(x)
                b.append(y)
        yield pack(False, np.concatenate(a), np.concatenate(b))
        for g in np.flatnonzero(sizes > bucket):
            yield pack(True, *_finer(int(mask[first[g]]), fp[first[g] : first[g] + sizes[g]], radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        mask, fp, large = none, none, None
        for batch in batches:
            mask = np.concatenate((mask, batch.column(0).to_numpy().view(np.uint64)))
            fp = np.concatenate((fp, batch.column(1).to_numpy().view(np.uint64)))
            if not fp.size:
                continue
            if large is not None:  # what belongs to a bucket known to be too large goes on at once
                same = (mask == large[0]) & (fp & mask == large[1])
                if same.any():
                    yield pack(True, *_finer(int(large[0]), fp[same], radius))
                mask, fp = mask[~same], fp[~same]
                if not fp.size:
                    continue
                large = None
            last = (mask[-1], fp[-1] & mask[-1])
            held = (mask == last[0]) & (fp & mask == last[1])
            if not held.all():
                yield from solve(mask[~held], fp[~held])
            mask, fp = mask[held], fp[held]
            if fp.size > bucket:
                yield pack(True, *_finer(int(last[0]), fp, radius))
                mask, fp, large = none, none, last
        if fp.size:
            yield from solve(mask, fp)

    return run


def hamming_links(scratch: Scratch, fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of fps.fp whose closure
    is that of all pairs at radius bits or fewer. radius: 3 at most."""
    if not 0 <= radius <= 3 or bucket < 2048:
        raise ValueError("the blocks hold for radius 0 to 3 and buckets of 2048 or more")
    rows = fps.select("fp").distinct().select(F.explode(F.array(*[F.lit(m) for m in _masks()])).alias("mask"), "fp")
    edges = None
    while True:
        dealt = rows.repartition(F.col("mask"), F.col("fp").bitwiseAND(F.col("mask"))).sortWithinPartitions("mask", F.col("fp").bitwiseAND(F.col("mask")), "fp")
        found = scratch.cut(dealt.mapInArrow(_link(radius, bucket), "again boolean, a bigint, b bigint"))
        here = found.where("not again").select("a", "b")
        edges = here if edges is None else edges.unionByName(here)
        rows = found.where("again").select(F.col("a").alias("mask"), F.col("b").alias("fp")).distinct()
        if found.where("again").isEmpty():
            return edges


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """(id_col, fingerprint, component_id) for each row of docs.

    fingerprint: 16 lower-case hex digits. component_id: the smallest id
    reachable over links of ``radius`` bits or fewer, the row's own included.
    Null and wordless texts have fingerprint zero and are linked like any
    other. Repeated ids keep a row each; a null id is never a component's id
    unless it has no other. An empty table gives an empty result; other
    columns, whatever their names, are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    ids = scratch.cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = scratch.cut(ids.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(scratch, hamming_links(scratch, nodes, radius, bucket))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(least, "root").select("fp", "component_id")
    return ids.join(labels, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
