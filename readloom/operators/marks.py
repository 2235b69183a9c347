"""Window minimizers under md5, and what reads share through an index of them.

A read's minimizers are one row with a list of numbers: from the top a canonical
15-mer of two bits a base, its place and a bit for the strand. Its md5, which orders and names it, is taken once for each
different 15-mer of a batch, and again only for rows that are returned."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.batches import flat, pieces

#: K-mers, k-mers a window, distinct hashes for each that is dropped
#: as frequent, and occurrences kept of a hash.
K, WINDOW, REPEATS, FANOUT = 15, 10, 5000, 512
#: Entries of an index that a task holds, how many times so many are gone through
#: one after another before a join is cheaper, and pairs formed at a time.
PART, PASSES, PAIRS = 1 << 22, 16, 1 << 20
LISTS = "read_id bigint, mark array<bigint>"
_SHIFT, _PLACES = 33, (1 << 32) - 1
#: SQL of the md5 of the 15-mer that a code stands for.
HASH = f"md5(translate(lpad(conv(CAST(code AS STRING), 10, 4), {K}, '0'), '0123', 'ACGT'))"
_CODE = np.full(256, 5, np.uint8)
_CODE[list(b"ACGTN")] = range(5)
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def _ranks(codes: np.ndarray) -> np.ndarray:
    """The place of each k-mer's md5 among those of all, equal ones alike."""
    each, where = np.unique(codes, return_inverse=True)
    texts = _LETTERS[each[:, None] >> (2 * np.arange(K)[::-1]) & 3].tobytes()
    digests = np.frombuffer(b"".join(hashlib.md5(texts[at : at + K]).digest() for at in range(0, len(texts), K)), ">u8").reshape(-1, 2)
    rank = np.empty(len(each), np.int64)
    rank[np.lexsort((digests[:, 1], digests[:, 0]))] = np.arange(len(each))
    return rank[where]


def found(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(read, code, pos, forward) of the minimizers of joined reads of A, C, G, T
    and N: of ten k-mers in a row without N the one with the least md5, of equal
    ones the last. pos is from 1; windows end at the tenth place or later, and
    one with the md5 of the one before is left out."""
    base = _CODE[data].astype(np.int64)
    if (base == 5).any():
        raise ValueError("bases other than A, C, G, T and N")
    n = max(len(base) - K + 1, 0)
    forward, reverse, two = np.zeros(n, np.int64), np.zeros(n, np.int64), base & 3
    for j in range(K):
        forward = forward << 2 | two[j : j + n]
        reverse |= (3 - two[j : j + n]) << 2 * j
    odd = np.concatenate(([0], np.cumsum(base > 3)))
    read = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    at = np.flatnonzero((odd[K:] == odd[: n]) & (np.arange(n) + K <= offsets[1:][read])) if n else np.empty(0, np.int64)
    read, forward, code = read[at], forward[at] <= reverse[at], np.minimum(forward[at], reverse[at])
    place, rank, here = at - offsets[read] + 1, _ranks(code) if len(code) else code, np.arange(len(at))
    least, best = rank.copy(), here.copy()
    for d in range(1, min(WINDOW, len(at))):
        less = (read[d:] == read[:-d]) & (rank[:-d] < least[d:])
        least[d:][less], best[d:][less] = rank[:-d][less], here[:-d][less]
    late = np.flatnonzero(place >= WINDOW)
    new = np.ones(len(late), bool)
    new[1:] = (read[late[1:]] != read[late[:-1]]) | (least[late[1:]] != least[late[:-1]])
    out = best[late[new]]
    return read[out], code[out], place[out], forward[out]


def marks(reads: DataFrame) -> DataFrame:
    """(read_id, mark): the minimizers of every read (read_id, seq) that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                read, code, pos, forward = found(*flat(part.column(0)))
                ids, sizes = np.unique(read, return_counts=True)
                stops = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                some = pa.ListArray.from_arrays(stops, pa.array(code << _SHIFT | pos << 1 | forward))
                yield pa.RecordBatch.from_arrays([part.column(1).take(pa.array(ids)), some], names=["read_id", "mark"])

    return reads.select("seq", F.col("read_id").cast("long").alias("read_id")).mapInArrow(run, LISTS)


def rows(lists: DataFrame) -> DataFrame:
    """(read_id, code, pos, forward): a row per minimizer."""
    each = lists.select("read_id", F.explode("mark").alias("mark"))
    return each.selectExpr("read_id", f"shiftright(mark, {_SHIFT}) AS code", f"shiftright(mark, 1) & {_PLACES} AS pos", "mark & 1 = 1 AS forward")


def counts(lists: DataFrame) -> DataFrame:
    """(code, n)."""
    return rows(lists).groupBy("code").agg(F.count("*").alias("n"))


def usual(number: DataFrame) -> DataFrame:
    """counts without the REPEATS-th part of all hashes, rounded down, that is
    most frequent, of equally frequent ones the smallest; they are told by a
    histogram of the counts, and only the rows of one count are put in order."""
    room = number.count() // REPEATS
    if not room:
        return number
    before, lowest, left = 0, 0, 0
    for r in number.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).toLocalIterator():
        lowest, left = r.n, room - before
        before += r.c
        if before >= room:
            break
    tied = number.where(F.col("n") == lowest).orderBy(F.expr(HASH)).limit(left).select("code")
    return number.where(F.col("n") <= lowest).join(tied, "code", "left_anti")


def entries(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """The minimizers of the hashes kept (code, n): of each every
    ceil(n / FANOUT)-th occurrence, by read and place."""
    all_of = rows(lists).join(kept, "code").withColumn("step", F.ceil(F.col("n") / FANOUT))
    dense = all_of.where("step > 1").withColumn("rn", F.row_number().over(Window.partitionBy("code").orderBy("read_id", "pos")))
    return all_of.where("step = 1").unionByName(dense.where("(rn - 1) % step = 0").drop("rn")).drop("n", "step")


class Index:
    """Entries in memory: hashes rising, and of each its entries by read and place;
    length, where the table has it, of the read of an entry."""

    def __init__(self, table: pa.Table) -> None:
        code, read, pos, forward = (table.column(c).to_numpy() for c in ("code", "read_id", "pos", "forward"))
        order = np.lexsort((pos, read, code))
        self.read, self.pos, self.forward = read[order], pos[order], forward[order]
        self.code, first = np.unique(code[order], return_index=True)
        self.first = np.append(first, len(order))
        self.length = table.column("length").to_numpy()[order] if "length" in table.column_names else None
        self.reads, self.rank = np.unique(self.read, return_inverse=True)

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of codes, which entry) of all equal pairs."""
        if not len(self.code):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.code, codes), len(self.code) - 1)
        size = np.where(self.code[at] == codes, self.first[at + 1] - self.first[at], 0)
        which = np.repeat(np.arange(len(codes)), size)
        return which, np.arange(len(which)) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)


def index_parts(index: DataFrame) -> list[DataFrame] | None:
    """The index by rising reads, in parts of about PART entries; None if there
    would be more than PASSES of them."""
    n = -(-index.count() // PART)
    if n > PASSES:
        return None
    cuts = sorted(set(index.approxQuantile("read_id", [i / n for i in range(1, n)], 0.001))) if n > 1 else []
    at = F.col("read_id")
    return [index.where((at >= low if low is not None else F.lit(True)) & (at < high if high is not None else F.lit(True))) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]


def united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def met(lists: DataFrame, part: DataFrame, of: Callable[[Index, np.ndarray], Callable], schema: str) -> DataFrame:
    """Reads against a part of an index. Reads whose lists are equal come one
    behind another, and ``of`` is asked once for them: it gets the index and the
    list and gives what tells the columns of schema for a read's number."""
    held = lists.sparkSession.sparkContext.broadcast(Index(part.toArrow()))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, key, own, out, size = held.value, None, None, [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            stops, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            for i, read in enumerate(ids.tolist()):
                now = values[stops[i] : stops[i + 1]]
                if key is None or not np.array_equal(now, key):
                    key, own = now, of(index, now)
                got = own(read)
                out.append(got)
                size += len(got[0])
                if size >= PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                    out, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    dealt = lists.select("read_id", "mark").withColumn("_alike", F.xxhash64("mark"))  # by ranges, so that a great many equal reads are in several tasks
    spark = lists.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)  # the output is much larger than the lists
    return dealt.repartitionByRange(tasks, "_alike", "read_id").sortWithinPartitions("_alike", "read_id").drop("_alike").mapInArrow(run, schema)


def shared(lists: DataFrame, index: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """(q, t, n): how many pairs of a minimizer of read q and an entry of read t
    are equal, if there are ``least``; with ``most`` so many at most of a q, those
    with the largest n and then the smallest t, and their place from 1. Reads with
    the same minimizers are counted once and told apart by themselves only."""

    def of(index: Index, code: np.ndarray) -> Callable:
        entry = index.of(code)[1]
        if 8 * len(entry) < len(index.reads):
            t, n = np.unique(index.read[entry], return_counts=True)
            t, n = t[n >= least], n[n >= least]
        else:  # a place for every read is filled sooner than entries are sorted
            n = np.bincount(index.rank[entry], minlength=len(index.reads))
            at = np.flatnonzero(n >= max(least, 1))
            t, n = index.reads[at], n[at]
        if most is not None:
            order = np.lexsort((t, -n))[: most + 1]  # one more, as the read itself may be among them
            t, n = t[order], n[order]

        def own(read: int) -> tuple[np.ndarray, ...]:
            at = np.flatnonzero(t == read)
            a, b = (np.delete(t, at), np.delete(n, at)) if len(at) else (t, n)
            a, b = a[:most], b[:most]
            both = np.full(len(a), read, np.int64), a, b
            return both if most is None else (*both, np.arange(1, len(a) + 1))

        return own

    parts = index_parts(index)
    if parts is None:
        pairs = rows(lists).select(F.col("read_id").alias("q"), "code").join(index.select(F.col("read_id").alias("t"), "code"), "code").where("q <> t")
        out = pairs.groupBy("q", "t").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    else:
        codes = lists.select("read_id", F.sort_array(F.expr(f"transform(mark, m -> shiftright(m, {_SHIFT}))")).alias("mark"))  # equal wherever they are
        schema = "q bigint, t bigint, n bigint" + (", place bigint" if most is not None else "")
        out = [met(codes, part, of, schema) for part in parts]
        if len(out) == 1:
            return out[0]
        out = united(out).drop("place")
    if most is None:
        return out
    return out.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("n"), "t")).cast("long")).where(F.col("place") <= most)


def ordered_anchors(lists: DataFrame, index: DataFrame) -> DataFrame:
    """(q, anchors, order_digest): the equal pairs of minimizers of a read and of
    entries of other reads, in the order of target, strand, place there and place
    here, as the sum of places in that order times 1000 tpos + qpos."""

    def of(index: Index, mark: np.ndarray) -> Callable:
        pos, forward = mark >> 1 & _PLACES, mark & 1 == 1
        which, entry = index.of(mark >> _SHIFT)
        t, same, tpos, qpos = index.read[entry], index.forward[entry] == forward[which], index.pos[entry], pos[which]
        order = np.lexsort((qpos, tpos, same, t))
        t, value = t[order], (1000 * tpos + qpos)[order]
        sums = np.concatenate(([0], np.cumsum(value)))
        digests = np.concatenate(([0], np.cumsum(value * np.arange(1, len(value) + 1))))

        def own(read: int) -> tuple[np.ndarray, ...]:
            low, high = np.searchsorted(t, [read, read + 1])  # what is the read's own goes, and the rest moves up
            n, rest = len(t) - (high - low), sums[-1] - sums[high]
            digest = digests[low] + digests[-1] - digests[high] - (high - low) * rest
            return tuple(np.array([x] if n else [], np.int64) for x in (read, n, digest, sums[low] + rest))

        return own

    parts = index_parts(index)
    if parts is None:
        a = rows(lists).select(F.col("read_id").alias("q"), "code", F.col("pos").alias("qpos"), F.col("forward").alias("qf"))
        pairs = a.join(index.select(F.col("read_id").alias("t"), "code", F.col("pos").alias("tpos"), "forward"), "code").where("q <> t")
        order = Window.partitionBy("q").orderBy("t", F.col("qf") == F.col("forward"), "tpos", "qpos")
        return pairs.withColumn("rn", F.row_number().over(order)).groupBy("q").agg(F.count("*").alias("anchors"), F.sum(F.expr("rn * (tpos * 1000 + qpos)")).alias("order_digest"))
    out = [met(lists, part, of, "q bigint, anchors bigint, order_digest bigint, total bigint") for part in parts]
    if len(out) == 1:
        return out[0].drop("total")
    whole = united([o.withColumn("part", F.lit(i)) for i, o in enumerate(out)])
    before = F.coalesce(F.sum("anchors").over(Window.partitionBy("q").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return whole.withColumn("before", before).groupBy("q").agg(F.sum("anchors").alias("anchors"), F.sum(F.col("order_digest") + F.col("before") * F.col("total")).alias("order_digest"))
