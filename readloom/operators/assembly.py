"""Reads laid out on contigs, contigs joined, and reads placed on references.

What can be told pair by pair is a join; what depends on the steps before, a
layout, a tiling or a draft, is folded within a connected component, a read or a
contig, each in one task.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written
from .align import banded
from .contigs import consensus, cover
from .graph import components
from .ordering import numbered
from .overlap import best_chains
from .sketch import PRESETS, seeds

#: K-mers of contigs; of a merge the indexed prefix, the probed
#: suffix, places of a k-mer, least overlap, and bases for each mismatch.
K, PREFIX, SUFFIX, FANOUT, MIN_OVERLAP, MISMATCH = 15, 64, 220, 16, 24, 8
#: Least score and candidates of a read in a layout; least overlap
#: of a tiling; least overlap of a read with a contig.
MIN_SCORE, CANDIDATES, TILE_OVERLAP, PLACE_OVERLAP = 200, 16, 2000, 16
_RC = str.maketrans("ACGTacgt", "TGCAtgca")


def revcomp(seq: str) -> str:
    return seq[::-1].translate(_RC)


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)


def _kmers(frame: DataFrame, first: Column, last: Column, k: int, step: int = 1) -> DataFrame:
    """(id, pos, kmer) of the k-mers of A, C, G and T that begin at first to last, from 0."""
    places = F.when(last >= first, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = frame.select("id", F.explode(places).alias("pos"), "seq").select("id", "pos", F.upper(F.substr("seq", F.col("pos") + 1, F.lit(k))).alias("kmer"))
    return rows.where(~F.regexp_like("kmer", F.lit("[^ACGT]")))


def successors(contigs: DataFrame, k: int = K, prefix: int = PREFIX, suffix: int = SUFFIX, fanout: int = FANOUT, min_overlap: int = MIN_OVERLAP, mismatch: int = MISMATCH) -> DataFrame:
    """(a, b, shift, overlap, mism): for each contig (id, seq) the one whose
    beginning its end overlaps best: the longest overlap, then fewest mismatches,
    then the smallest id and shift. The last ``suffix`` bases are looked up
    among the k-mers of the first ``prefix``, of which each keeps ``fanout``."""
    size = F.length("seq")
    heads = _kmers(contigs, F.lit(0), F.least(size, F.lit(prefix)) - k, k).withColumn("n", F.row_number().over(Window.partitionBy("kmer").orderBy("id", "pos"))).where(F.col("n") <= fanout)
    tails = _kmers(contigs, F.greatest(F.lit(0), size - suffix), size - k, k)
    met = tails.select(F.col("id").alias("a"), F.col("pos").alias("pa"), "kmer").join(heads.select(F.col("id").alias("b"), F.col("pos").alias("pb"), "kmer"), "kmer")
    pairs = met.where("a <> b AND pa > pb").select("a", "b", (F.col("pa") - F.col("pb")).alias("shift")).distinct()
    both = pairs.join(contigs.select(F.col("id").alias("a"), F.col("seq").alias("sa")), "a").join(contigs.select(F.col("id").alias("b"), F.col("seq").alias("sb")), "b")
    both = both.withColumn("overlap", F.length("sa") - F.col("shift")).where((F.col("overlap") >= min_overlap) & (F.col("overlap") <= F.length("sb")))
    scored = both.withColumn("mism", mismatches(F.substr("sa", F.col("shift") + 1, F.col("overlap")), F.substr("sb", F.lit(1), F.col("overlap"))))
    good = scored.where(F.col("mism") <= F.floor(F.col("overlap") / mismatch)).select("a", "b", "shift", "overlap", "mism")
    return good.groupBy("a").agg(F.min(F.struct((-F.col("overlap")).alias("o"), "mism", "b", "shift")).alias("m")).select("a", "m.b", "m.shift", (-F.col("m.o")).alias("overlap"), "m.mism")


def merged(contigs: DataFrame, found: DataFrame) -> DataFrame:
    """(id, super, offset): contigs chained by successors (a, b, shift). Edges
    are taken by rising a; one whose b has a forerunner, or that would close a
    circle, is left out. Chains are told within connected components, and a
    super-contig has the id of its first."""
    edges = found.select("a", "b", "shift")
    roots = components(edges.select("a", "b"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = x = parent.get(parent[x], parent[x])
            return x

        after, taken = {}, set()
        for a, b, shift in sorted(zip(frame["a"].tolist(), frame["b"].tolist(), frame["shift"].tolist(), strict=True)):
            if b not in taken and find(a) != find(b):
                after[a] = (b, shift)
                taken.add(b)
                parent[find(a)] = find(b)
        out = []
        for head in sorted(({*frame["a"]} | {*frame["b"]}) - taken):
            now, offset = head, 0
            out.append((now, head, 0))
            while now in after:
                now, shift = after[now]
                offset += shift
                out.append((now, head, offset))
        return pd.DataFrame(out, columns=["id", "super", "offset"])

    grouped = edges.join(roots, F.col("a") == F.col("node")).select("root", "a", "b", "shift")
    chains = grouped.groupBy("root").applyInPandas(run, "id long, super long, offset long")
    return contigs.select(F.col("id").cast("long").alias("id")).join(chains, "id", "left").select("id", F.coalesce("super", "id").alias("super"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))


def placements(reads: DataFrame, contigs: DataFrame, k: int = K) -> DataFrame:
    """Candidates (read, contig, off, overlap, mism, good): the places of a read
    (id, seq) on contigs (id, seq) that its k-mers, one behind another, point
    at; good if they overlap enough, with few mismatches against what is new."""
    size = F.length("seq")
    own = _kmers(reads, F.lit(0), size - k, k, k).select(F.col("id").alias("read"), F.col("pos").alias("p"), "kmer")
    there = _kmers(contigs, F.lit(0), size - k, k).select(F.col("id").alias("contig"), F.col("pos").alias("c"), "kmer")
    met = own.join(there, "kmer").where("c >= p").select("read", "contig", (F.col("c") - F.col("p")).alias("off")).distinct()
    both = met.join(reads.select(F.col("id").alias("read"), F.col("seq").alias("rs")), "read").join(contigs.select(F.col("id").alias("contig"), F.col("seq").alias("cs")), "contig")
    both = both.withColumn("overlap", F.least(F.length("cs") - F.col("off"), F.length("rs"))).where("overlap > 0")
    both = both.withColumn("mism", mismatches(F.substr("rs", F.lit(1), F.col("overlap")), F.substr("cs", F.col("off") + 1, F.col("overlap"))))
    enough = F.col("overlap") >= F.least(F.lit(PLACE_OVERLAP), F.length("rs"))
    good = enough & (F.col("mism") <= F.floor(F.col("overlap") / 4)) & (F.length("rs") - F.col("overlap") + 2 * F.col("mism") < F.length("rs"))
    return both.select("read", "contig", "off", "overlap", "mism", good.alias("good"), "rs", "cs")


#: Bases of contigs that a task holds with their k-mers, how many times so many are
#: gone through before a join is cheaper, and bases compared at a time.
PART, PASSES, COMPARED = 1 << 23, 16, 1 << 24
_NUMBER = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _NUMBER[[_b, _b + 32]] = _i


class Placer:
    """Contigs in memory, with the places of their k-mers of A, C, G and T."""

    def __init__(self, ids: list[int], seqs: list[str], k: int) -> None:
        self.k, self.ids, texts = k, np.array(ids, np.int64), [s.encode("latin-1") for s in seqs]
        self.starts = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        self.text = np.frombuffer(b"".join(texts), np.uint8)
        code, good = self._codes(self.text)
        of = np.repeat(np.arange(len(texts)), np.diff(self.starts))[: len(code)]
        at = np.flatnonzero(good & (np.arange(len(code)) + k <= self.starts[1:][of]))
        order = at[np.argsort(code[at], kind="stable")]
        self.at, self.of = order.astype(np.int32), of[order].astype(np.int32)
        self.code, first = np.unique(code[order], return_index=True)
        self.first, self.padded = np.append(first, len(order)), self.text

    def _codes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, n = _NUMBER[text], max(len(text) - self.k + 1, 0)
        out, odd = np.zeros(n, np.int64), np.concatenate(([0], np.cumsum(number > 3)))
        for j in range(self.k):
            out = out << 2 | number[j : j + n] & 3
        return out, odd[self.k :] == odd[:n] if n else np.empty(0, bool)

    def best(self, seq: str) -> tuple[int, int, int, int] | None:
        """(contig, off, overlap, mism) of the best good place of a read."""
        read, n = np.frombuffer(seq.encode("latin-1"), np.uint8), len(seq)
        code, good = self._codes(read)
        places, found = np.flatnonzero(good[:: self.k]) * self.k, []
        for p, c in zip(places.tolist(), code[places].tolist(), strict=True):
            i = int(np.searchsorted(self.code, c))
            if i < len(self.code) and self.code[i] == c:
                at, of = self.at[self.first[i] : self.first[i + 1]], self.of[self.first[i] : self.first[i + 1]]
                fits = at - p >= self.starts[of]
                found.append((at[fits].astype(np.int64) - p) << 32 | of[fits])
        if not found:
            return None
        met = np.unique(np.concatenate(found))
        begin, of = met >> 32, met & 0xFFFFFFFF
        overlap = np.minimum(self.starts[of + 1] - begin, n)
        enough = overlap >= min(PLACE_OVERLAP, n)
        begin, of, overlap = begin[enough], of[enough], overlap[enough]
        if len(self.padded) < len(self.text) + n:
            self.padded = np.concatenate((self.text, np.zeros(n, np.uint8)))
        windows, mism, step = np.lib.stride_tricks.sliding_window_view(self.padded, n), np.empty(len(begin), np.int64), max(1, COMPARED // n)
        for i in range(0, len(begin), step):
            unlike = (windows[begin[i : i + step]] != read) & (np.arange(n) < overlap[i : i + step, None])
            mism[i : i + step] = np.count_nonzero(unlike, axis=1)
        good = np.flatnonzero((mism <= overlap // 4) & (2 * mism < overlap))
        if not len(good):
            return None
        off = begin - self.starts[of]
        i = good[np.lexsort((off[good], -self.ids[of[good]], mism[good]))[0]]
        return int(self.ids[of[i]]), int(off[i]), int(overlap[i]), int(mism[i])


_PLACED = "seq string, contig long, off int, overlap int, mism int"


def _placed_texts(texts: DataFrame, contigs: DataFrame, k: int) -> DataFrame:
    """Best places of texts among contigs that fit in a task's memory."""
    table = contigs.select("id", "seq").where("seq IS NOT NULL").toArrow()
    held = texts.sparkSession.sparkContext.broadcast(Placer(table.column("id").to_pylist(), table.column("seq").to_pylist(), k))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(s, *m) for s in frame["seq"] if (m := held.value.best(s))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _PLACED.split(", ")])

    return texts.mapInPandas(run, _PLACED)


def placed(reads: DataFrame, contigs: DataFrame, k: int = K) -> DataFrame:
    """(read, contig, off, overlap, mism): the best place of each read that has
    a good one: fewest mismatches, then the latest contig, then the first place.
    Equal reads are placed once; contigs are held in memory, part by part."""
    place = F.min(F.struct("mism", (-F.col("contig")).alias("c"), "off", "overlap")).alias("m")
    fields = [(-F.col("m.c")).alias("contig"), "m.off", "m.overlap", "m.mism"]
    n = -(-(contigs.agg(F.sum(F.length("seq"))).first()[0] or 0) // PART)
    if n > PASSES:
        best = placements(reads, contigs, k).where("good").groupBy("read").agg(place)
        return best.select("read", *fields)
    spark = reads.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    reads = written(reads.select("id", "seq"))  # else filters on seq go below what spreads the reads, and it is made anew
    texts = written(reads.select("seq").where("seq IS NOT NULL AND seq <> ''").repartition(tasks, "seq").distinct())
    cuts = sorted(set(contigs.approxQuantile("id", [i / n for i in range(1, n)], 0.001))) if n > 1 else []
    parts = [contigs.where((F.col("id") >= low if low is not None else F.lit(True)) & (F.col("id") < high if high is not None else F.lit(True))) for low, high in zip([None, *cuts], [*cuts, None], strict=True)]
    found = reduce(DataFrame.unionByName, [_placed_texts(texts, part, k) for part in parts])
    if len(parts) > 1:
        found = found.groupBy("seq").agg(place).select("seq", *fields)
    return reads.select(F.col("id").alias("read"), "seq").join(found, "seq").select("read", "contig", "off", "overlap", "mism")


def referenced(reads: DataFrame, contigs: DataFrame, k: int = K) -> DataFrame:
    """(id, contig, off, overlap, flip, edits, tail): reads (id, seq) as what differs from
    the contig (id, seq) that they, or their reverse complements, are best placed
    on, and what reaches beyond it; a read without a good place has no contig
    and is its tail. edits: (place, base)."""
    both = reads.select(F.col("id"), F.lit(False).alias("flip"), "seq").unionByName(reads.select("id", F.lit(True).alias("flip"), F.reverse(F.translate("seq", "ACGTacgt", "TGCAtgca")).alias("seq")))
    keyed = both.select(F.struct("id", "flip").alias("id"), "seq")
    best = placed(keyed, contigs, k).select(F.col("read.id").alias("id"), F.col("read.flip").alias("flip"), "contig", "off", "overlap", "mism")
    best = best.groupBy("id").agg(F.min(F.struct("mism", (-F.col("overlap")).alias("o"), "flip", "contig", "off")).alias("m"))
    best = best.select("id", "m.flip", "m.contig", "m.off", (-F.col("m.o")).alias("overlap"))
    rows = both.join(best, ["id", "flip"]).join(contigs.select(F.col("id").alias("contig"), F.col("seq").alias("cs")), "contig")
    unlike = F.zip_with(F.split(F.substr("seq", F.lit(1), F.col("overlap")), ""), F.split(F.substr("cs", F.col("off") + 1, F.col("overlap")), ""), lambda x, y: F.when(x != y, x))
    edits = F.filter(F.transform(unlike, lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("place"), x.alias("base")))), lambda e: e.isNotNull())
    good = rows.select("id", F.col("contig").cast("long").alias("contig"), F.col("off").cast("int").alias("off"), F.col("overlap").cast("int").alias("overlap"), "flip", edits.alias("edits"), F.substr("seq", F.col("overlap") + 1).alias("tail"))
    none = F.array().cast("array<struct<place:int,base:string>>")
    rest = reads.join(best.select("id"), "id", "left_anti").select("id", F.lit(None).cast("long").alias("contig"), F.lit(None).cast("int").alias("off"), F.lit(None).cast("int").alias("overlap"), F.lit(False).alias("flip"), none.alias("edits"), F.col("seq").alias("tail"))
    return good.unionByName(rest)


def restored(coded: DataFrame, contigs: DataFrame) -> DataFrame:
    """(id, seq) of reads as :func:`referenced` has them, against the same contigs."""
    rows = coded.join(contigs.select(F.col("id").alias("contig"), F.col("seq").alias("cs")), "contig", "left")
    there = F.substr("cs", F.col("off") + 1, F.col("overlap"))
    copied = F.aggregate("edits", F.coalesce(there, F.lit("")), lambda s, e: F.overlay(s, e["base"], e["place"] + 1, F.lit(1)))
    whole = F.concat(copied, "tail")
    return rows.select("id", F.when(F.col("flip"), F.reverse(F.translate(whole, "ACGTacgt", "TGCAtgca"))).otherwise(whole).alias("seq"))


def clustered(plan: DataFrame) -> DataFrame:
    """(pos, read_id, flip, oriented): reads of a cluster plan in the order of
    their least k-mers, in which neighbours overlap."""
    rows = numbered(plan, F.col("canon").isNull(), "canon", F.desc("anchor"), "oriented", "read_id")
    return rows.select("pos", "read_id", "flip", "oriented")


def unclustered(rows: DataFrame) -> DataFrame:
    """(read_id, seq) of reads as :func:`clustered` has them."""
    turned = F.reverse(F.translate("oriented", "ACGTacgt", "TGCAtgca"))
    return rows.select("read_id", F.when(F.col("flip") == 1, turned).otherwise(F.col("oriented")).alias("seq"))


def gapped(ref: str, read: str) -> tuple[int, int]:
    """(edits, indels) of a read that begins where ref does and may end anywhere
    in it: fewest edits, then fewest indels."""
    wide = len(read) + 1
    a, b = np.frombuffer(ref.encode("latin-1"), np.uint8), np.frombuffer(read.encode("latin-1"), np.uint8)
    unit = 1 << 20  # an edit in one number with the indels
    row = np.arange(wide) * (unit + 1)
    best, steps = row[-1], np.arange(wide) * (unit + 1)
    for x in a:
        new = np.empty_like(row)
        new[0] = row[0] + unit + 1
        new[1:] = np.minimum(row[:-1] + (b != x) * unit, row[1:] + unit + 1)
        row = np.minimum.accumulate(new - steps) + steps  # bases that are in the read only
        best = min(best, row[-1])
    return int(best // unit), int(best % unit)


def indel_probe(reads: DataFrame, contigs: DataFrame, band: int = 8, k: int = K) -> DataFrame:
    """One row: reads, literals (without a good place), rescuable (those that a
    gapped comparison would place within a quarter of their bases as edits, with
    an indel), novel (the other literals), and the bases of both."""

    @F.pandas_udf("boolean")
    def rescued(rs: pd.Series, cs: pd.Series, off: pd.Series) -> pd.Series:
        out = []
        for read, contig, at in zip(rs, cs, off, strict=True):
            edits, indels = gapped(contig[at : at + len(read) + band], read)
            out.append(edits <= len(read) // 4 and indels > 0)
        return pd.Series(out, dtype=bool)

    found = placements(reads, contigs, k)
    good = found.where("good").select("read").distinct()
    tried = found.join(good, "read", "left_anti").where(rescued("rs", "cs", "off")).select(F.col("read").alias("id")).distinct().withColumn("rescued", F.lit(True))
    left = reads.join(good.withColumnRenamed("read", "id"), "id", "left_anti").join(tried, "id", "left")
    total = reads.agg(F.count("*").alias("reads"))
    tally = left.agg(F.count("*").alias("literals"), F.count("rescued").alias("rescuable"), F.coalesce(F.sum(F.when(F.col("rescued"), F.length("seq"))), F.lit(0)).alias("rescuable_bases"), F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("literal_bases"))
    return total.crossJoin(tally).withColumn("novel", F.col("literals") - F.col("rescuable"))  # one row each


def candidates(overlaps: DataFrame, min_score: int = MIN_SCORE, most: int = CANDIDATES) -> DataFrame:
    """The first ``most`` overlaps of each read that reach a score, best first."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), "t", "q_start", "same")
    return overlaps.where(F.col("score") >= min_score).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


_LAYOUT = "contig long, read long, offset long, flip boolean, contig_len long"


def layout(reads: DataFrame, overlaps: DataFrame, min_score: int = MIN_SCORE, most: int = CANDIDATES) -> DataFrame:
    """(contig, read, offset, flip, contig_len): every read (read_id, seq) on one
    contig, which has the id of the read that it grew from. Reads with most
    trusted overlaps are seeds first, then the smallest id; a contig grows from
    the read placed last. A read without overlaps is a contig of its own. The
    candidates of connected reads are folded in one task, as each placement
    depends on those before."""
    lens = reads.select(F.col("read_id").alias("q"), F.length("seq").cast("long").alias("len"))
    degree = overlaps.where(F.col("score") >= min_score).groupBy("q").agg(F.count("*").alias("degree"))
    edges = candidates(overlaps, min_score, most).select("q", "t", "same", "place", "q_start", "t_start")
    roots = components(edges.select(F.col("q").alias("a"), F.col("t").alias("b")))
    nodes = roots.join(lens, F.col("node") == F.col("q")).join(degree, "q", "left").select("root", "q", "len", F.coalesce("degree", F.lit(0)).alias("degree"))
    out_of = edges.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "t", "same", "q_start", "t_start"))).alias("out"))  # ``most`` at most

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        size = dict(zip(frame["q"].tolist(), frame["len"].tolist(), strict=True))
        out = {q: (o if o is not None else []) for q, o in zip(frame["q"].tolist(), frame["out"], strict=True)}
        place: dict[int, tuple[int, int, bool]] = {}
        for _, seed in sorted((-d, q) for d, q in zip(frame["degree"].tolist(), frame["q"].tolist(), strict=True)):
            if seed in place:
                continue
            place[seed], stack = (seed, 0, False), [seed]
            while stack:
                now = stack.pop()
                _, at, turned = place[now]
                for o in out[now]:
                    t, qs, ts = int(o["t"]), int(o["q_start"]), int(o["t_start"])
                    if t in place:
                        continue
                    ahead = at + qs - ts if not turned else at + (size[now] - 1 - qs) - (size[t] - 1 - ts)
                    place[t] = (seed, ahead, turned != (not o["same"]))
                    stack.append(t)
        rows = pd.DataFrame([(c, r, at, turned, at + size[r]) for r, (c, at, turned) in place.items()], columns=["contig", "read", "offset", "flip", "end"])
        first = rows.groupby("contig")["offset"].transform("min")
        rows["offset"], rows["contig_len"] = rows["offset"] - first, rows.groupby("contig")["end"].transform("max") - first
        return rows[["contig", "read", "offset", "flip", "contig_len"]]

    laid = nodes.join(out_of, "q", "left").groupBy("root").applyInPandas(run, _LAYOUT)
    alone = lens.join(roots.select(F.col("node").alias("q")), "q", "left_anti").select(F.col("q").alias("contig"), F.col("q").alias("read"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("flip"), F.col("len").alias("contig_len"))
    return laid.unionByName(alone)


def tilings(laid: DataFrame, lens: DataFrame, overlap: int = TILE_OVERLAP) -> DataFrame:
    """(contig, nth, read, offset, end): reads that span each contig of a layout,
    by greedy cover. lens: (read, len)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["offset", "read"], ignore_index=True)
        picked = cover(list(zip(frame["offset"].tolist(), frame["end"].tolist(), strict=True)), overlap)
        out = frame.iloc[picked].copy()
        out["nth"] = range(len(out))
        return out[["contig", "nth", "read", "offset", "end"]]

    rows = laid.join(lens, "read").select("contig", "read", "offset", (F.col("offset") + F.col("len")).alias("end"))
    return rows.groupBy("contig").applyInPandas(run, "contig long, nth long, read long, offset long, end long")


def _shift(draft: str, read: str, want: int, reach: int, k: int = 13) -> int:
    """Where a read begins on a draft: the diagonal that most of their equal
    k-mers lie on within reach of where it is wanted, else just there."""
    low = max(0, want - reach)
    there: dict[str, list[int]] = {}
    for i in range(low, len(draft) - k + 1):
        there.setdefault(draft[i : i + k], []).append(i)
    votes = Counter(i - j for j in range(len(read) - k + 1) for i in there.get(read[j : j + k], ()) if abs(i - j - want) <= reach)
    return max(votes, key=lambda d: (votes[d], -abs(d - want))) if votes else want


def consensi(laid: DataFrame, reads: DataFrame, overlap: int = TILE_OVERLAP, reach: int = 64, band: int = 32, min_votes: int = 3) -> DataFrame:
    """(contig, draft, consensus, reads): a draft for each contig of a layout,
    reads of its tiling spliced where they fit best, under the votes of all its
    reads, aligned to it within a band. A contig is folded in one task."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["offset", "read"], ignore_index=True)
        offsets, texts = frame["offset"].tolist(), [revcomp(s) if f else s for s, f in zip(frame["seq"], frame["flip"], strict=True)]
        picked = cover([(o, o + len(s)) for o, s in zip(offsets, texts, strict=True)], overlap)
        draft, moved = "", 0  # moved: how far the draft has come off the layout
        for i in picked:
            at = _shift(draft, texts[i], offsets[i] + moved, reach) if draft else 0
            at = max(0, min(at, len(draft)))
            moved = at - offsets[i]
            if at + len(texts[i]) > len(draft):
                draft += texts[i][len(draft) - at :]
        votes: list[list[str]] = [[] for _ in draft]
        for o, text in zip(offsets, texts, strict=True):
            at = max(0, min(_shift(draft, text, o, 2 * reach), len(draft)))
            window, place, j = draft[at : at + len(text)], at, 0
            for op, n in banded(window, text, band):
                size = n if isinstance(n, int) else len(n)
                if op in "=X":
                    for b in text[j : j + size]:
                        votes[place].append(b)
                        place += 1
                elif op == "D":
                    for _ in range(size):
                        votes[place].append("-")
                        place += 1
                j += size if op != "D" else 0
        return pd.DataFrame({"contig": [frame["contig"][0]], "draft": [draft], "consensus": [consensus(draft, votes, min_votes)], "reads": [len(frame)]})

    rows = laid.join(reads.select(F.col("read_id").alias("read"), "seq"), "read")
    return rows.groupBy("contig").applyInPandas(run, "contig long, draft string, consensus string, reads long")


def best_reference(reads: DataFrame, references: DataFrame, preset: str = "hifi") -> DataFrame:
    """(read, reference, offset, flip, score, drift): for each read (read_id,
    seq) the reference of the same columns that its best chain is with: the
    highest score, then the smallest reference and start. offset: where the
    read, turned if flip, begins; drift: by how much the chain's ends are off
    one diagonal. No seed of a reference is filtered."""
    k = PRESETS[preset][1]
    index = written(seeds(references, preset).withColumn("read_id", -1 - F.col("read_id")))  # never a read's own id
    best = best_chains(seeds(reads, preset), index, k, 1, last=True).drop("rank")
    best = best.withColumn("ref", -1 - F.col("t")).join(references.select(F.col("read_id").alias("ref"), F.length("seq").alias("rlen")), "ref").join(reads.select(F.col("read_id").alias("q"), F.length("seq").alias("len")), "q")
    straight = F.col("t_start") - F.col("q_start")
    offset = F.greatest(F.lit(0), F.when(F.col("same"), straight).otherwise(F.col("rlen") - straight - F.col("len")))
    drift = F.abs((F.col("t_end") - F.col("q_end")) - straight)
    return best.select(F.col("q").alias("read"), F.col("ref").alias("reference"), offset.cast("long").alias("offset"), (~F.col("same")).alias("flip"), "score", drift.alias("drift"))


def tiles(overlaps: DataFrame, reads: DataFrame) -> DataFrame:
    """(read, start, end, target, same): each read cut into stretches that an
    overlap with an earlier read covers and literals (target null). Where one
    begins the overlap that reaches furthest is taken, then the one that begins
    first, of the smallest target, on the same strand."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for read, size, found in zip(frame["read"].tolist(), frame["len"].tolist(), frame["found"], strict=True):
                spans = [(int(o["q_start"]), int(o["q_end"]), int(o["t"]), bool(o["same"])) for o in (found if found is not None else [])]
                at = 0
                while at < size:
                    over = [o for o in spans if o[0] <= at < o[1]]
                    if over:
                        _, end, target, same = min(over, key=lambda o: (-o[1], o[0], o[2], not o[3]))
                        end = min(end, size)
                        out.append((read, at, end, target, same))
                    else:
                        end = min([o[0] for o in spans if o[0] > at] + [size])
                        out.append((read, at, end, None, None))
                    at = end
            yield pd.DataFrame(out, columns=["read", "start", "end", "target", "same"]).astype({"target": "Int64", "same": "boolean"})

    earlier = overlaps.where("t < q").groupBy("q").agg(F.collect_list(F.struct("q_start", "q_end", "t", "same")).alias("found"))  # overlaps of a read are ranked and capped
    rows = reads.select(F.col("read_id").alias("read"), F.length("seq").cast("long").alias("len")).join(earlier, F.col("read") == F.col("q"), "left").select("read", "len", "found")
    return rows.mapInPandas(run, "read long, start long, end long, target long, same boolean")
