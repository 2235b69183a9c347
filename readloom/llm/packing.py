"""Conflict-constrained best-fit packing.

Documents are cut into pieces of a bin's capacity at most and dealt by a hash
of their ids into groups of some thousand documents, as many as the corpus
needs; each group is packed by itself, largest pieces first. Open bins are
kept by residual; each carries a bitmap of the sources and one of the
duplicate clusters in it. The search starts at the residual that fits exactly
and goes on to the next larger until it finds a bin that shares neither a
source nor a cluster with the piece: the tightest compatible bin. Within a
residual, bins with equal source bitmaps are passed over together.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .line_quality import word_array

CAPACITY = 2048
#: Documents of a group, on average.
GROUP_DOCS = 4096
#: Times GROUP_DOCS from which on a group, that is rows of equal id and text, is
#: dealt out again by the rows' places in the table.
HOT = 4
_SPAN = 1 << 32


class Bins:
    """The open bins of a group."""

    def __init__(self) -> None:
        self.residuals: list[int] = []
        self.at: dict[int, dict[int, list[tuple[int, int]]]] = {}  # residual: source bitmap: (bin, cluster bitmap), by bin
        self.count = 0

    def place(self, size: int, sources: int, clusters: int, capacity: int) -> tuple[int, int]:
        """(bin, tokens already in it). Ties go to the bin opened first."""
        for i in range(bisect_left(self.residuals, size), len(self.residuals)):
            residual, best = self.residuals[i], None
            for have, bins in self.at[residual].items():
                if not have & sources:
                    found = next(((b, have, c) for b, c in bins if not c & clusters), None)
                    if found and (best is None or found[0] < best[0]):
                        best = found
            if best:
                b, have, c = best
                bins = self.at[residual][have]
                bins.remove((b, c))
                if not bins:
                    del self.at[residual][have]
                if not self.at[residual]:
                    del self.at[residual], self.residuals[i]
                self._put(b, residual - size, have | sources, c | clusters)
                return b, capacity - residual
        b, self.count = self.count, self.count + 1
        self._put(b, capacity - size, sources, clusters)
        return b, 0

    def _put(self, b: int, residual: int, sources: int, clusters: int) -> None:
        if not residual:
            return
        if residual not in self.at:
            insort(self.residuals, residual)
            self.at[residual] = {}
        insort(self.at[residual].setdefault(sources, []), (b, clusters))


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece, in the order given. A bitmap has bits only
    for sources and clusters that a second piece of the group has too; None
    conflicts with nothing."""

    def bits(values: list) -> list[int]:
        seen, names = set(), {}
        for v in values:
            if v is not None:
                if v in seen:
                    names.setdefault(v, len(names))
                seen.add(v)
        return [1 << names[v] if v in names else 0 for v in values]

    bins = Bins()
    return [bins.place(n, s, c, capacity) for n, s, c in zip(sizes, bits(sources), bits(clusters), strict=True)]


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """A row per piece: id_col, piece, start, n_tokens, bin_id, bin_offset.

    Tokens are words; piece k holds the words from start = k * capacity on.
    cluster_col names duplicate clusters; None: texts equal in lower case.
    Pieces of a document conflict with one another by its source and cluster.
    A document without words has one piece of no tokens and a null bin. A null
    source or text conflicts with none. Repeated ids keep their rows; rows that
    are equal in id and text are of one group, or of several if they are many.
    Texts of any length are cut into pieces. An empty table gives an empty
    result; other columns are not looked at.
    """
    text = F.col(text_col)
    cluster = F.xxhash64(F.lower(text)) if cluster_col is None else F.xxhash64(cluster_col)
    scratch, groups = Scratch(docs.sparkSession), max(1, -(-docs.count() // group_docs))
    rows = scratch.cut(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.when(text.isNotNull(), cluster).alias("cluster"), F.size(word_array(text)).alias("n"),
        F.pmod(F.xxhash64(F.lit(5), id_col, text_col), F.lit(groups)).alias("grp"), F.monotonically_increasing_id().alias("place"),
    ))
    hot = {r.grp: -(-r["count"] // group_docs) for r in rows.groupBy("grp").count().where(F.col("count") > HOT * group_docs).collect()}
    if hot:  # of N documents there are N / (HOT * group_docs) such groups at most
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in hot.items() for x in kv]), F.col("grp")), F.lit(1))
        rows = rows.withColumn("grp", F.col("grp") + F.pmod(F.xxhash64("place"), parts) * groups)
    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)).cast("int"))
    rows = rows.select("grp", "id", "source", "cluster", F.explode(pieces).alias("piece"), "n")
    rows = rows.select("grp", "id", "source", "cluster", "piece", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).alias("n"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, piece int, start bigint, n_tokens int, bin_id bigint, bin_offset int"

    def solve(part: pa.Table) -> Iterator[pa.RecordBatch]:
        n = part.column("n").to_numpy()
        whole = part.filter(pa.array(n > 0))
        found = pack_group(whole.column("n").to_pylist(), whole.column("source").to_pylist(), whole.column("cluster").to_pylist(), capacity)
        bins, offsets = np.full(len(n), -1, np.int64), np.full(len(n), -1, np.int32)
        bins[n > 0], offsets[n > 0] = [b for b, _ in found], [o for _, o in found]
        piece = part.column("piece").to_numpy()
        out = [
            part.column("id"), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(n),
            pa.array(part.column("grp").to_numpy() * _SPAN + bins, mask=bins < 0), pa.array(offsets, mask=bins < 0),
        ]
        yield from pa.table(out, names=["id", "piece", "start", "n_tokens", "bin_id", "bin_offset"]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            cuts = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and held[-1].column("grp")[-1].as_py() != int(grp[a]):
                    yield from solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from solve(pa.Table.from_batches(held))

    dealt = rows.repartition("grp").sortWithinPartitions("grp", F.desc("n"), "id", "piece", "source", "cluster")
    return dealt.mapInArrow(run, schema).withColumnRenamed("id", id_col)
