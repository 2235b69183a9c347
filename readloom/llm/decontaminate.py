"""Benchmark decontamination with SimHash windows, in SQL functions only.

Each benchmark item has a SimHash of its five-word shingles. Windows of an
item's size slide over every document; their SimHashes are looked up in a
multi-index: five blocks of the items' fingerprints with up to three flipped
bits each, which finds every fingerprint at 19 differing bits or fewer. The
exact weighted similarity of the shingle bags decides.

Windows that can't pass are never fingerprinted. A window at a similarity s
has s of the item's shingles, so only documents with as many shingles of the
benchmark, and only sizes with as many shingles of items of that size, are
looked at; and sliding such a window on to its first shingle of the benchmark
can only add to what it shares. The best windows are therefore among those
that begin with one, which holds for every item and document alike.
Texts stay where they were read: what moves is the shingle hashes of
documents that share enough with the benchmark.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .line_quality import let, word_array

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of the five blocks, flipped bits per block, and what they guarantee.
BLOCKS, FLIPS, RADIUS = (13, 13, 13, 13, 12), 3, 19
#: Distinct shingles of the benchmark that are put into the plan as a set;
#: more are joined.
SET_LIMIT = 100_000
#: Rows of the multi-index, of which an item has as many as its blocks have keys
#: with up to FLIPS flipped bits, up to which it is broadcast; beyond, it is
#: joined like any table. The same for the items themselves.
INDEX_LIMIT = 2_000_000


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles of a text in lower case; empty below
    five words."""

    def windows(w: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(F.size(w) < SHINGLE, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[w[i + k] for k in range(SHINGLE)])))

    return let(word_array(F.lower(text)), windows)


def simhash(hashes: Column) -> Column:
    """A bit is set if it is in over half of the hashes, repeats included."""
    counts = lambda h: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.aggregate(h, F.lit(0), lambda a, x: a + F.getbit(x, b).cast("int")))
    merge = lambda h: F.aggregate(
        F.transform(counts(h), lambda n, b: F.when(2 * n > F.size(h), F.expr("1L")).otherwise(F.expr("0L"))),
        F.struct(F.lit(0).cast("long").alias("v"), F.lit(0).alias("i")),
        lambda a, x: F.struct(a["v"].bitwiseOR(F.call_function("shiftleft", x, a["i"])).alias("v"), (a["i"] + 1).alias("i")),
        lambda a: a["v"],
    )
    return let(hashes, merge)


def as_bag(hashes: Column) -> Column:
    """The hashes with the second, third, .. equal one told apart, so that bags
    are compared as sets."""

    def told(h: Column) -> Column:
        nth = lambda x, i: F.size(F.filter(F.slice(h, 1, i), lambda y: y == x))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(F.transform(h, lambda x, i: F.when(i == 0, x).otherwise(let(nth(x, F.greatest(i, F.lit(1))), lambda n: F.when(n == 0, x).otherwise(F.xxhash64(x, n))))))

    return let(hashes, told)


def _block_keys(fp: Column, flips: int) -> Column:
    """Structs (block, key) of a fingerprint, with every choice of up to flips
    flipped bits within each block."""
    out, at = [], 0

    def flipped(array: Column, part: Column, b: int) -> Column:
        return F.transform(array, lambda m: F.struct(F.lit(b).alias("block"), part.bitwiseXOR(m).alias("key")))

    for b, width in enumerate(BLOCKS):
        part = F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
        masks = [sum(1 << i for i in c) for n in range(flips + 1) for c in combinations(range(width), n)]
        array = F.expr(f"array({','.join(f'{m}L' for m in masks)})")
        out.append(flipped(array, part, b))
        at += width
    return F.flatten(F.array(*out))


def need(shingles: Column | int, similarity: float):
    """Shingles that a window must share at least with an item of so many."""
    if isinstance(shingles, int):
        return int(-(-shingles * int(similarity * 1000) // 1000))
    return F.ceil(shingles * similarity - 1e-9).cast("int")


def _broadcast(rows: DataFrame, count: int) -> DataFrame:
    """rows, to be broadcast if they are few, and not if they are not."""
    return F.broadcast(rows) if count <= INDEX_LIMIT else rows.hint("merge")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id_col, text_hash, item_col, start, n_words, similarity, distance): the
    best window of every document and item with a weighted shingle similarity
    (sum of minima over sum of maxima) of ``similarity`` or more.

    A document shorter than an item is one window. Items of fewer than five
    words have no shingle and match nothing, as have null texts. Equal rows
    (id and text) are one document; a null id is an id. Items repeated under
    one id are compared each by itself and reported once. An empty documents
    or benchmark table gives an empty result; other columns are not looked at.
    Of windows at a similarity of 0.8 two in a thousand differ in more bits than
    the radius and are missed (measured, see the tests); exact passages have
    distance zero. Texts of any length are taken whole.
    """
    scratch = Scratch(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item"), shingle_hashes(F.col(item_text_col)).alias("ish")).where(F.size("ish") > 0)
    items = scratch.cut(items.select("item", F.size("ish").alias("s"), as_bag(F.col("ish")).alias("bag"), "ish", simhash(F.col("ish")).alias("ifp")))
    grams = scratch.cut(items.select("s", F.explode("ish").alias("h")).distinct())
    known, least = grams.select("h").distinct(), items.agg(F.min("s")).first()[0] or 1
    enough = need(least, similarity)

    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tid"), F.col(text_col).alias("t"))
    if known.count() <= SET_LIMIT:
        values = ",".join(f"{r.h}L" for r in known.collect()) or "NULL"
        hits = f"filter(transform(sh, (h, i) -> IF(h IN ({values}), named_struct('p', i, 'h', h), NULL)), x -> x IS NOT NULL)"
        both = F.expr(f"filter(array(named_struct('sh', sh, 'hits', {hits})), x -> size(x.hits) >= {enough})")
        found = own.select("id", "tid", shingle_hashes(F.col("t")).alias("sh")).select("id", "tid", F.explode(both).alias("d")).select("id", "tid", "d.sh", "d.hits")
    else:
        spread = own.select("id", "tid", F.posexplode(shingle_hashes(F.col("t"))).alias("p", "h")).join(known, "h", "left_semi")
        hits = spread.groupBy("id", "tid").agg(F.collect_set(F.struct("p", "h")).alias("hits")).where(F.size("hits") >= enough)
        hits = hits.withColumnsRenamed({"id": "i2", "tid": "t2"})
        found = own.join(hits, F.col("id").eqNullSafe(F.col("i2")) & (F.col("tid") == F.col("t2"))).select("id", "tid", shingle_hashes(F.col("t")).alias("sh"), "hits")
    found = scratch.cut(found)

    places = found.select("id", "tid", F.explode("hits").alias("x")).select("id", "tid", "x.p", "x.h").join(grams, "h").groupBy("id", "tid", "s").agg(F.sort_array(F.collect_set("p")).alias("at"))
    first = lambda at, s: F.filter(F.transform(at, lambda p, i: F.when(F.coalesce(F.get(at, i + need(s, similarity) - 1) - p < s, F.lit(False)), p)), lambda p: p.isNotNull())
    places = places.select("id", "tid", "s", F.explode(first(F.col("at"), F.col("s"))).alias("p"))
    places = places.groupBy(F.col("id").alias("i2"), F.col("tid").alias("t2")).agg(F.collect_set(F.struct("s", "p")).alias("places"))
    whole = found.select("id", "tid", "sh").join(places, F.col("id").eqNullSafe(F.col("i2")) & (F.col("tid") == F.col("t2")))
    start = lambda x: F.greatest(F.lit(0), F.least(x["p"], F.size("sh") - x["s"]))
    cut_out = F.array_distinct(F.transform("places", lambda x: F.struct(x["s"].alias("s"), start(x).alias("start"))))
    windows = whole.select("id", "tid", "sh", F.explode(cut_out).alias("w")).select("id", "tid", F.col("w.s").alias("ws"), "w.start", F.slice("sh", F.col("w.start") + 1, F.col("w.s")).alias("wsh"))
    windows = windows.dropDuplicates(["id", "tid", "ws", "start"])
    windows = scratch.cut(windows.select("id", "tid", "ws", "start", F.size("wsh").alias("n"), as_bag(F.col("wsh")).alias("wbag"), simhash(F.col("wsh")).alias("wfp")))

    index = items.select(F.col("s").alias("is"), "ifp").distinct().select("is", "ifp", F.explode(_block_keys(F.col("ifp"), FLIPS)).alias("k")).select("is", "ifp", "k.block", "k.key")
    index = _broadcast(index, items.select("s", "ifp").distinct().count() * sum(comb(w, k) for w in BLOCKS for k in range(FLIPS + 1)))
    probes = windows.select("wfp", "ws").distinct().select("wfp", "ws", F.explode(_block_keys(F.col("wfp"), 0)).alias("k")).select("wfp", "ws", "k.block", "k.key")
    near = probes.join(index, (probes["block"] == index["block"]) & (probes["key"] == index["key"]) & (F.col("ws") == F.col("is")))
    near = near.withColumn("distance", F.bit_count(F.col("wfp").bitwiseXOR(F.col("ifp")))).where(F.col("distance") <= RADIUS).select("wfp", "ws", "ifp", "distance").distinct()
    pairs = windows.join(near, ["wfp", "ws"]).join(_broadcast(items.select("item", "ifp", "bag", F.col("s").alias("ws")), items.count()), ["ifp", "ws"])
    shared = F.size(F.array_intersect("wbag", "bag"))
    pairs = pairs.withColumn("similarity", let(shared, lambda x: x / (F.col("n") + F.col("ws") - x)))
    pairs = pairs.where(F.col("similarity") >= similarity)
    best = pairs.groupBy("id", "tid", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), (-F.col("distance")).alias("distance"), "n")).alias("b"))
    return best.select(
        F.col("id").alias(id_col), F.col("tid").alias("text_hash"), F.col("item").alias(item_col), (-F.col("b.start")).alias("start"),
        (F.col("b.n") + SHINGLE - 1).alias("n_words"), F.col("b.similarity").alias("similarity"), (-F.col("b.distance")).alias("distance"),
    )

