import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from readloom.llm import sharding as S


def check(rows, got, shards=40, range_rows=S.RANGE_ROWS):
    size = lambda t: (len(t.encode()) if t is not None else 0) + 16
    want = Counter((i, size(t), None if t is None else zlib.crc32(t.encode()), "bytes", None) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == want
    held, slots = Counter(), defaultdict(list)
    for r in got:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(held) <= set(range(shards)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    share = sum(held.values()) / shards
    room = max([share / 32 + 64, *(size(t) for _, t in rows)])
    assert all(held[k] <= share + room for k in range(shards))
    assert all(sum(held[j] for j in range(k + 1)) >= (k + 1) * share - room for k in range(shards))
    return held


def test_bounds_by_brute_force():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 100):
        bounds = rng.integers(0, 4, (n, 3))
        bounds = bounds[np.lexsort(bounds.T[::-1])]
        rows = rng.integers(0, 4, (300, 3))
        assert S.locate(bounds, rows).tolist() == [sum(tuple(b) <= tuple(r) for b in bounds.tolist()) for r in rows.tolist()]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.tuples(st.integers(0, 9), st.integers(0, 3), st.just(0)), st.floats(0.01, 3))))
def test_ranges_of_splitters_are_full_but_not_overfull(drawn):
    bounds, weights = S.splitters(drawn), defaultdict(float)
    per = Counter()
    for key, w in drawn:
        weights[key] += w
    for key, w in weights.items():
        per[sum(b <= key for b in bounds)] += w
    assert len(per) == len(bounds) + bool(drawn) and bounds == sorted(set(bounds))
    assert all(v <= 1 + 1e-9 or sum(sum(b <= k for b in bounds) == p for k in weights) == 1 for p, v in per.items())


def test_empty_texts_as_the_hot_key_in_small_ranges(spark):
    rng = random.Random(4)
    rows = [(i, "" if i % 2 else "t%d " % (i % 900) * rng.randrange(1, 30)) for i in range(6000)]
    rows += [(7001, None), (7002, None), (None, None), (None, ""), (7, "t7 é" * 2000), (7, "t7 é" * 2000)] + [(5, "same id and text")] * 700
    docs = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "doc_id bigint, text string, size int, k string, nth int")
    check(rows, S.shard_by_bytes(docs, range_rows=50).collect())
    keys = docs.selectExpr("coalesce(doc_id, -1) AS i", "octet_length(coalesce(text, '')) + 16L AS size", "xxhash64(text) AS k", "monotonically_increasing_id() AS nth")
    total = sum(len((t or "").encode()) + 16 for _, t in rows)
    bounds, held = S.ranges(keys.select("size", "k", "i", "nth"), total / 2560, 50.0)
    assert sum(n for _, _, n in held) == len(rows) and len(held) == len(bounds) + 1
    assert all(n <= 100 and (n == 1 or s <= 2 * total / 2560) for _, s, n in held)


def test_copies_share_a_shard_where_they_fit(spark):
    rng = random.Random(5)
    rows = [(i, "group %d " % (i % 3000) * rng.choice((1, 1, 1)) * 3) for i in range(9000)]
    got = S.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    check(rows, got)
    at = defaultdict(set)
    for r in got:
        at[r.doc_id % 3000].add(r.shard)
    assert all(len(v) == 1 for v in at.values())


def test_few_records_one_text_and_none(spark):
    one = [(i, "one") for i in range(400)]
    held = check(one, S.shard_by_bytes(spark.createDataFrame(one, "doc_id bigint, text string")).collect())
    assert set(held.values()) == {190}
    few = [(1, "a"), (2, "b" * 5000), (3, None)]
    docs = spark.createDataFrame(few, "doc_id bigint, text string")
    check(few, S.shard_by_bytes(docs).collect())
    assert S.shard_by_bytes(docs.limit(0)).count() == 0


def test_same_shards_whatever_the_partitions(spark):
    rows = [(i, "t%d" % (i * 7 % 501) * (i % 40)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    a, b = ({r.doc_id: r.shard for r in S.shard_by_bytes(d).collect()} for d in (docs.repartition(3), docs.coalesce(1)))
    assert sum(a[i] != b[i] for i in a) < 0.1 * len(a)
