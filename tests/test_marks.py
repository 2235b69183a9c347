import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.operators import marks
from readloom.plans import registry
from readloom.plans.views import GENOME, to_spark

RC = str.maketrans("ACGT", "TGCA")


def slow(seq):
    """(k-mer, place, forward), a window at a time."""
    some = []
    for i in range(len(seq) - 14):
        f = seq[i : i + 15]
        if "N" not in f:
            r = f[::-1].translate(RC)
            some.append((hashlib.md5(min(f, r).encode()).hexdigest(), -(i + 1), f <= r, min(f, r)))
    out, last = [], None
    for j, one in enumerate(some):
        if -one[1] >= 10:
            least = min(some[max(0, j - 9) : j + 1])
            if least[0] != last:
                out.append((least[3], -least[1], least[2]))
            last = least[0]
    return out


def texts(n=60, seed=3):
    rng = random.Random(seed)
    out = ["", "ACG", GENOME[:24], "A" * 60, "N" * 40, GENOME[:31] + "N" + GENOME[40:90] + "NN" + GENOME[:60]]
    for _ in range(n):
        at = rng.randrange(300)
        s = GENOME[at : at + rng.choice([24, 60, 100, 140])]
        s = "".join("N" if rng.random() < 0.01 else b for b in s) + (s[:50] if rng.random() < 0.3 else "")
        out.append(s[::-1].translate(RC) if rng.random() < 0.5 else s)
    return out + out[10:25]


def test_minimizers_of_joined_reads():
    some = texts()
    read, code, pos, forward = marks.found(np.frombuffer("".join(some).encode(), np.uint8), np.cumsum([0, *map(len, some)]))
    kmers = ["".join("ACGT"[int(c) >> 2 * (14 - j) & 3] for j in range(15)) for c in code]
    got = list(zip(read.tolist(), kmers, pos.tolist(), forward.tolist(), strict=True))
    assert got == [(i, *m) for i, s in enumerate(some) for m in slow(s)] and got
    assert [len(x) for x in marks.found(np.empty(0, np.uint8), np.zeros(1, np.int64))] == [0] * 4
    with pytest.raises(ValueError, match="other than"):
        marks.found(np.frombuffer(b"ACGTx", np.uint8), np.array([0, 5]))


@pytest.fixture(scope="module")
def lists(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("marks"))
    marks.marks(spark.createDataFrame([*enumerate(texts()), (999, None)], "read_id long, seq string")).write.parquet(path + "/l")
    return spark.read.parquet(path + "/l")


def by_hand(fanout=None):
    seeds = [(m[0], i, m[1], m[2]) for i, s in enumerate(texts()) for m in slow(s)]
    n = Counter(s[0] for s in seeds)
    place, index = Counter(), []
    for s in sorted(seeds):
        if place[s[0]] % (-(-n[s[0]] // fanout) if fanout else 1) == 0:
            index.append(s)
        place[s[0]] += 1
    return seeds, n, index


def test_hashes_and_the_most_frequent(spark, lists, monkeypatch):
    seeds, n, _ = by_hand()
    named = {r.h: r.n for r in marks.counts(lists).select(F.expr(marks.HASH).alias("h"), "n").collect()}
    md5 = {hashlib.md5(k.encode()).hexdigest(): c for k, c in n.items()}
    assert named == md5 and len(named) > 50
    monkeypatch.setattr(marks, "REPEATS", 7)
    dropped = sorted(md5, key=lambda h: (-md5[h], h))[: len(md5) // 7]
    assert {r.h for r in marks.usual(marks.counts(lists)).select(F.expr(marks.HASH).alias("h")).collect()} == set(md5) - set(dropped)


@pytest.mark.parametrize(("part", "passes"), [(1 << 22, 16), (40, 99), (40, 1)])
def test_shared_in_memory_in_parts_and_joined(lists, monkeypatch, part, passes):
    monkeypatch.setattr(marks, "FANOUT", 6)
    monkeypatch.setattr(marks, "PART", part)
    monkeypatch.setattr(marks, "PASSES", passes)
    seeds, _, index = by_hand(6)
    found = marks.entries(lists, marks.counts(lists)).localCheckpoint()
    assert sorted((r.read_id, r.pos, r.forward) for r in found.collect()) == sorted(s[1:] for s in index)
    met = [(a, b) for a in seeds for b in index if a[0] == b[0] and a[1] != b[1]]
    pairs = {p: c for p, c in Counter((a[1], b[1]) for a, b in met).items() if c >= 3}
    assert {(r.q, r.t): r.n for r in marks.shared(lists, found).collect()} == pairs and len(pairs) > 50
    want = []
    for q in {q for q, _ in pairs}:
        best = sorted((-c, t) for (a, t), c in pairs.items() if a == q)[:2]
        want += [(q, t, -c, i) for i, (c, t) in enumerate(best, 1)]
    assert sorted((r.q, r.t, r.n, r.place) for r in marks.shared(lists, found, 3, 2).collect()) == sorted(want)
    digests, counted = Counter(), Counter()
    for q in {a[1] for a, _ in met}:
        mine = sorted((b[1], a[3] == b[3], b[2], a[2]) for a, b in met if a[1] == q)
        digests[q], counted[q] = sum(i * (1000 * t + p) for i, (_, _, t, p) in enumerate(mine, 1)), len(mine)
    assert {r.q: (r.anchors, r.order_digest) for r in marks.ordered_anchors(lists, found).collect()} == {q: (counted[q], digests[q]) for q in counted}


def test_all_that_share_seeds_are_paired(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(marks, "REPEATS", 4)  # neither hashes nor occurrences of a hash are left out
    period = 3996 * 97  # of the view: event_id and event_id + period are equal reads
    ids = [*(5 + i * period for i in range(700)), 3996 * 2 + 5, 40, 111]
    spark.createDataFrame([(i,) for i in ids], "event_id bigint").write.parquet(f"{tmp_path}/events.parquet")
    seqs = {r.read_id: r.seq for r in spark.sql(to_spark("SELECT read_id, seq FROM reads_overlap", str(tmp_path))).collect()}
    known = {s: Counter(m[0] for m in slow(s)) for s in set(seqs.values())}
    shared = {(a, b): sum(n * known[b][k] for k, n in known[a].items()) for a in known for b in known}
    want = {(q, t): n for q in ids for t in ids if q != t and (n := shared[seqs[q], seqs[t]]) >= 3}
    assert len(want) >= 700 * 699 and {(r.q, r.t): r.n for r in registry.queries()["j04_shared_seeds"](spark, str(tmp_path)).collect()} == want
