import random

import numpy as np
import pytest

from readloom.functions import hashes
from readloom.functions.reads import revcomp  # noqa: F401
from readloom.operators import overlap, sketch
from readloom.plans.views import GENOME

RC = str.maketrans("ACGT", "TGCA")


def test_hashes(spark):
    assert hashes.hash64(np.array([0], np.uint64))[0] == 0xE220A8397B1DCDAF
    assert hashes.crc32c(b"123456789") == 0xE3069283
    a, b = b"some text", b"and more of it" * 9
    assert hashes.crc32c_combine(hashes.crc32c(a), hashes.crc32c(b), len(b)) == hashes.crc32c(a + b)
    assert hashes.crc32c_column([b"", a, b, a]).tolist() == [hashes.crc32c(x) for x in (b"", a, b, a)]
    rows = [(i, "x" * (i % 7) + str(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "read_id long, v string").repartition(5)
    whole = "".join(v for _, v in rows).encode()
    assert hashes.crc32c_in_order(frame, frame.v) == (hashes.crc32c(whole), len(whole))
    got = {r.read_id: r.c for r in frame.select("read_id", hashes.crc32c_of(frame.v).alias("c")).collect()}
    assert got == {i: hashes.crc32c(v.encode()) for i, v in rows}


def slow_minimizers(seq, w, k):
    out, last, run = [], None, []
    for i in range(len(seq) - k + 1):
        f = seq[i : i + k]
        if set(f) - set("ACGT"):
            run = []
            continue
        r = f[::-1].translate(RC)
        code = lambda s: int("".join(str("ACGT".index(c)) for c in s), 4)
        h = int(hashes.hash64(np.array([min(code(f), code(r))], np.uint64))[0])
        run.append((h, i))
        if i + 1 >= w:
            h, at = min((x for x in run if x[1] > i - w), key=lambda x: (x[0], -x[1]))
            if h != last:
                out.append((h, at))
                last = h
    return out


@pytest.mark.parametrize("seq", ["", "ACG", GENOME[:300], "A" * 60, GENOME[:40] + "N" + GENOME[40:90] + "NN" + GENOME[:60]])
def test_minimizers_are_those_of_every_window(seq):
    h, at, _ = sketch.minimizers(seq, 10, 15)
    assert list(zip(h.tolist(), at.tolist())) == slow_minimizers(seq, 10, 15)


def test_syncmers_of_both_strands_agree():
    seq = GENOME[:500]
    h, at, _ = sketch.syncmers(seq, 15, 5)
    g, _, _ = sketch.syncmers(seq[::-1].translate(RC), 15, 5)
    assert len(at) and sorted(h.tolist()) == sorted(g.tolist())


def test_chains():
    line = [(100 + 10 * i, 10 * i) for i in range(8)]
    assert overlap.chains(line, 15) == [(15 + 70, 8, 0, 85, 100, 185)]
    assert overlap.chains(line[:2], 15) == []
    two = sorted(line + [(9000 + 10 * i, 10 * i) for i in range(6)])
    assert [c[:2] for c in overlap.chains(two, 15)] == [(85, 8), (65, 6)]
    assert overlap.gap_cost(0, 15) == 0 and overlap.gap_cost(100, 15) == 18


def test_overlaps_find_what_was_cut_from_one_place(spark):
    cut = {i: GENOME[40 * i : 40 * i + 200] for i in range(20)}
    rows = [(i, s if i % 2 else s[::-1].translate(RC)) for i, s in cut.items()] + [(99, None), (98, "ACGT")]
    got = overlap.overlaps(spark.createDataFrame(rows, "read_id long, seq string")).collect()
    near = {(r.q, r.t) for r in got}
    assert all(abs(q - t) * 40 < 200 for q, t in near)
    assert {(i, i + 1) for i in range(19)} <= near
    assert all(r.same == ((r.q - r.t) % 2 == 0) for r in got)


def test_chains_of_many_pairs_side_by_side():
    rng = random.Random(2)
    pairs = []
    for _ in range(600):
        n = rng.choice([0, 1, 2, 3, 4, 6, 10, 14, 23, 24, 25, 30])
        some = [(100 + rng.randrange(6) * 10 + 9 * i, i * rng.choice([7, 9, 11])) for i in range(n)] if rng.random() < 0.5 else [(rng.randrange(200), rng.randrange(200)) for _ in range(n)]
        far = 6000 if rng.random() < 0.2 else 0
        pairs.append(sorted((t + (far if i > n // 2 else 0), q) for i, (t, q) in enumerate(some)))
    at = np.array([x for p in pairs for x in p], np.int64)
    got = overlap.chains_beside(at[:, 0], at[:, 1], np.array([len(p) for p in pairs]), 19)
    want = [(i, *c) for i, p in enumerate(pairs) for c in overlap.chains(p, 19)]
    assert list(zip(*(c.tolist() for c in got), strict=True)) == want and len(want) > 300


@pytest.mark.parametrize(("part", "passes"), [(1 << 22, 16), (300, 99)])
@pytest.mark.parametrize("last", [False, True])
def test_best_chains_are_those_of_all_pairs(spark, monkeypatch, part, passes, last):
    rng = random.Random(6)
    cut = [GENOME[a : a + 160] for a in (rng.randrange(300) for _ in range(25))]
    cut += [GENOME[10:90] + GENOME[10:90], *cut[:8]]
    rows = [(i, s if i % 2 else s[::-1].translate(RC)) for i, s in enumerate(cut)]
    found = sketch.seeds(spark.createDataFrame(rows, "read_id long, seq string")).localCheckpoint()
    index = overlap.seed_index(found).localCheckpoint()
    all_of = [tuple(r) for r in overlap.chained(overlap.anchors(found, index, 19), 19).collect()]
    want = []
    for q in {r[0] for r in all_of}:
        mine = sorted((r for r in all_of if r[0] == q), key=lambda r: (-r[3], -r[1] if last else r[1], r[5], r[2]))
        want += [(*r, i) for i, r in enumerate(mine[:5], 1)]
    monkeypatch.setattr(overlap.marks, "PART", part)
    monkeypatch.setattr(overlap.marks, "PASSES", passes)
    got = [tuple(r) for r in overlap.best_chains(found, index, 19, 5, last).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100
