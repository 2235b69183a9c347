import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from readloom.llm import decontaminate as D


def shingles(text):
    words = (text or "").lower().split()
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]


def plain(docs, items):
    out = {}
    for d, text in docs:
        sh = shingles(text)
        for k, item in items:
            ish = shingles(item)
            if not ish or not sh:
                continue
            want = Counter(ish)
            best = 0.0
            for at in range(max(1, len(sh) - len(ish) + 1)):
                part = Counter(sh[at : at + len(ish)])
                best = max(best, sum((part & want).values()) / sum((part | want).values()))
            if best >= 0.8:
                out[d, k] = round(best, 9)
    return out


def fixture():
    rng = random.Random(8)
    word = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnopqr") + rng.choice("stuv") for _ in range(n)]
    items = [(i, " ".join(word(rng.randrange(15, 60)))) for i in range(30)]
    items += [(100, "too few words here"), (101, None), (102, "la la la la la la la la la la la la"), (3, items[4][1] + " and more")]
    docs = [(1, None), (2, ""), (3, "la " * 40), (4, items[5][1]), (5, " ".join(items[6][1].split()[:-2]))]
    for i in range(160):
        text = word(rng.randrange(150))
        if i % 2:
            passage = rng.choice(items[:30])[1].split()
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = [rng.choice([[], ["new"], ["two", "new"]]), passage[at : at + 1]][rng.random() < 0.4]
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((10 + i, (" ".join(text) + " ").title()))
    return docs, items


def test_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    want = plain(docs, items)
    assert len(want) > 40
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id bigint, text string, item_id string, p int")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, s int")
    for limits in ((D.SET_LIMIT, D.INDEX_LIMIT), (0, 0)):
        monkeypatch.setattr(D, "SET_LIMIT", limits[0])
        monkeypatch.setattr(D, "INDEX_LIMIT", limits[1])
        got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in D.contaminated(d, b).collect()}
        assert got == want


def test_null_ids_repeats_and_empty_tables(spark):
    passage = " ".join("w%d" % i for i in range(20))
    d = spark.createDataFrame([(None, passage), (7, "x " + passage), (7, "x " + passage), (7, "other text")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    got = D.contaminated(d, b).orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_id, r.start, r.n_words, r.similarity, r.distance) for r in got] == [(None, 1, 0, 20, 1.0, 0), (7, 1, 1, 20, 1.0, 0)]
    assert D.contaminated(d.limit(0), b).count() == 0 and D.contaminated(d, b.limit(0)).count() == 0


def test_fingerprint_and_bag(spark):
    rng = random.Random(9)
    rows = [([rng.choice([-5, 1 << 62, -(1 << 63), 7, 123456789]) for _ in range(rng.randrange(1, 9))],) for _ in range(40)]
    frame = spark.createDataFrame(rows, "h array<bigint>").select("h", D.simhash(F.col("h")).alias("fp"), D.as_bag(F.col("h")).alias("bag"))
    for r in frame.collect():
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in r.h) > len(r.h))
        assert r.fp & (1 << 64) - 1 == want
        assert len(set(r.bag)) == len(r.h)


def test_how_many_windows_the_radius_misses():
    """Bags of shingle hashes that share just what a similarity of 0.8 asks for."""
    rng, missed, n = np.random.default_rng(3), 0, 0
    bits = lambda bag: 2 * ((bag[:, :, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(axis=1) > bag.shape[1]
    for size in (11, 20, 36, 56, 100):
        least = next(k for k in range(size) if k / (2 * size - k) >= 0.8)
        one = rng.integers(0, 1 << 64, (4000, size), np.uint64)
        two = np.concatenate([one[:, :least], rng.integers(0, 1 << 64, (4000, size - least), np.uint64)], axis=1)
        missed, n = missed + int(((bits(one) != bits(two)).sum(axis=1) > D.RADIUS).sum()), n + 4000
    assert missed <= 0.002 * n


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(1 << 20)}" for _ in range(60_000)]
    passage = [f"p{i}" for i in range(40)]
    d = spark.createDataFrame([(1, " ".join(words[:50_000] + passage + words[50_000:])), (2, "same " * 100_000)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, " ".join(passage)), (2, "same " * 30)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.start) for r in D.contaminated(d, b).collect()) == [(1, 1, 50_000), (2, 2, 0)]
