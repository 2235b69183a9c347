import random
import re

import numpy as np
import xxhash

from readloom.llm import simhash
from readloom.llm.common import Scratch


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=3):
    at = list(range(len(fps)))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                at[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprint_matches_plain_version():
    rng = random.Random(1)
    texts = [None, "", " \t\r\n", "One", "two Words", "É x y", "a b c d", "x" * 100_000, "w " * 70_000]
    texts += [" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(200)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == plain_fingerprint(t)


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    base = ["w%d" % rng.randrange(50) for _ in range(120)]
    texts = [None, "", "Same text here", "same TEXT here"]
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randrange(14)):
            words[rng.randrange(120)] = "z%d" % rng.randrange(9)
        texts.append(" ".join(words))
    rows = [(i + 1, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[4], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string, component_id int")
    fps = [plain_fingerprint(t) for _, t, *_ in rows]
    roots = plain_components(fps)
    least = {r: min(rows[i][0] for i in range(len(rows)) if roots[i] == r) for r in roots}
    got = sorted(map(tuple, simhash.simhash_components(docs).collect()))
    assert got == sorted((rows[i][0], f"{fps[i]:016x}", least[roots[i]]) for i in range(len(rows)))


def test_empty_table_and_null_ids(spark):
    schema = "doc_id bigint, text string"
    assert simhash.simhash_components(spark.createDataFrame([], schema)).count() == 0
    got = simhash.simhash_components(spark.createDataFrame([(None, "a b c"), (3, "a b c"), (None, "q r s t")], schema)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (3, 3)]


def test_overfull_buckets_are_dealt_again(spark):
    rng = np.random.default_rng(3)
    free = np.uint64((1 << 14) - 1)
    near = (rng.integers(0, 1 << 14, 9000, dtype=np.uint64) & free) | np.uint64(0x5A << 40)
    far = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps = np.unique(np.concatenate((near, far))).view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in fps], "fp bigint")
    edges = simhash.hamming_links(Scratch(spark), frame, bucket=2048).collect()
    index = {int(x): i for i, x in enumerate(fps)}
    at = list(range(len(fps)))

    def find(i):
        while at[i] != i:
            at[i] = at[at[i]]
            i = at[i]
        return i

    for e in edges:
        at[find(index[e.a])] = find(index[e.b])
    unsigned = fps.view(np.uint64)
    want = list(range(len(fps)))

    def root(i):
        while want[i] != i:
            want[i] = want[want[i]]
            i = want[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(unsigned[:i] ^ unsigned[i]) <= 3):
            want[root(i)] = root(int(j))
    group = {}
    assert all(group.setdefault(find(i), root(i)) == root(i) for i in range(len(fps)))
    assert len({find(i) for i in range(len(fps))}) == len({root(i) for i in range(len(fps))})
