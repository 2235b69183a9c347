import random

import numpy as np

from readloom.llm import near_copies as N


def components(n, edges):
    root = list(range(n))
    find = lambda i: i if root[i] == i else find(root[i])
    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_forests_connect_what_agrees():
    rng = np.random.default_rng(1)
    for n in (9, 17, 60):
        base = rng.integers(0, 1 << 16, (5, 48))
        sketches = np.where(rng.random((n, 48)) < 0.35, rng.integers(0, 1 << 16, (n, 48)), base[rng.integers(0, 5, n)]).astype(np.uint16)
        agree = [(i, j) for i in range(n) for j in range(i) if (sketches[i] == sketches[j]).sum() >= N.AGREE]
        i, j, nth = N.group_pairs(sketches)
        got = list(zip(i.tolist(), j.tolist(), strict=True))
        assert components(n, got) == components(n, agree) == components(n, [e for e, k in zip(got, nth, strict=True) if k == 1])
        assert len({frozenset(e) for e in got}) == len(got) and (nth == 1).sum() < n and (n <= N.ALL_PAIRS or len(got) <= 2 * n)
        # no pair agrees more than the weakest tie between its ends in the first forest
        tie = N.forest(sketches)
        for least in range(N.AGREE, 49):
            strong = [(a, b) for a, b in enumerate(tie.tolist()) if b >= 0 and (sketches[a] == sketches[b]).sum() >= least]
            assert components(n, strong) == components(n, [e for e in agree if (sketches[e[0]] == sketches[e[1]]).sum() >= least])


def test_large_groups_of_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(1 << 30)}" for _ in range(400)]
    rows, sets = [], []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(400), rng.choice((2, 4, 5))):
            words[at] = f"e{i}"
        rows.append((" ".join(words),))
        sets.append({tuple(words[k : k + 5]) for k in range(396)})
    rows += [(" ".join(f"x{rng.randrange(1 << 30)}" for _ in range(60)),) for _ in range(40)] + [(None,), ("few words",), ("",)]
    similar = [(i, j) for i in range(150) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(similar) > 5000
    docs = spark.createDataFrame(rows, "text string").selectExpr("text", "xxhash64(text) AS h")
    at = {r.h: k for k, r in enumerate(docs.collect())}
    for at_once in (8192, 40):
        got = [(at[r.x], at[r.y]) for r in N.near_copies(docs, at_once=at_once).collect()]
        assert components(190, got) == components(190, similar)
        assert all(len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in got)
    assert N.near_copies(docs.limit(0)).count() == 0
