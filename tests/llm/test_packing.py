import random

from readloom.llm import packing


def plain(sizes, sources, clusters, capacity):
    bins, out = [], []
    for n, s, c in zip(sizes, sources, clusters, strict=True):
        fit = [i for i, (used, ss, cc) in enumerate(bins) if capacity - used >= n and (s is None or s not in ss) and (c is None or c not in cc)]
        i = min(fit, key=lambda i: (capacity - bins[i][0], i), default=None)
        if i is None:
            i = len(bins)
            bins.append((0, set(), set()))
        used, ss, cc = bins[i]
        out.append((i, used))
        bins[i] = (used + n, ss | {s}, cc | {c})
    return out


def test_group_matches_linear_scan():
    rng = random.Random(6)
    for _ in range(30):
        n, cap = rng.randrange(200), rng.choice([10, 64, 500])
        sizes = sorted((rng.randrange(1, cap + 1) for _ in range(n)), reverse=True)
        sources = [rng.choice(["hot", "hot", "a", "b", "c", None, str(i)]) for i in range(n)]
        clusters = [rng.choice([1, 2, None, 100 + i]) for i in range(n)]
        assert packing.pack_group(sizes, sources, clusters, cap) == plain(sizes, sources, clusters, cap)


def test_table(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randrange(1, 90), rng.choice(["s0", "s1", "s2", None])) for i in range(900)]
    rows += [(2000, None, "s0"), (2001, " ", "s0"), (2002, "long " * 2500, "s9"), (None, "x y", None), (5, "again here", "s1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, n int")
    got = packing.best_fit_packing(docs, capacity=100, group_docs=300).collect()
    words = {i: len((t or "").split()) for i, t, _ in rows if i not in (None, 5)}
    total = {}
    for r in got:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert all(total[i] == n for i, n in words.items())
    assert [r.bin_id for r in got if r.n_tokens == 0] == [None, None]
    bins = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault(r.bin_id, []).append(r)
    source = {i: s for i, _, s in rows}
    text = {i: t for i, t, _ in rows}
    for pieces in bins.values():
        pieces.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in pieces:
            assert r.bin_offset == at
            at += r.n_tokens
        assert at <= 100
        known = [source[r.doc_id] for r in pieces if r.doc_id not in (None, 5) and source[r.doc_id]]
        texts = [text[r.doc_id] for r in pieces if r.doc_id not in (None, 5)]
        assert len(known) == len(set(known)) and len(texts) == len(set(texts))
    assert packing.best_fit_packing(docs.limit(0)).count() == 0


def test_many_equal_rows_and_a_very_long_text(spark):
    rows = [(7, "the same row", "s")] * 900 + [(None, None, None)] * 500 + [(None, "copy of null id", "s")] * 400 + [(9, "long " * 300_000, "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.best_fit_packing(docs, capacity=100, group_docs=50).collect()
    assert len(got) == 1800 + 3000
    by = {}
    for r in got:
        if r.n_tokens:
            by.setdefault(r.bin_id, []).append(r)
    assert all(len(v) == 1 or len({(r.doc_id, r.n_tokens) for r in v}) == len(v) for v in by.values())
    groups = {r.bin_id >> 32 for r in got if r.doc_id == 7}
    assert len(groups) > 4  # rows of one id and text are not in one task
