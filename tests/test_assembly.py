import random

import pytest

from readloom.operators import assembly as A
from readloom.operators.overlap import OVERLAP, overlaps
from readloom.plans.views import GENOME


def edit(rng, seq, n):
    s = list(seq)
    for _ in range(n):
        s[rng.randrange(len(s))] = rng.choice("ACGT")
    return "".join(s)


def hamming(a, b):
    return sum(x != y for x, y in zip(a, b, strict=True))


def plain_successor(contigs, a):
    best = None
    for b, sb in contigs.items():
        for shift in range(1, len(contigs[a])):
            overlap = len(contigs[a]) - shift
            if a == b or overlap < 24 or overlap > len(sb):
                continue
            tail, head = contigs[a][shift:], sb[:overlap]
            seeds = {(i, sb[i : i + 15]) for i in range(min(len(sb), 64) - 14)}
            shared = any((i, tail[i : i + 15]) in seeds for i in range(overlap - 14) if shift + i >= len(contigs[a]) - 220)
            wrong = hamming(tail, head)
            if shared and wrong <= overlap // 8:
                best = min(best or (9**9,), (-overlap, wrong, b, shift))
    return best


def plain_merge(contigs, found):
    """Edges by rising a; then chains from what has no forerunner."""
    group, after, taken = {c: c for c in contigs}, {}, set()
    for a, b, shift in sorted(found):
        if b not in taken and group[a] != group[b]:
            after[a], old, new = (b, shift), group[a], group[b]
            taken.add(b)
            group = {c: new if g == old else g for c, g in group.items()}
    out = {}
    for head in set(contigs) - taken:
        now, offset = head, 0
        out[now] = (head, 0)
        while now in after:
            now, shift = after[now]
            offset += shift
            out[now] = (head, offset)
    return out


def test_contigs_are_joined(spark):
    rng = random.Random(1)
    contigs = {i: edit(rng, GENOME[p : p + rng.randrange(60, 200)], rng.randrange(4)) for i, p in enumerate(rng.sample(range(0, 1800), 40))}
    contigs |= {100: "ACG", 101: "N" * 80, 102: GENOME[3000:3100] + GENOME[3000:3040]}
    frame = spark.createDataFrame(list(contigs.items()), "id long, seq string")
    found = {r.a: (-r.overlap, r.mism, r.b, r["shift"]) for r in A.successors(frame).collect()}
    assert found == {a: best for a in contigs if (best := plain_successor(contigs, a))} and len(found) > 15
    edges = [(a, b, s) for a, (_, _, b, s) in found.items()] + [(100, 101, 2), (101, 100, 2)]
    got = {r.id: (r.super, r.offset) for r in A.merged(frame, spark.createDataFrame(edges, "a long, b long, shift long")).collect()}
    assert got == plain_merge(contigs, edges)
    assert A.merged(frame, spark.createDataFrame([], "a long, b long, shift long")).where("super = id AND offset = 0").count() == len(contigs)


def plain_layout(lens, found, least, most):
    order = {q: sorted((o for o in found if o[0] == q and o[3] >= least), key=lambda o: (-o[3], o[1], o[5], o[2])) for q in lens}
    place = {}
    for seed in sorted(lens, key=lambda q: (-len(order[q]), q)):
        if seed in place:
            continue
        place[seed], stack = (seed, 0, False), [seed]
        while stack:
            now = stack.pop()
            _, at, flip = place[now]
            for o in order[now][:most]:
                _, t, same, _, _, qs, _, ts, _ = o
                if t not in place:
                    off = at + qs - ts if not flip else at + (lens[now] - 1 - qs) - (lens[t] - 1 - ts)
                    place[t] = (seed, off, flip != (not same))
                    stack.append(t)
    first = {c: min(o for d, o, _ in place.values() if d == c) for c, _, _ in place.values()}
    return {r: (c, o - first[c], f) for r, (c, o, f) in place.items()}


@pytest.fixture(scope="module")
def laid(spark):
    rng = random.Random(2)
    rows = []
    for i, p in enumerate(rng.sample(range(0, 3000), 40)):
        seq = edit(rng, GENOME[p : p + 600], 4)
        rows.append((i, A.revcomp(seq) if i % 3 == 0 else seq, p))
    rows.append((99, "ACGT" * 5, -1))
    reads = spark.createDataFrame([r[:2] for r in rows], "read_id long, seq string").cache()
    found = spark.createDataFrame(overlaps(reads).drop("rank").collect(), OVERLAP).cache()
    return rows, reads, found


def test_layout_is_that_of_one_task(laid):
    rows, reads, found = laid
    lens = {i: len(s) for i, s, _ in rows}
    names = [c.split()[0] for c in OVERLAP.split(", ")]
    listed = [tuple(r[n] for n in names) for r in found.collect()]
    for least, most in ((200, 16), (40, 16), (200, 2)):
        got = {r.read: (r.contig, r.offset, r.flip) for r in A.layout(reads, found, least, most).collect()}
        assert got == plain_layout(lens, listed, least, most)
    ends = {}
    for r in A.layout(reads, found).collect():
        ends.setdefault(r.contig, []).append((r.offset + lens[r.read], r.contig_len))
    assert all(max(e for e, _ in v) == v[0][1] for v in ends.values())


def test_consensus_is_the_genome(laid):
    rows, reads, found = laid
    layout = A.layout(reads, found)
    got = A.consensi(layout, reads, 100).collect()
    assert sum(r.reads for r in got) == len(rows)
    best = max(got, key=lambda r: r.reads)
    truth = [g for g in (GENOME, A.revcomp(GENOME)) if best.consensus[300:360] in g]
    assert best.reads > 5 and truth
    at = truth[0].index(best.consensus[300:360]) - 300
    low, high = max(0, -at), min(len(best.consensus), 4096 - at)
    wrong = hamming(best.consensus[low:high], truth[0][at + low : at + high])
    assert wrong <= hamming(best.draft[low:high], truth[0][at + low : at + high]) and wrong < 0.02 * (high - low)
    tiles = A.tilings(layout, reads.selectExpr("read_id AS read", "length(seq) AS len"), 100).collect()
    assert {t.read for t in tiles} <= {r[0] for r in rows} and len({t.contig for t in tiles}) == len(got)


def test_tiles_cover_reads_by_earlier_ones(laid):
    rows, reads, found = laid
    by = {}
    for t in A.tiles(found, reads).collect():
        by.setdefault(t.read, []).append((t.start, t.end, t.target, t.same))
    spans = {}
    for o in found.collect():
        if o.t < o.q:
            spans.setdefault(o.q, []).append((o.q_start, o.q_end, o.t, o.same))
    for read, seq, _ in rows:
        want, at = [], 0
        while at < len(seq):
            over = sorted((o for o in spans.get(read, []) if o[0] <= at < o[1]), key=lambda o: (-o[1], o[0], o[2], not o[3]))
            end = min(over[0][1], len(seq)) if over else min([o[0] for o in spans.get(read, []) if o[0] > at] + [len(seq)])
            want.append((at, end, over[0][2] if over else None, over[0][3] if over else None))
            at = end
        assert sorted(by[read]) == want


def test_best_reference(spark):
    references = spark.createDataFrame([(7, GENOME[:1000]), (8, GENOME[900:2000]), (9, "ACGT" * 9)], "read_id long, seq string")
    cut = {i: (p, GENOME[p : p + 200]) for i, p in enumerate((0, 300, 700, 1000, 1500, 1700, 3000))}
    reads = spark.createDataFrame([(i, A.revcomp(s) if i % 2 else s) for i, (_, s) in cut.items()], "read_id long, seq string")
    got = {r.read: (r.reference, r.offset, r.flip, r.drift) for r in A.best_reference(reads, references).collect()}
    assert got == {i: (7, p, i % 2 == 1, 0) if p < 900 else (8, p - 900, i % 2 == 1, 0) for i, (p, _) in cut.items() if p < 2000}


def test_placing_and_the_indel_probe(spark):
    contigs = [(0, GENOME[:300]), (1, GENOME[250:600]), (2, GENOME[:300])]
    reads = [(10, GENOME[20:120]), (11, edit(random.Random(3), GENOME[300:400], 5)), (12, GENOME[400:440] + "TT" + GENOME[440:500]), (13, GENOME[2000:2100]), (14, GENOME[560:660])]
    frame = lambda rows: spark.createDataFrame(rows, "id long, seq string")
    got = {r.read: (r.contig, r.off, r.overlap) for r in A.placed(frame(reads), frame(contigs)).collect()}
    assert got == {10: (2, 20, 100), 11: (1, 50, 100), 14: (1, 310, 40)}
    probe = A.indel_probe(frame(reads), frame(contigs)).first()
    assert (probe.reads, probe.literals, probe.rescuable, probe.novel, probe.rescuable_bases, probe.literal_bases) == (5, 2, 1, 1, 102, 202)
    assert A.gapped("ACGTACGT", "ACGACGT") == (1, 1) and A.gapped("ACGT", "ACGT") == (0, 0) and A.gapped("", "AC") == (2, 2) and A.gapped("ACCT", "ACG") == (1, 0)


@pytest.mark.parametrize(("part", "passes"), [(1 << 23, 16), (150, 99), (150, 1)])
def test_places_in_memory_in_parts_and_by_a_join_are_the_same(spark, monkeypatch, part, passes):
    rng = random.Random(8)
    contigs = [(i, GENOME[a : a + 90]) for i, a in enumerate(rng.randrange(200) for _ in range(12))] + [(20, "ACG"), (21, ""), (22, GENOME[:40] + "N" + GENOME[41:90].lower())]
    reads = [(i, "".join("A" if rng.random() < 0.05 else b for b in GENOME[a : a + rng.choice([16, 40, 90])])) for i, a in enumerate(rng.randrange(240) for _ in range(60))]
    reads += [(i + 100, s) for i, s in reads[:9]] + [(200, None), (201, ""), (202, "ACGTNACGT"), (203, GENOME[:60].lower())]
    frame = lambda rows: spark.createDataFrame(rows, "id long, seq string")
    found = A.placements(frame(reads), frame(contigs)).where("good").collect()
    want = {}
    for r in found:
        key = (r.mism, -r.contig, r.off, r.overlap)
        want[r.read] = min(want.get(r.read, key), key)
    monkeypatch.setattr(A, "PART", part)
    monkeypatch.setattr(A, "PASSES", passes)
    got = {r.read: (r.mism, -r.contig, r.off, r.overlap) for r in A.placed(frame(reads), frame(contigs)).collect()}
    assert got == want and len(got) > 20


def test_reads_are_placed_without_a_row_for_each_candidate(spark):
    contigs = spark.range(1500).selectExpr("id", f"substr('{GENOME}', CAST(1 + id % 40 AS INT), 100) AS seq")
    reads = spark.range(1500).selectExpr("id", f"substr('{GENOME}', CAST(1 + id % 40 AS INT), 90) AS seq")
    plan = A.placed(reads, contigs)._jdf.queryExecution().toString()
    assert "zip_with" not in plan and plan.count("Join") and {(r.contig, r.mism) for r in A.placed(reads, contigs).where("read = 0").collect()} == {(1480, 0)}
