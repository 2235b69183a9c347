import random

from readloom.operators import align, contigs
from readloom.plans.views import GENOME


def mutated(rng, seq, n):
    s = list(seq)
    for _ in range(n):
        at = rng.randrange(len(s) + 1)
        s[at : at + rng.randrange(2)] = rng.choice(["", "A", "C", "G", "T"])
    return "".join(s)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_scripts_are_shortest_and_replay():
    rng = random.Random(1)
    cases = [("", ""), ("", "ACG"), ("ACG", ""), ("A", "T")]
    cases += [(s := GENOME[a : a + rng.randrange(60)], mutated(rng, s, rng.randrange(8))) for a in range(0, 4000, 97)]
    for a, b in cases:
        want = distance(a, b)
        for script in (align.banded(a, b, 64), align.wavefront(a, b)):
            assert align.replay(a, script) == b and align.cost(script) == want, (a, b, script)
        if want:
            assert align.wavefront(a, b, want - 1) is None


def test_gaps_between_anchors():
    ref = GENOME[:200]
    read = ref[:50] + "T" + ref[52:120] + ref[123:]
    script = align.from_anchors(ref, read, [(0, 0), (10, 10), (60, 59), (130, 126)], 15)
    assert align.replay(ref, script) == read and align.cost(script) <= 6


def test_aligned_column(spark):
    rows = [("ACGTACGT", "ACGTTCGT"), (None, "A"), ("", ""), ("AAAA", "AA")]
    got = align.aligned(spark.createDataFrame(rows, "ref string, read string")).collect()
    assert [r.edits for r in got] == [1, None, 0, 2] and all(r.restored for r in got if r.ref is not None)


def test_contig_fold(spark):
    base = GENOME[:80]
    rows = [(0, "k", 40, base[:60]), (1, "k", 40, base[:60]), (2, "k", 30, base[10:70]), (3, "k", 5, GENOME[900:960]), (4, None, 0, "ACG"), (5, "z", 3, base[:30])]
    plan = spark.createDataFrame(rows, "read_id long, canon string, anchor long, oriented string")
    got = {r.read_id: (r.op, r.contig, r.start, r.mismatches, r.novel) for r in contigs.folded(plan).collect()}
    assert got == {0: ("LITERAL", 0, 0, 0, 60), 1: ("MATCH", 0, 0, 0, 0), 2: ("CONTIG", 0, 10, 0, 10), 3: ("LITERAL", 1, 0, 0, 60), 4: ("LITERAL", -1, 0, 0, 3), 5: ("LITERAL", 0, 0, 0, 30)}
    stats = {r.op: r.reads for r in contigs.op_statistics(contigs.folded(plan)).collect()}
    assert stats == {"LITERAL": 4, "MATCH": 1, "CONTIG": 1}


def test_folds():
    j = contigs.Joined()
    assert [j.accept(*e) for e in ((0, 1), (1, 2), (2, 0), (0, 3), (4, 2), (3, 4))] == [True, True, False, False, False, True]
    votes = [list("AAA"), list("C-"), list("--G"), list("TG-"), list("GG--")]
    assert contigs.consensus("TCTTA", votes) == "ACGG"
    assert contigs.cover([(0, 5000), (1000, 7000), (2500, 9000), (9500, 12000)]) == [0, 2, 3]
