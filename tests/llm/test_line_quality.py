import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from readloom.llm import line_quality as L


def plain(rows):
    out, held = [], defaultdict(set)
    for k, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if words := re.findall(r"[^\x20\x09-\x0D]+", line):
                held[host, " ".join(words).lower()].add(k)
    for doc, text, host in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
        gone = left = 0
        for x in lines:
            w = re.findall(r"[^\x20\x09-\x0D]+", x)
            if len(held[host, " ".join(w).lower()]) > L.MAX_DOCS_PER_HOST:
                gone += 1
            else:
                left += len(w)
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed, not failed and left >= 0.5 * len(words), gone, left))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t\r", None), (None, "x # y|z é\x85 w", None), (5, "a b c a b c a", "a"), (6, "q q q q", "b"), (6, "q q q q", "b")]
    common = " ".join("common%d" % i for i in range(40))
    for i in range(120):
        body = "\n".join(" ".join(rng.choice("abcdefghijklmnop") + rng.choice("xyz") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(6)))
        rows.append((10 + i, body + ("\n" + common.upper() if i % 3 == 0 else "\n  Common0  foot") + " ", "a" if i % 2 else None))
    rows.append((500, " ".join("w%d" % (i % 700) for i in range(30_000)), "c"))
    schema = "doc_id bigint, text string, source string, n_words int, h string, _id string"
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], schema)
    got = [tuple(r)[:10] for r in L.line_quality(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_fast(rows)))


def plain_fast(rows):
    """plain(), but the one very long text, whose windows all repeat, by hand."""
    out = plain(rows[:-1])
    doc, text, _ = rows[-1]
    words = text.split()
    return [*out, (doc, len(words), sum(map(len, words)), 0, 0, len(words), True, False, 0, len(words))]


def test_removed_lines_leave_the_text(spark):
    rows = [(i, "Shared  line here\nown line %d\n\nlast %d" % (i, i), "a") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = docs.join(L.line_quality(docs).select("doc_id", "removed_lines"), "doc_id").select("doc_id", L.without_lines(F.col("text"), F.col("removed_lines")).alias("t"))
    assert {r.doc_id: r.t for r in out.collect()} == {i: "own line %d\n\nlast %d" % (i, i) for i in range(12)}


def test_empty_table(spark):
    assert L.line_quality(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0
