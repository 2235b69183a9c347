import random

from pyspark.sql import functions as F

import corpus_pipeline as P

from .test_decontaminate import plain
from .test_simhash import plain_components, plain_fingerprint


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    words = lambda n: ["".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]
    item = words(30)
    rows, labels = [], []
    for i in range(160):
        body = words(rng.randrange(80, 160))
        bad = i % 4 == 3
        if i % 10 == 1 and not bad:
            body[20:20] = item
        if i % 10 == 2 and not bad:
            body[5:5] = [f"mail.me{i}@mail.example.com"]
        rows.append((i, " | ".join(w.upper() for w in body) if bad else " ".join(body) + ".", "en", f"s{i % 4}", 7))
        labels.append((i, int(not bad), 0))
    rows += [(200 + i, rows[i][1], "en", "s9", 7) for i in (0, 4, 5)] + [(0, rows[0][1], "en", "s9", 7)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, stages = docs.columns, dict(P.STAGES)

    after = stages["quality"](spark, docs, d)
    assert after.columns == columns
    kept = {r.doc_id: r.text for r in after.collect()}
    assert {i for i in kept if i < 160} == {i for i in range(160) if i % 4 != 3} and {200, 204, 205} <= set(kept)

    ids = sorted(kept)
    roots = plain_components([plain_fingerprint(kept[i]) for i in ids])  # no two of these texts are near copies but exact ones
    first = {}
    for i, r in zip(ids, roots, strict=True):
        first[r] = min(i, first.get(r, i))
    after = stages["near_dedup"](spark, after, d)
    assert after.columns == columns and sorted(r.doc_id for r in after.collect()) == sorted(first.values())

    leaks = {k for k, _ in plain([(i, kept[i]) for i in first.values()], [(1, " ".join(item))])}
    after = stages["decontaminate"](spark, after, d)
    clean = {r.doc_id: r.text for r in after.collect()}
    assert leaks and after.columns == columns and set(clean) == set(first.values()) - leaks

    after = stages["pii"](spark, after, d)
    got = {r.doc_id: r for r in after.collect()}
    assert after.columns == columns and set(got) == set(clean)
    for i, r in got.items():
        assert ("@" in r.text and "mail.me" not in r.text) if "@" in clean[i] else r.text == clean[i]
        assert r.n_chars == len(r.text)

    packed = stages["pack"](spark, after, d)
    total = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert total == {i: len(r.text.split()) for i, r in got.items()}
    assert sorted(map(tuple, P.run(spark, d).select("doc_id", "piece", "n_tokens").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "n_tokens").collect()))


def test_near_dedup_of_null_and_repeated_ids(spark, tmp_path):
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "abc")
    rows = [(None, one, "x"), (7, one, "x"), (None, two, "x"), (7, two, "y"), (9, three, "x"), (9, three, "y"), (None, None, "x"), (3, None, "x"), (4, "", "x"), (9, three + " end", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = [(r.doc_id, r.text) for r in P.near_dedup(spark, docs, str(tmp_path)).collect()]
    known = [(7, one), (7, two), (3, None)]
    assert len(kept) == 4 and set(known) <= set(kept) and [i for i, _ in kept].count(9) == 1
    assert P.near_dedup(spark, docs.limit(0), str(tmp_path)).count() == 0
    alone = spark.createDataFrame([(None, one, "x"), (None, two, "x"), (None, one, "z")], docs.schema)
    assert sorted(r.text for r in P.near_dedup(spark, alone, str(tmp_path)).collect()) == [one, two]


def test_near_dedup_of_edited_texts(spark, tmp_path):
    rng = random.Random(22)
    rows = []
    for i in range(30):
        base = [f"w{rng.randrange(1 << 30)}" for _ in range(120)]
        near, far = list(base), list(base)
        for at in (30, 75):
            near[at] = f"e{i}"  # 106 of 126 shingles
        for at in (20, 45, 70, 95):
            far[at] = f"f{i}"  # 96 of 136
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    alike = {(a, b) for a in shingles for b in shingles if a < b and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b])}
    assert alike == {(i, i + 1) for i in range(0, 90, 3)}
    kept = {r.doc_id for r in P.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path)).collect()}
    assert not kept & {b for _, b in alike} and kept >= {i for i in range(0, 90, 3)}


def tables(spark, folder, rows, labels, items, extra=""):
    """documents with clashing columns, labels and benchmark in a folder; the documents."""
    names = ["score", "predicted", "held_out", "n_entities", "_mark", "_key", "_id", "_hash", "_row", "_text", "_t", "_m", "item", "s", "root", "tid"]
    docs = spark.createDataFrame([(*r, *[f"{c} {k}" for c in names]) for k, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in names))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def plain_rows(frame):
    return sorted(map(repr, frame.collect()))


def test_columns_of_any_name_and_odd_documents_pass(spark, tmp_path):
    rng = random.Random(23)
    words = lambda n: " ".join("".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    rows = [(i, words(100) + ".", "en", "s", 7) for i in range(120)]
    rows += [(None, words(90) + ".", "en", None, 7), (None, None, None, None, None), (300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, " \n", "en", "s", 2), (303, "word " * 300_000, "en", "s", 5), (304, "mr Mr Mrs Ann Lee, a@b.org", "en", "s", 1)]
    docs = tables(spark, str(tmp_path), rows, [(i, 1 - i % 2, 0) for i in range(120)] + [(None, 1, 0), (3, None, 0)], [(1, words(30)), (2, None), (3, ""), (4, "few")])
    d = str(tmp_path)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.dtypes == docs.dtypes, name
        kept = plain_rows(out)
        if name == "decontaminate":  # nothing is taken but what is contaminated
            assert kept == plain_rows(docs)
        if name == "pii":
            change = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
            assert change[304].text != rows[-1][1] and change[304].n_chars == len(change[304].text) and change[300].text is None and change[300].n_chars == 0
            assert plain_rows(out.drop("text", "n_chars")) == plain_rows(docs.drop("text", "n_chars"))
        if name == "near_dedup":
            assert set(kept) <= set(plain_rows(docs)) and len(kept) == len(rows) - 3  # of null, empty and blank texts one stays
        if name == "quality":
            assert set(kept) <= set(plain_rows(docs))
        assert stage(spark, docs.limit(0), d).count() == 0
    assert P.STAGES[-1][1](spark, docs, d).where("n_tokens > 0").agg(F.sum("n_tokens")).first()[0] == sum(len((r[1] or "").split()) for r in rows)
    assert P.STAGES[-1][1](spark, docs.limit(0), d).count() == 0
    assert P.run(spark, d).count() > 0


def test_empty_tables_run(spark, tmp_path):
    tables(spark, str(tmp_path), [(1, "a b", "en", "s", 3)], [], [])
    assert P.run(spark, str(tmp_path)).count() == 1  # without labels all stay
    none = tmp_path / "none"
    docs = tables(spark, str(none), [(1, "a b", "en", "s", 3)], [(1, 0, 0)], [(1, "x")])
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/more/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{none}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/more/{t}.parquet")
    assert P.run(spark, f"{tmp_path}/more").count() == 0


def test_ties_are_broken_by_all_columns(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(5, text, s) for s in ("y", "x", "z", "x")] + [(9, text, "a")], "doc_id bigint, text string, source string")
    for parts in (1, 4):
        assert [tuple(r) for r in P.near_dedup(spark, docs.repartition(parts), str(tmp_path)).collect()] == [(5, text, "x")]


def test_the_entry_without_the_corpus_operators(tmp_path):
    import shutil
    import subprocess
    import sys

    root = str(tmp_path / "repo")
    here = P.__file__.rsplit("/", 1)[0]
    shutil.copytree(here, root, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()) > 100)"], cwd=root, capture_output=True, text=True)
    assert done.stdout.split() == ["0", "False", "True"], done.stderr
