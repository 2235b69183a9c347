import random

import numpy as np
import pytest

from readloom.llm import rule_quality, string_kernel


def corpus(spark, n=600):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice(["the", "of", "rather", "meaning", "bottle", "is", "green"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(60, 200))]
        text = " ".join(words).capitalize() + "." if good else " | ".join(w.upper() for w in words)
        rows.append((i, text, "keep", 0.5))
        labels.append((i, int(good), 0))
    rows += [(9001, None, "keep", 0.1), (9002, "", "keep", 0.1), (9003, "x" * 200_000, None, 0.1), (None, "one two", "k", 0.2), (1, rows[1][1], "again", 0.2)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string, f_digit double"), spark.createDataFrame([*labels, (1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")


def test_rules_separate_held_out_documents(spark):
    docs, labels = corpus(spark)
    out = rule_quality.rule_quality(docs, labels)
    assert out.columns == ["doc_id", "text", "f_digit", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 60 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_columns_score_as_the_model_does(spark):
    docs, labels = corpus(spark, 300)
    model = rule_quality.train(docs, labels, ~rule_quality.held_out("doc_id", 5, 0))
    assert model.rules and len(model.rules) < 60
    frame = rule_quality.with_features(docs.select("doc_id", "text"), "text").withColumn("score", model.score_column()).toPandas()
    assert np.allclose(frame["score"], model.scores(frame[[f"f_{k}" for k in rule_quality.FEATURES]].to_numpy()))


def test_rules_without_labels_or_rows(spark):
    docs, labels = corpus(spark, 30)
    assert {r.score for r in rule_quality.rule_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert rule_quality.rule_quality(docs.limit(0), labels).count() == 0


def test_kernel_equals_its_definition():
    texts, langs = ["abab cd", "xyz xyz", "abba abd", "zyx yz"], ["a", "b", "a", "b"]
    model = string_kernel.fit_kernel(texts, langs, landmarks=4)
    seen = string_kernel.presence(texts).astype(float)
    norm = np.sqrt(seen.sum(1))
    k = seen @ seen.T / norm[:, None] / norm[None, :]
    y = np.array([[1, -1], [-1, 1], [1, -1], [-1, 1]], float)
    w = np.linalg.solve(k.T @ k + 1e-3 * 4 * k + 1e-8 * np.eye(4), k.T @ y)
    got = (seen[:, model.columns] @ model.weights) / norm[:, None]
    assert np.allclose(got, k @ w, atol=1e-4)


def test_ngrams_are_those_of_the_whole_text(monkeypatch):
    text = "The Quick brown fôx \U0001f600 jumps " * 30
    whole = string_kernel.presence([text])
    monkeypatch.setattr(string_kernel, "CHUNK", 7)
    assert (string_kernel.presence([text]) == whole).all()
    low = text.lower()
    assert whole.sum() == pytest.approx(sum(len({low[i : i + n] for i in range(len(low) - n + 1)}) for n in range(1, 5)), rel=0.01)


def test_languages(spark):
    rng = random.Random(5)
    words = {"en": "the of and with this that house water".split(), "de": "der die und mit haus wasser über straße".split(), "fr": "le la et avec maison été eau être".split()}
    rows = []
    for i in range(500):
        lang = rng.choice(["en", "en", "de", "fr"])
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(8, 60))), lang if i % 7 else None, lang))
    extra = [(1000, None, "en", ""), (1001, "", "en", ""), (1002, "12 !? ∑", "en", ""), (None, "the house and the water", "en", "en"), (3, rows[3][1], "en", rows[3][3])]
    docs = spark.createDataFrame(rows + extra, "doc_id bigint, text string, lang string, score string")
    got = string_kernel.identify_languages(docs).collect()
    assert len(got) == 505 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert np.mean([by[i].lang_pred == t for i, _, _, t in rows if by[i].held_out]) > 0.97
    assert string_kernel.identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in string_kernel.identify_languages(docs.withColumn("lang", docs.lang.substr(1, 0)).replace("", None, "lang")).collect()} == {"und"}


def test_more_languages_than_landmarks(spark):
    rng = random.Random(6)
    rows = []
    for i in range(3200):
        k = i % 320
        rows.append((i, " ".join(f"{chr(0x4E00 + 40 * k + rng.randrange(40))}{chr(0x4E00 + 40 * k + rng.randrange(40))}" for _ in range(12)), f"l{k:03d}"))
    got = string_kernel.identify_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    assert len({r.lang_pred for r in got}) > 256


def test_rules_are_tree_paths_and_lasso_optimum():
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.integers(0, 6, (600, 4)).astype(float), np.zeros((600, len(rule_quality.FEATURES) - 4))])
    y = ((x[:, 0] > 2) & (x[:, 1] <= 3) ^ (rng.random(600) < 0.1)).astype(float)
    model = rule_quality.fit_rules(x, y)
    for rule, _ in model.rules:
        assert 1 <= len(rule) <= rule_quality.DEPTH
        held = np.ones(len(x), bool)
        for k, (j, low, cut) in enumerate(rule):  # every step parts the rows that came so far, into two leaves that are large enough
            side = x[held, j] <= cut
            assert min(side.sum(), (~side).sum()) >= rule_quality.LEAF
            held[held] = side == low
    # optimality of min mean log loss + lasso * |w|_1: the loss's gradient is lasso against a weight's sign, and zero for the bias
    rules = np.array([rule_quality._holds(r, x) for r, _ in model.rules], float)
    weights = np.array([w for _, w in model.rules])
    rest = model.scores(x) - y
    gradient = rules @ rest / len(y)
    assert abs(rest.mean()) < 1e-3 and np.allclose(gradient, -rule_quality.LASSO * np.sign(weights), atol=3e-4)
    assert ((model.scores(x) > 0.5) == ((x[:, 0] > 2) & (x[:, 1] <= 3))).mean() > 0.95


def test_a_repeated_id_has_one_text_for_training(spark):
    docs, labels = corpus(spark, 200)
    twice = docs.unionByName(docs.withColumn("text", docs.text.substr(1, 40)))
    a, b = ({(r.doc_id, r.text, r.score) for r in rule_quality.rule_quality(d, labels).collect()} for d in (twice.repartition(7), twice.coalesce(1)))
    assert a == b
