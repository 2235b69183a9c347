import random

import pytest
from pyspark.sql import functions as F

from readloom.operators import graph, ordering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = [(i, rng.randrange(20), rng.choice([None, "a", "b", "c"]), rng.randrange(9)) for i in range(700)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "id long, k long, v string, n long").repartition(7)


def test_numbers_sums_and_neighbours_over_all_rows(rows):
    data, frame = rows
    order = sorted(data, key=lambda r: (r[1], -r[0]))
    keys = ("k", F.desc("id"))
    got = {r.id: r.pos for r in ordering.numbered(frame, *keys).collect()}
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
    got = {r.id: (r.before, r.total) for r in ordering.running_sum(frame, F.col("n"), *keys, total="total").collect()}
    assert got == {r[0]: (sum(x[3] for x in order[:i]), sum(x[3] for x in data)) for i, r in enumerate(order)}
    got = {r.id: r.previous for r in ordering.with_previous(frame, F.col("v"), *keys).collect()}
    assert got == {r[0]: order[i - 1][2] if i else None for i, r in enumerate(order)}
    got = {r.id: r.previous for r in ordering.with_previous(frame, F.col("v"), *keys, ignore_nulls=True).collect()}
    assert got == {r[0]: next((x[2] for x in order[i::-1] if x[2]), None) for i, r in enumerate(order)}
    assert "Window" not in ordering.numbered(frame, *keys)._jdf.queryExecution().executedPlan().toString()
    for empty in (ordering.numbered(frame.limit(0), *keys), ordering.with_previous(frame.limit(0), F.col("v"), *keys), ordering.running_sum(frame.limit(0), F.col("n"), *keys)):
        assert empty.count() == 0


def test_as_of(spark, rows):
    _, frame = rows
    right = spark.createDataFrame([(5, "five"), (100, "hundred"), (400, "four")], "id long, name string")
    got = {r.id: r.name for r in ordering.as_of(frame, right, "id", "name").collect()}
    assert got == {i: None if i < 5 else "five" if i < 100 else "hundred" if i < 400 else "four" for i in range(700)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 120) if i % 40] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {n: n for e in edges for n in e}
    while any(root[a] != root[b] for a, b in edges):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == root
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
