"""Every plan gives the same rows in Spark and in DuckDB."""

import os

import duckdb
import pytest

from readloom.plans import registry
from readloom.plans.views import BINS, GENOME

DATA = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return bool(x) if isinstance(x, bool) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_plan(spark, duck, name):
    frame = registry.queries()[name](spark, DATA)
    rows = duck.sql(registry.oracle_sql()[name])
    order = sorted(frame.columns)
    assert order == sorted(rows.columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in frame.collect())
    at = [rows.columns.index(c) for c in order]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rows.fetchall())


def test_golden_statistics(spark, tmp_path):
    from readloom.functions.reads import content_stats

    reads = spark.createDataFrame([("r0 x", "ACGTACGT", "IIIIIIII"), ("r1 x", "ACGTN", "!!!!!")], "name string, seq string, qual string")
    r = content_stats(reads).first()
    assert (r.reads, r.bases, r.min_len, r.max_len, r.a, r.c, r.g, r.t, r.n, r.other) == (2, 13, 5, 8, 3, 3, 3, 3, 1, 0)
    assert (r.gc, r.mean_len, r.mean_quality) == (0.5, 6.5, 320 / 13) and r.qual_hist[40] == 8 and r.qual_hist[0] == 5 and len(r.qual_hist) == 94


def test_tables_and_genome():
    assert len(GENOME) == 4096 and set(GENOME) == set("ACGT")
    assert BINS["bin8"][:12] == [0, 1, 6, 6, 6, 6, 6, 6, 6, 6, 15, 15] and BINS["bin8"][93] == 40 and BINS["hifi"][92:] == [35, 93]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_kernels_over_the_tables(spark):
    run = {n: f(spark, DATA) for n, f in registry.queries().items() if n not in registry.oracle_sql()}
    assert {"g02_overlaps", "c10_contig_operations", "a16_crc32c"} <= set(run)
    ops = run["c10_contig_operations"].collect()
    assert len(ops) == 1000 and {r.op for r in ops} == {"MATCH", "CONTIG", "LITERAL"} - ({"MATCH"} if all(r.op != "MATCH" for r in ops) else set())
    place = {r.event_id: r.event_id * 37 % 3996 for r in spark.read.parquet(f"{DATA}/events.parquet").select("event_id").collect()}
    found = run["g02_overlaps"].collect()
    assert found and all(abs(place[r.q] - place[r.t]) < 100 for r in found) and all(r.same == ((r.q - r.t) % 2 == 0) for r in found)
    near = sum(abs(place[a] - place[b]) <= 30 for a in place for b in place if a != b)
    assert len({(r.q, r.t) for r in found if abs(place[r.q] - place[r.t]) <= 30}) > 0.7 * near


def test_synthetic_reads_do_not_depend_on_partitions(spark):
    from readloom.sources.synthetic import PLATFORMS, synthetic_reads

    for platform in PLATFORMS:
        a = sorted(map(tuple, synthetic_reads(spark, 20, platform, 20_000).collect()))
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "3")
        assert a == sorted(map(tuple, synthetic_reads(spark, 20, platform, 20_000).collect()))
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert len(a) == 20 and all(len(s) == len(q) and set(s) <= set("ACGT") for _, _, s, q in a)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_lockstep_gives_both_mates_of_every_spot(spark, tmp_path):
    query = registry.queries()["s05_lockstep_mates"]
    reads = {r.read_id: r.seq for r in registry.queries()["s11_sequence_only"](spark, DATA).collect()}
    assert sorted(map(tuple, query(spark, DATA).select("read_id", "member", "seq").collect())) == sorted((i, i % 2, s) for i, s in reads.items())
    for k, lost in enumerate((0, max(reads))):
        spark.read.parquet(f"{DATA}/events.parquet").where(f"event_id <> {lost}").write.parquet(f"{tmp_path}/{k}/events.parquet")
        with pytest.raises(Exception, match="unequal read counts"):
            query(spark, f"{tmp_path}/{k}").collect()
