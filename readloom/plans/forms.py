"""Spark forms of plans whose SQL would sort all rows in one task or shuffle a
row for every base. Each gives what the SQL of its name in the catalog gives,
which DuckDB checks: global order is by ranges (operators/ordering.py), and what
looks at the bases of a read does so in the read's row or batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import batches
from ..operators import marks
from ..operators.ordering import as_of, numbered, running_sum, with_previous
from ..sources.scratch import written
from .catalog import PLANS
from .views import TOKEN_OP_SQL, TOKEN_VALUE_SQL, VIEWS, binned, to_spark

_ROUND = 6
TOKEN_OP, TOKEN_VALUE = TOKEN_OP_SQL.replace("@RX", "regexp_like"), TOKEN_VALUE_SQL.replace("@RX", "regexp_like")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(to_spark(sql, sf_dir))


def spread(spark: SparkSession, sf_dir: str, table: str, columns: str = "read_id, seq") -> DataFrame:
    """Columns of a reads view that are made after its events' numbers are dealt
    out, so that a few files are no bound on the tasks that work on them."""
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return view(spark, sf_dir, f"SELECT {columns} FROM ({VIEWS[table].replace('FROM events', f'FROM (SELECT /*+ REPARTITION({n}, event_id) */ event_id FROM events)')})")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT read_id, name, seq, qual FROM reads")


# the smallest canonical k-mer of each read, and the cluster order

_RC = "reverse(translate({}, 'ACGTacgt', 'TGCAtgca'))".format


def _least(k: int = 15) -> str:
    """SQL of the least (canon, i, flip) of a read's k-mers without N, or null."""
    kmer = f"substr(seq, i, {k})"
    one = f"IF(contains({kmer}, 'N'), NULL, named_struct('canon', least({kmer}, {_RC(kmer)}), 'i', i, 'flip', IF({kmer} <= {_RC(kmer)}, 0, 1)))"
    return f"IF(length(seq) >= {k}, array_min(filter(transform(sequence(1, greatest(1, length(seq) - {k - 1})), i -> {one}), x -> x IS NOT NULL)), NULL)"


def cluster_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orientation and anchor of every read, by its smallest canonical k-mer."""
    rows = written(view(spark, sf_dir, "SELECT read_id, seq FROM reads_overlap").withColumn("m", F.expr(_least())))  # else it is found anew for every use of m
    flip = F.coalesce(F.col("m.flip"), F.lit(0))
    anchor = F.when(F.col("m").isNull(), 0).when(flip == 1, F.length("seq") - (F.col("m.i") - 1) - 15).otherwise(F.col("m.i") - 1)
    return rows.select("read_id", F.col("m.canon").alias("canon"), flip.alias("flip"), anchor.cast("long").alias("anchor"), F.when(flip == 1, F.expr(_RC("seq"))).otherwise(F.col("seq")).alias("oriented"))


def _cluster_keys() -> list:
    return [F.col("canon").isNull(), "canon", F.desc("anchor"), "oriented", "read_id"]


def o01_cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(cluster_plan(spark, sf_dir), *_cluster_keys()).select("read_id", "canon", "flip", "anchor", "pos")


def o02_apply_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered(cluster_plan(spark, sf_dir), *_cluster_keys()).select("pos", "read_id", F.col("oriented").alias("seq"))


def o10_order_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(cluster_plan(spark, sf_dir), *_cluster_keys()).where("flip = 1")
    return rows.select("read_id", F.expr(_RC("oriented")).alias("rc")).orderBy("read_id")


def j07_unpermute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(cluster_plan(spark, sf_dir), *_cluster_keys())
    back = rows.join(view(spark, sf_dir, "SELECT read_id, seq FROM reads_overlap"), "read_id")
    return back.select("pos", "read_id", (F.col("seq") == F.when(F.col("flip") == 1, F.expr(_RC("oriented"))).otherwise(F.col("oriented"))).alias("restored"))


def w01_duplicate_of_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_previous(cluster_plan(spark, sf_dir), F.col("oriented"), *_cluster_keys())
    return rows.select("read_id", F.coalesce(F.col("oriented") == F.col("previous"), F.lit(False)).alias("dup"))


def w12_min_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT read_id, seq FROM reads").withColumn("m", F.expr(_least())).where("m IS NOT NULL")
    return rows.select("read_id", F.col("m.canon").alias("canon"), (F.col("m.i") - 1).cast("long").alias("pos"), F.col("m.flip").alias("flip"))


# windows over all reads


def w02_token_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = "regexp_extract_all(name, '[0-9]+|[^0-9]+', 0)"
    rows = with_previous(reads(spark, sf_dir).selectExpr("read_id", f"{tokens} AS t"), F.col("t"), "read_id", name="p")
    rows = rows.selectExpr("read_id", "posexplode(transform(t, (k, i) -> named_struct('k', k, 'p', get(p, i)))) AS (col, x)").selectExpr("read_id", "CAST(col + 1 AS BIGINT) AS col", "x.k AS k", "x.p AS p")
    return rows.selectExpr("read_id", "col", f"{TOKEN_OP} AS op", f"{TOKEN_VALUE} AS value")


def c01_name_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda op: F.count(F.when(F.col("op") == op, 1))
    return w02_token_delta(spark, sf_dir).groupBy("col").agg(
        F.count("*").alias("tokens"), count("MATCH").alias("matches"), count("DELTA").alias("deltas"), count("NUM").alias("numbers"), count("STR").alias("strings"),
        F.sum(F.length("value") + 1).alias("payload"),
    )


def w03_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    platform = view(spark, sf_dir, PLANS["p13_platform"])
    rows = with_previous(platform, F.col("platform"), "read_id").withColumn("new", F.when(F.col("platform") == F.col("previous"), 0).otherwise(1))
    runs = running_sum(rows, F.col("new"), "read_id").withColumn("run", F.col("before") + F.col("new"))
    return runs.groupBy("run").agg(F.count("*").alias("n"), F.min("read_id").alias("first_read"))


def w05_prefix_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT read_id, length(seq) AS len FROM reads")
    return running_sum(rows, F.col("len"), "read_id", name="start").select("read_id", "start")


def w11_equal_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = running_sum(view(spark, sf_dir, "SELECT read_id, length(seq) AS len FROM reads"), F.col("len"), "read_id", total="total")
    return rows.groupBy(F.expr("least(7, before * 8 DIV total)").alias("chunk")).agg(F.count("*").alias("reads"))


def j10_as_of_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT read_id FROM reads")
    starts = rows.where("read_id % 64 = 0").select("read_id", F.col("read_id").cast("long").alias("gstart"))
    return as_of(rows, starts, "read_id", "gstart").where("gstart IS NOT NULL")


# every base, within the read or its batch


def _letters(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return batches.letter_counts(reads(spark, sf_dir), column)


def _quals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir, "qual").select((F.ascii("letter") - 33).alias("q"), "n")


def a02_base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _letters(spark, sf_dir, "seq").select(F.col("letter").alias("base"), "n")


def a03_quality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quals(spark, sf_dir).select(F.col("q").alias("phred"), "n")


def a04_bucketed_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quals(spark, sf_dir).groupBy(F.expr("CAST(q DIV 5 * 5 AS BIGINT)").alias("bucket")).agg(F.sum("n").alias("n"))


def a07_mean_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _quals(spark, sf_dir).agg(F.round(F.sum(F.col("q") * F.col("n")) / F.sum("n"), 9).alias("mean_quality"))


def a11_content_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = _quals(spark, sf_dir).agg((F.sum(F.col("q") * F.col("n")) / F.sum("n")).alias("m"))
    both = mean.crossJoin(view(spark, sf_dir, "SELECT avg(length(qual)) AS l FROM reads"))  # one row each
    return both.selectExpr("CASE WHEN l IS NULL OR l <= 500 THEN 'unknown' WHEN m >= 32 THEN 'pacbio' WHEN m <= 28 THEN 'nanopore' ELSE 'unknown' END AS platform")


def a17_order2_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.context_bits(batches.context_counts(reads(spark, sf_dir), 2), 4)


def a17_order8_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.context_bits(batches.context_counts(reads(spark, sf_dir), 8), 4)


def a18_quality_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.context_bits(batches.quality_counts(reads(spark, sf_dir)), 128)


def a22_redundant_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("q") != F.when(F.col("q") < 25, 15).otherwise(37), F.col("n")).otherwise(0)
    return _quals(spark, sf_dir).agg(F.count("*").alias("levels"), F.round(100 * F.sum(changed) / F.sum("n"), _ROUND).alias("pct_changed"))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.differences(view(spark, sf_dir, f"SELECT read_id, qual, {binned('bin8')} AS rt FROM reads"), "qual", "rt")


def j02_distortion_lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum("n")
    return _differences(spark, sf_dir).agg(F.round(F.sum("total") / n, _ROUND).alias("mae"), F.round(F.sqrt(F.sum("squares") / n), _ROUND).alias("rmse"), F.round(100 * F.sum("changed") / n, _ROUND).alias("pct"))


def a23_distortion_per_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _differences(spark, sf_dir).where("n > 0").select("read_id", F.round(F.col("total") / F.col("n"), _ROUND).alias("mae"), "worst")


def a24_qualdelta(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum("n")
    return _differences(spark, sf_dir).agg(n.alias("nbases"), F.sum("changed").alias("changed"), F.round(F.sum("total") / n, _ROUND).alias("mean_abs"), F.round(F.sqrt(F.sum("squares") / n), _ROUND).alias("rmse"), F.max("worst").alias("worst"))


def f21_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, f"SELECT read_id, seq, {_RC('seq')} AS rc FROM reads")
    return batches.differences(rows, "seq", "rc").where("n > 0").select("read_id", F.col("changed").alias("mism"))


def w06_minimizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT read_id, seq FROM reads WHERE length(seq) >= 24")
    rows = rows.selectExpr("read_id", "transform(sequence(1, length(seq) - 14), i -> md5(substr(seq, i, 15))) AS h")
    rows = rows.selectExpr("read_id", "transform(sequence(1, size(h) - 9), i -> array_min(slice(h, i, 10))) AS m")
    rows = rows.selectExpr("read_id", "posexplode(transform(m, (x, i) -> IF(i = 0 OR x <> m[greatest(i - 1, 0)], x, NULL))) AS (at, h)").where("h IS NOT NULL")
    return rows.selectExpr("read_id", "CAST(at + 10 AS BIGINT) AS i", "h")


def w07_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT read_id, seq FROM reads WHERE length(seq) >= 15")
    rows = rows.selectExpr("read_id", "seq", "transform(sequence(1, length(seq) - 4), i -> md5(substr(seq, i, 5))) AS h")
    rows = rows.selectExpr("read_id", "seq", "explode(filter(sequence(1, length(seq) - 14), i -> array_min(slice(h, i, 11)) IN (h[i - 1], h[i + 9]))) AS i")
    return rows.selectExpr("read_id", "CAST(i AS BIGINT) AS i", "substr(seq, i, 15) AS f")


def w08_homopolymer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.homopolymers(reads(spark, sf_dir))


def w09_quality_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.quality_contexts(reads(spark, sf_dir))


# joins over seeds: the sketch of a read is a row of lists, written once


def _marks(spark: SparkSession, sf_dir: str, table: str = "reads_overlap") -> DataFrame:
    return written(marks.marks(spread(spark, sf_dir, table)))


def _usual(lists: DataFrame) -> DataFrame:
    return written(marks.usual(written(marks.counts(lists))))


def _indexed(spark: SparkSession, sf_dir: str, table: str = "reads_overlap") -> tuple[DataFrame, DataFrame]:
    lists = _marks(spark, sf_dir, table)
    return lists, written(marks.entries(lists, _usual(lists)))


_H = f"{marks.HASH} AS h"


def a31_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = marks.counts(marks.marks(spread(spark, sf_dir, "reads_overlap"))).agg(F.expr("count(*) * 11 DIV 2").alias("genome"))
    both = found.crossJoin(spread(spark, sf_dir, "reads_overlap", "length(seq) AS n").agg(F.sum("n").alias("b")))  # one row each
    return both.selectExpr("genome", "greatest(1, CAST(round(b * 1.0D / greatest(genome, 1)) AS BIGINT) DIV 40) AS stride")


def u04_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _marks(spark, sf_dir)
    return marks.rows(lists).join(_usual(lists), "code").selectExpr("read_id", _H, "pos")


def j06_repeat_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.usual(written(marks.counts(_marks(spark, sf_dir)))).selectExpr(_H, "n")


def j05_fanout_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir)[1].selectExpr(_H, "read_id", "pos", "IF(forward, '+', '-') AS strand")


def j04_shared_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _marks(spark, sf_dir)
    return marks.shared(lists, marks.rows(lists))


def w10_rank_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.shared(*_indexed(spark, sf_dir), most=512).drop("place")


def o09_candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.shared(*_indexed(spark, sf_dir), least=4, most=16)


def o03_sorted_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks.ordered_anchors(*_indexed(spark, sf_dir, "reads"))


FORMS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        o01_cluster_order, o02_apply_order, o10_order_restore, j07_unpermute, w01_duplicate_of_previous, w12_min_canonical, w02_token_delta, c01_name_streams, w03_runs, w05_prefix_offsets, w11_equal_chunks, j10_as_of_chunk,
        a02_base_composition, a03_quality_histogram, a04_bucketed_histogram, a07_mean_quality, a11_content_class, a17_order2_entropy, a17_order8_entropy, a18_quality_entropy, a22_redundant_binning,
        j02_distortion_lockstep, a23_distortion_per_read, a24_qualdelta, f21_mismatches, w06_minimizers, w07_syncmers, w08_homopolymer, w09_quality_context,
        a31_coverage, u04_membership, j06_repeat_filter, j05_fanout_cap, j04_shared_seeds, w10_rank_truncate, o09_candidate_cap, o03_sorted_anchors,
    )
}
