"""Helpers that the corpus operators share: the shared scratch folder, tables
written there to cut lineage, and connected components."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
#: The six blank characters that part words.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is
    unset a folder of this machine is taken, which only a local master allows."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="readloom-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no
    more than the stage it was in. :meth:`drop` removes one that no later
    plan reads; the others stay as long as Spark's own checkpoints do."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, str] = {}

    def cut(self, frame: DataFrame) -> DataFrame:
        path = shared_path(self.spark, "cut")
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def release(self) -> None:
        """Lets Spark remove the shuffle files of plans that nothing holds any
        more; call it where a large exchange has been cut."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, frame: DataFrame) -> None:
        path = self._paths.pop(id(frame), None)
        if path:
            jvm = self.spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest
    node that can be reached.

    Alternating large-star and small-star steps: each hangs the neighbours of
    a node on the smallest of them. The minima are combined before they are
    shuffled and the joins are plain equi-joins, so a hub's rows may be split.
    Ends when a round leaves the edges as they were.
    """
    now = scratch.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        after = scratch.cut(small.select("e.a", F.col("e.m").alias("b")).where("a <> b").distinct())
        seen = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = after
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = seen
