"""Connected components of an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node
    that can be reached. Every node takes the least of its own and its
    neighbours' roots, and then the root of that root, until none changes; the
    steps are logarithmic in the length of a chain but for a constant."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("r")))
    while True:
        seen = both.join(roots.select(F.col("a").alias("b"), "r"), "b").groupBy("a").agg(F.min("r").alias("near"))
        better = roots.join(seen, "a").select("a", F.least("r", "near").alias("r"), F.col("r").alias("old"))
        # what a root has found, all that have it take over; and roots are followed one step on
        found = better.groupBy(F.col("old").alias("root")).agg(F.min("r").alias("least"))
        hooked = better.join(found, better["old"] == found["root"]).select("a", F.least("r", "least").alias("r"), "old")
        jumped = hooked.join(hooked.select(F.col("a").alias("r"), F.col("r").alias("further")), "r", "left").select("a", F.coalesce("further", "r").alias("new"), "old")
        after = written(jumped)
        roots = after.select("a", F.col("new").alias("r"))
        if after.where("new <> old").isEmpty():
            return roots.select(F.col("a").alias("node"), F.col("r").alias("root"))
