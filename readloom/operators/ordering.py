"""Global order without a global window: rows are range-partitioned by the sort
key and written in order; what a window over all rows would carry from row to
row is computed within the ranges and carried over from one to the next in a
table of a row per range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

_ROW = (1 << 33) - 1


def ordered(frame: DataFrame, *keys: Column | str) -> DataFrame:
    """frame, written in the order of keys, with _range and _place, the place
    within it. keys should tell rows apart: equal ones are in any order."""
    rows = frame.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    return written(rows.select("*", F.spark_partition_id().alias("_range"), place.bitwiseAND(F.lit(_ROW)).alias("_place")))


def _with(rows: DataFrame, table: list[tuple], schema: str) -> DataFrame:
    """rows with the columns of a table that has a row per range."""
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(table, f"_range int, {schema}")), "_range")


def numbered(frame: DataFrame, *keys: Column | str, name: str = "pos") -> DataFrame:
    """frame with a long, 1, 2, .. in the order of keys over all rows."""
    rows, table, before = ordered(frame, *keys), [], 0
    for r in sorted(rows.groupBy("_range").count().collect()):  # a row per range
        table.append((r["_range"], before))
        before += r["count"]
    return _with(rows, table, "_before long").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_range", "_place", "_before")


def running_sum(frame: DataFrame, value: Column, *keys: Column | str, name: str = "before", total: str | None = None) -> DataFrame:
    """frame with the sum of value over all rows before this one in the order of
    keys, and over all rows if total is named."""
    rows, table, before = ordered(frame.withColumn("_value", value.cast("long")), *keys), [], 0
    for r in sorted(rows.groupBy("_range").agg(F.coalesce(F.sum("_value"), F.lit(0)).alias("s")).collect()):
        table.append((r["_range"], before))
        before += r.s
    within = F.sum("_value").over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1))
    out = _with(rows, table, "_before long").withColumn(name, F.col("_before") + F.coalesce(within, F.lit(0)))
    out = out.withColumn(total, F.lit(before).cast("long")) if total else out
    return out.drop("_range", "_place", "_before", "_value")


def with_previous(frame: DataFrame, value: Column, *keys: Column | str, name: str = "previous", ignore_nulls: bool = False) -> DataFrame:
    """frame with value of the row before this one in the order of keys, null
    for the first; with ignore_nulls that of the last row, this one included,
    that has one."""
    rows = ordered(frame.withColumn("_value", value), *keys)
    window = Window.partitionBy("_range").orderBy("_place")
    ends = rows.where(F.col("_value").isNotNull()) if ignore_nulls else rows
    kind = rows.schema["_value"].dataType.simpleString()
    held = {r["_range"]: r.v for r in ends.groupBy("_range").agg(F.max_by(F.struct("_value"), "_place").alias("v")).collect()}
    table, last = [], None
    for k in sorted(r["_range"] for r in rows.select("_range").distinct().collect()):
        table.append((k, last))
        last = held[k]["_value"] if k in held else last
    if ignore_nulls:
        found = F.coalesce(F.last("_value", ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_carried")
    else:
        found = F.when(F.col("_place") == 0, F.col("_carried")).otherwise(F.lag("_value").over(window))
    return _with(rows, table, f"_carried {kind}").withColumn(name, found).drop("_range", "_place", "_carried", "_value")


def as_of(left: DataFrame, right: DataFrame, key: str, *columns: str) -> DataFrame:
    """left with columns of the last row of right whose key is not larger; a row
    of right is one per key. Null where there is none."""
    both = left.select(key, F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_right"))
    both = both.unionByName(right.select(key, F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_left"].dataType).alias("_left"), F.struct(*columns).alias("_right")))
    found = with_previous(both, F.col("_right"), key, "_side", name="_found", ignore_nulls=True).where("_side = 1")
    return found.select("_left.*", *[F.col("_found")[c].alias(c) for c in columns])
