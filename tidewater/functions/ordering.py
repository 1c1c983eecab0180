"""Ordered per-key computations that do not send one key to one task.

A window over a key alone puts every row of a hot key into one task. Here the key is cut into
slices (a day, a range of ids): rows are ordered inside a slice, and one summary row per slice
carries the state across slice borders. Only the summary rows are ordered per key.
The slice must be a non-decreasing function of the first ordering column. Null keys are a key like any other, and a null
ordering value comes first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import checkpointed


def _same_key(rows: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the columns of their key's summary row, null keys included."""
    renamed = summary.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return rows.join(renamed, reduce(lambda a, b: a & b, same), "left").drop(*[f"_right_{k}" for k in keys])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    values: Sequence[str],
    name: str = "previous",
    following: bool = False,
) -> DataFrame:
    """Add a struct column with `values` of the preceding (or following) row of the same key."""
    sliced = df.withColumn("_slice", slice_by)
    position = F.struct(*order)
    picked = F.struct(*values)
    edge = F.min_by(picked, position) if following else F.max_by(picked, position)
    step = F.lead if following else F.lag
    edges = (
        sliced.groupBy(*keys, "_slice")
        .agg(edge.alias("_edge"))
        .withColumn("_edge", step("_edge").over(W.partitionBy(*keys).orderBy("_slice")))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        _same_key(sliced, edges, [*keys, "_slice"])
        .withColumn(name, F.coalesce(step(picked).over(inside), F.col("_edge")))
        .drop("_slice", "_edge")
    )


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    slice_by: Column,
    value: Column,
    name: str,
) -> DataFrame:
    """Add the running sum of `value` per key, in order, the current row included."""
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _same_key(sliced, offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
        .drop("_slice", "_offset", "_value")
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First `k` rows per group; Spark keeps only `k` rows per group and task before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column, value: Column, name: str
) -> DataFrame:
    """Add the last non-null `value` of the key at or before each row: the as-of look-up."""
    sliced = df.withColumn("_slice", slice_by).withColumn("_value", value)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    edges = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_edge"))
        .withColumn("_edge", F.last("_edge", ignorenulls=True).over(before))
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _same_key(sliced, edges, [*keys, "_slice"])
        .withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(inside), F.col("_edge")))
        .drop("_slice", "_edge", "_value")
    )


def running_sum_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add the running sum of `value` per key, in order, the current row included, for an order without natural slices.

    Rows go to ranges of (keys, order); each range is summed on its own, and one row a key and range carries the sum on.
    The ranges are written to the checkpoint folder, as Spark would draw their borders anew for each use.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_value", value).repartitionByRange(partitions, *(F.col(k) for k in keys), *order)
    placed = checkpointed(ranged.withColumn("_slice", F.spark_partition_id()))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys, "_slice")
        .agg(F.sum("_value").alias("_total"))
        .withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return (
        _same_key(placed, offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
        .drop("_slice", "_offset", "_value")
    )
