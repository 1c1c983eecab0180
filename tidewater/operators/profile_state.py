"""A quality profile that grows by batches: each batch leaves a state, and states add up; no batch is read twice.

The state of a batch is a row of counts and extremes, the different values of each numeric column with how often they
occur, and the different rows by their hash with how often they occur. Counts add, extremes combine, values and hashes
are counted together. What a profile asks for, the quartiles and the rows beyond them included, follows exactly.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.profile import Thresholds, check_rows_of, check_rules, comparable, outlier_limits, report_of
from tidewater.session import checkpointed, file_system

QUARTILES = (0.25, 0.75)
JSON_OPTIONS = {
    "ignoreNullFields": "false",
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def batch_counts(table: DataFrame) -> DataFrame:
    """One row: `n`, and per column i `null_i`, `empty_i` for text, `min_i` and `max_i`."""
    rows = table.toDF(*[f"c{i}" for i in range(len(table.columns))])
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, field in enumerate(table.schema.fields):
        value = F.col(f"c{i}")
        aggregates += [F.count_if(value.isNull()).alias(f"null_{i}"), F.min(value).alias(f"min_{i}"), F.max(value).alias(f"max_{i}")]
        if isinstance(field.dataType, T.StringType):
            aggregates.append(F.count_if(F.coalesce(F.length(value) == 0, F.lit(False))).alias(f"empty_{i}"))
    return rows.agg(*aggregates)


def batch_values(table: DataFrame) -> DataFrame:
    """(column, value, n): the different values of the numeric columns, by position, and how often each occurs."""
    numeric = [(i, f"`{f.name}`") for i, f in enumerate(table.schema.fields) if isinstance(f.dataType, T.NumericType)]
    cells = [F.struct(F.lit(i).alias("column"), F.col(name).cast("double").alias("value")) for i, name in numeric]
    empty = F.array().cast("array<struct<column:int,value:double>>")
    opened = table.select(F.inline(F.array(*cells) if cells else empty)).where("value IS NOT NULL")
    return opened.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def batch_rows(table: DataFrame) -> DataFrame:
    """(hash, n): the different rows by the sha256 of their values, and how often each occurs."""
    rows = table.toDF(*[f"c{i}" for i in range(len(table.columns))])
    # Negative zero equals zero; written as JSON with nulls kept, values cannot run into each other.
    zero = {f"c{i}": F.col(f"c{i}") + F.lit(0.0).cast(f.dataType) for i, f in enumerate(table.schema.fields) if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    rows = rows.withColumns(zero) if zero else rows
    whole = F.sha2(F.to_json(F.struct(*rows.columns), JSON_OPTIONS), 256)
    return rows.select(F.unhex(whole).alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))


def add_batch(df: DataFrame, path: str, batch: str) -> None:
    """Read a batch once for each table of its state and write them below `path`; writing a batch again replaces it.

    The counts are written last: a batch without them does not count, so a failed run leaves no half state. All batches
    must have the columns and types of the first.
    """
    spark = df.sparkSession
    table = comparable(df)
    known = _schema(spark, path)
    if known is not None and known != table.schema.json():
        raise ValueError("the batch has other columns or types than the ones before")
    batch_values(table).write.mode("overwrite").parquet(f"{path}/values/batch={batch}")
    batch_rows(table).write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")
    noted = batch_counts(table).withColumn("schema", F.lit(table.schema.json()))
    noted.coalesce(1).write.mode("overwrite").parquet(f"{path}/counts/batch={batch}")


def _schema(spark: SparkSession, path: str) -> str | None:
    files, place = file_system(spark, f"{path}/counts")
    if not files.exists(place):
        return None
    return spark.read.parquet(f"{path}/counts").select("schema").first()["schema"]


class StoredProfile:
    """The profile of all batches below `path`, from their states alone."""

    def __init__(self, spark: SparkSession, path: str, rules: Mapping[str, Mapping[str, Any]] | None = None):
        noted = _schema(spark, path)
        if noted is None:
            raise ValueError(f"no batch below {path}")
        self.schema = T.StructType.fromJson(json.loads(noted))
        self.rules = check_rules(self.schema, rules)
        counts = spark.read.parquet(f"{path}/counts")
        batches = [r["batch"] for r in counts.select(F.col("batch").cast("string")).collect()]
        counted = lambda name: spark.read.parquet(f"{path}/{name}").where(F.col("batch").cast("string").isin(batches))
        self.counts = counts
        self.values = checkpointed(counted("values").groupBy("column", "value").agg(F.sum("n").alias("n")))
        self.rows = counted("rows").groupBy("hash").agg(F.sum("n").alias("n"))
        self.bounds = self._bounds()

    def _bounds(self) -> dict[str, tuple[float, float] | None]:
        """Outlier bounds from exact quartiles: ranks are found in ranges of (column, value), summed range by range."""
        totals = {r["column"]: r["n"] for r in self.values.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        wanted: dict[tuple[int, int], float] = {}
        for column, n in totals.items():
            for p in QUARTILES:
                for rank in (math.floor(p * (n - 1)), math.ceil(p * (n - 1))):
                    wanted[column, rank] = math.nan
        if wanted:
            partitions = int(self.values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            ranged = checkpointed(self.values.repartitionByRange(partitions, "column", "value").withColumn("part", F.spark_partition_id()))
            before = W.partitionBy("column").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
            offsets = ranged.groupBy("column", "part").agg(F.sum("n").alias("_total"))
            offsets = offsets.withColumn("_offset", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
            here = W.partitionBy("column", "part").orderBy("value").rowsBetween(W.unboundedPreceding, 0)
            upto = ranged.join(offsets, ["column", "part"]).withColumn("upto", F.col("_offset") + F.sum("n").over(here))
            asked = reduce(
                lambda a, b: a | b,
                [(F.col("column") == c) & (F.col("upto") > r) & (F.col("upto") - F.col("n") <= r) for c, r in wanted],
            )
            for row in upto.where(asked).select("column", "value", "n", "upto").collect():
                for column, rank in wanted:
                    if column == row["column"] and row["upto"] - row["n"] <= rank < row["upto"]:
                        wanted[column, rank] = row["value"]
        bounds: dict[str, tuple[float, float] | None] = {}
        for i, field in enumerate(self.schema.fields):
            if not isinstance(field.dataType, T.NumericType):
                continue
            n = totals.get(i, 0)
            bounds[field.name] = outlier_limits(*(_between(wanted, i, p * (n - 1)) for p in QUARTILES)) if n else None
        return bounds

    def measure(self) -> DataFrame:
        """The row that `profile.measure` gives for all batches together."""
        sums = [F.sum("n").alias("n")]
        for i, field in enumerate(self.schema.fields):
            low, high = F.min(f"min_{i}"), F.max(f"max_{i}")
            sums += [F.sum(f"null_{i}").alias(f"null_{i}"), F.coalesce(low == high, F.lit(False)).alias(f"constant_{i}")]
            if isinstance(field.dataType, T.StringType):
                sums.append(F.sum(f"empty_{i}").alias(f"empty_{i}"))
            for name, bound in self.rules.get(field.name, {}).items():
                broken = low < F.lit(bound) if name == "min" else high > F.lit(bound)
                sums.append(F.coalesce(broken, F.lit(False)).alias(f"{name}_{i}"))
        out = self.counts.agg(*sums)
        outside = []
        for i, field in enumerate(self.schema.fields):
            if self.bounds.get(field.name):
                low, high = self.bounds[field.name]
                beyond = (F.col("column") == i) & ((F.col("value") < F.lit(low)) | (F.col("value") > F.lit(high)))
                outside.append(F.coalesce(F.sum(F.when(beyond, F.col("n"))), F.lit(0)).alias(f"outlier_{i}"))
        if outside:
            found = self.values.agg(*outside).first()
            out = out.withColumns({name: F.lit(found[name]).cast("long") for name in found.asDict()})
        repeats = self.rows.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).first()["d"]
        return out.withColumn("duplicates", F.lit(repeats).cast("long"))

    def check_rows(self) -> DataFrame:
        return check_rows_of(self.schema, self.measure(), self.bounds, self.rules)

    def report(self, threshold: float = 70.0, thresholds: Thresholds = Thresholds()) -> DataFrame:
        return report_of(self.schema, self.measure(), self.bounds, self.rules, threshold, thresholds)


def _between(known: dict[tuple[int, int], float], column: int, position: float) -> float:
    low, high = known[column, math.floor(position)], known[column, math.ceil(position)]
    share = position - math.floor(position)
    if low == high or not share:
        return low
    if math.isinf(low) or math.isinf(high):
        return low * (1 - share) + high * share
    return low + (high - low) * share
