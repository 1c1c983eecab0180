"""Free SQL over tables and files, named views, export, and relational databases."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.sources.files import read_file


def register_views(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run(spark: SparkSession, sql: str, **parameters: Any) -> DataFrame:
    """Run SQL; `:name` parameters are bound, never pasted into the text."""
    return spark.sql(sql, args=parameters) if parameters else spark.sql(sql)


def query_path(spark: SparkSession, path: str, sql: str = "SELECT * FROM {{path}}", **parameters: Any) -> DataFrame:
    """Run SQL on a file or table folder that the text calls `{{path}}`; a path without suffix is Parquet."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    source = read_file(spark, path) if "." in last else spark.read.parquet(path)
    view = f"path_{uuid4().hex}"
    source.createOrReplaceTempView(view)
    try:
        return run(spark, sql.replace("{{path}}", view), **parameters)
    finally:
        spark.catalog.dropTempView(view)


def create_view(spark: SparkSession, name: str, sql: str) -> DataFrame:
    df = spark.sql(sql)
    df.createOrReplaceTempView(name)
    return df


def export(spark: SparkSession, sql: str, path: str, mode: str = "error") -> str:
    """Write a query's result to Parquet."""
    spark.sql(sql).write.mode(mode).parquet(path)
    return path


def describe(df: DataFrame) -> DataFrame:
    """Columns, types and nullability of a table as rows."""
    rows = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.lit(f.nullable).alias("nullable"))
        for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def jdbc_read_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
    **extra: Any,
) -> dict[str, str]:
    """Options of a parallel read; `table` is a name or a sub-query in parentheses with an alias."""
    options = {"url": url, "dbtable": table, "fetchsize": fetch_size, **extra}
    if partition_column is not None:
        if lower is None or upper is None or partitions < 2:
            raise ValueError("a partitioned read needs both bounds and at least two partitions")
        options |= {"partitionColumn": partition_column, "lowerBound": lower, "upperBound": upper, "numPartitions": partitions}
    return {key: str(value) for key, value in options.items()}


def jdbc_write_options(url: str, table: str, batch_size: int = 10_000, partitions: int = 16, **extra: Any) -> dict[str, str]:
    options = {"url": url, "dbtable": table, "batchsize": batch_size, "numPartitions": partitions, **extra}
    return {key: str(value) for key, value in options.items()}


def read_database(spark: SparkSession, **options: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_read_options(**options)).load()


def write_database(df: DataFrame, mode: str = "append", **options: Any) -> None:
    df.write.format("jdbc").mode(mode).options(**jdbc_write_options(**options)).save()


class Functions:
    """Named functions callable from SQL: scalar or Arrow pandas UDFs."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._known: dict[str, Callable] = {}

    def register(self, name: str, function: Callable, return_type: str | None = None) -> Callable:
        self._known[name] = self.spark.udf.register(name, function, return_type) if return_type else self.spark.udf.register(name, function)
        return self._known[name]

    def get(self, name: str) -> Callable | None:
        return self._known.get(name)

    def names(self) -> list[str]:
        return list(self._known)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """Apply a function to pandas batches; the batches replace the rows, so columns may be dropped or added."""

    def each(batches):
        for batch in batches:
            yield function(batch)

    return df.mapInPandas(each, schema)
