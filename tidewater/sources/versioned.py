"""Versioned Parquet tables: one folder per version and a table of commits.

A version is visible once its commit row exists, so a job that dies while writing leaves no trace
in a read. One writer per table at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.files import list_files

COMMIT_SCHEMA = "version long, commit_ts timestamp_ntz, mode string, num_rows long, num_files int, schema_json string"
PARTITION = "commit_version"


def as_of(commits: DataFrame, version: int | None = None, timestamp: Column | str | None = None) -> DataFrame:
    """The commits a read at a version, or at a time, may see; all of them without either."""
    if version is not None:
        commits = commits.where(F.col("version") <= version)
    if timestamp is not None:
        moment = F.lit(timestamp).cast("timestamp_ntz") if isinstance(timestamp, str) else timestamp
        commits = commits.where(F.col("commit_ts") <= moment)
    return commits


def live_versions(commits: DataFrame) -> DataFrame:
    """Versions that make up the state after the given commits: the last full one and what was appended since."""
    first = commits.agg(F.coalesce(F.max(F.when(F.col("mode") != "append", F.col("version"))), F.lit(0)).alias("base"))
    return commits.where(F.col("version") >= first.scalar()).select("version")


def snapshot(
    data: DataFrame,
    commits: DataFrame,
    version: int | None = None,
    timestamp: Column | str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows of `data(version, …)` at a version or time. The version filter prunes partitions."""
    live = live_versions(as_of(commits, version, timestamp))
    out = data.join(live, "version", "left_semi")
    return out if columns is None else out.select(*columns)


def history(commits: DataFrame, limit: int = 10) -> DataFrame:
    return commits.orderBy(F.desc("version")).limit(limit)


def removable(commits: DataFrame, now: Column | str, retention_hours: int = 168) -> DataFrame:
    """Versions no read within the retention time can see: those before the state at its start."""
    moment = F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now
    at_start = as_of(commits, timestamp=moment - F.make_dt_interval(hours=F.lit(retention_hours)))
    base = at_start.agg(F.max(F.when(F.col("mode") != "append", F.col("version"))).alias("base"))
    return commits.where(F.col("version") < base.scalar())


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(COMMIT_SCHEMA).parquet(f"{path}/commits")
    except AnalysisException:
        return spark.createDataFrame([], COMMIT_SCHEMA)


def write_version(
    df: DataFrame,
    path: str,
    commit_ts: str,
    mode: str = "append",
    partition_by: Sequence[str] = (),
    schema_mode: str = "merge",
) -> int:
    """Write the next version and commit it. `append` adds to the state, `overwrite` replaces it.

    `error` refuses a table that exists. With `merge`, new columns are added and old ones keep their
    type; `overwrite` as schema mode replaces the schema and needs a full write.
    """
    if mode not in ("append", "overwrite", "error") or schema_mode not in ("merge", "overwrite"):
        raise ValueError(f"unknown mode {mode} or schema mode {schema_mode}")
    spark = df.sparkSession
    commits = read_commits(spark, path)
    last = commits.agg(F.max("version")).first()[0]
    if mode == "error" and last is not None:
        raise ValueError(f"table {path} exists")
    if mode == "append" and schema_mode == "overwrite":
        raise ValueError("an append cannot replace the schema")
    if mode == "append" and last is not None:
        merge_schemas([_state_schema(commits), df.schema])
    return _commit(df, path, 0 if last is None else last + 1, commit_ts, "append" if mode == "append" else "overwrite", partition_by)


def _commit(df: DataFrame, path: str, version: int, commit_ts: str, mode: str, partition_by: Sequence[str]) -> int:
    spark = df.sparkSession
    target = f"{path}/data/{PARTITION}={version}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    num_rows = spark.read.schema(df.schema).parquet(target).count()
    num_files = list_files(spark, target, "*.parquet").count()
    row = spark.range(1).select(
        F.lit(version).cast("long").alias("version"),
        F.lit(commit_ts).cast("timestamp_ntz").alias("commit_ts"),
        F.lit(mode).alias("mode"),
        F.lit(num_rows).cast("long").alias("num_rows"),
        F.lit(num_files).cast("int").alias("num_files"),
        F.lit(df.schema.json()).alias("schema_json"),
    )
    row.write.mode("append").parquet(f"{path}/commits")
    return version


def merge_schemas(schemas: Sequence[T.StructType]) -> T.StructType:
    """Columns of all schemas in order of appearance; a column with two types is an error."""
    fields: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema.fields:
            known = fields.setdefault(f.name, T.StructField(f.name, f.dataType, True))
            if known.dataType.simpleString() != f.dataType.simpleString():
                raise ValueError(f"column {f.name} is {known.dataType.simpleString()}, not {f.dataType.simpleString()}")
    return T.StructType(list(fields.values()))


def _state_schema(commits: DataFrame) -> T.StructType:
    rows = commits.join(live_versions(commits), "version", "left_semi").orderBy("version").select("schema_json").distinct()
    return merge_schemas([T.StructType.fromJson(json.loads(r["schema_json"])) for r in rows.collect()])


def read_version(
    spark: SparkSession,
    path: str,
    version: int | None = None,
    timestamp: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Read the latest state, or that of a version or time, with the columns asked for."""
    commits = as_of(read_commits(spark, path), version, timestamp)
    live = [r["version"] for r in live_versions(commits).orderBy("version").collect()]
    if not live or (version is not None and commits.where(F.col("version") == version).isEmpty()):
        raise ValueError(f"table {path} has no such version")
    # The schema comes from the commits, so no file footer is read to plan the scan.
    schema = _state_schema(commits)
    folders = [f"{path}/data/{PARTITION}={v}" for v in live]
    table = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders)
    return table.select(*(columns or schema.names))


def vacuum(spark: SparkSession, path: str, now: str, retention_hours: int = 168, dry_run: bool = True) -> list[int]:
    """Versions that may go, oldest first; without `dry_run` their folders are deleted.

    Their commit rows stay as history. A read of such a version then fails on the missing folder.
    """
    doomed = removable(read_commits(spark, path), now, retention_hours).orderBy("version")
    versions = [r["version"] for r in doomed.select("version").collect()]
    if not dry_run:
        hadoop = spark._jvm.org.apache.hadoop.fs
        for version in versions:
            folder = hadoop.Path(f"{path}/data/{PARTITION}={version}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return versions


def compact(
    spark: SparkSession, path: str, commit_ts: str, target_size: int = 128 * 1024 * 1024, partition_by: Sequence[str] = ()
) -> dict[str, int]:
    """Rewrite the state in files of about `target_size`, as a new version.

    The scan packs small files into tasks of that size, so the rows are not shuffled.
    """
    commits = read_commits(spark, path)
    before = commits.join(live_versions(commits), "version", "left_semi").agg(F.sum("num_files")).first()[0]
    settings = {
        "spark.sql.files.maxPartitionBytes": str(target_size),
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.minPartitionNum": "1",
    }
    saved = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        last = commits.agg(F.max("version")).first()[0]
        version = _commit(read_version(spark, path), path, last + 1, commit_ts, "overwrite", partition_by)
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    after = read_commits(spark, path).where(F.col("version") == version).first()["num_files"]
    return {"version": version, "files_before": int(before), "files_after": int(after)}


def statistics(df: DataFrame, files: DataFrame, version: Column | int | None = None) -> DataFrame:
    """Rows, columns, bytes, schema and version of a table, as one row."""
    schema = json.dumps({f.name: f.dataType.simpleString() for f in df.schema.fields})
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("size"))
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        "num_rows",
        F.lit(len(df.columns)).alias("num_columns"),
        size.scalar().alias("size_bytes"),
        F.lit(schema).alias("schema"),
        (version if isinstance(version, Column) else F.lit(version).cast("long")).alias("version"),
    )


def table_statistics(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of the latest state of a versioned table."""
    commits = read_commits(spark, path)
    live = live_versions(commits)
    folder = F.regexp_extract("path", rf"/{PARTITION}=(\d+)/", 1).cast("long")
    files = list_files(spark, f"{path}/data", "*.parquet").withColumn("version", folder).join(live, "version", "left_semi")
    return statistics(read_version(spark, path), files, commits.agg(F.max("version")).scalar())
