"""Reading files by suffix, listing files, audit logs."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.governance import AUDIT_SCHEMA
from tidewater.session import file_system
from tidewater.sources.quoted import read_csv


def read_file(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool | None = None
) -> DataFrame:
    """Read csv, json, jsonl or parquet by suffix; any other suffix is an error.

    Without a schema, csv and json are scanned once more to infer it. A csv value may hold line breaks in quotes; the
    file is read by many tasks all the same (`quoted`). With `multi_line` a csv file is read by one task, and without
    it (False) by lines, which breaks such values. A json file is one document read by one task unless that is False.
    """
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if suffix == ".csv" and multi_line is None:
        return read_csv(spark, path, schema)
    if suffix == ".csv":
        return reader.csv(path, header=True, inferSchema=schema is None, multiLine=bool(multi_line), escape='"')
    if suffix == ".json":
        return reader.json(path, multiLine=multi_line is not False)
    if suffix == ".jsonl":
        return reader.json(path)
    if suffix == ".parquet":
        return reader.parquet(path)
    raise ValueError(f"unsupported file type: {suffix or path}")


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path, length and modification time of the files below a path; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select("path", "length", "modificationTime")
    )


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    return list_files(spark, path).agg(
        F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("size_bytes")
    )


def _old_files(spark: SparkSession, path: str, cutoff: Column, pattern: str) -> DataFrame:
    return list_files(spark, path, pattern).where(F.col("modificationTime") < cutoff)


def expire_files(spark: SparkSession, path: str, cutoff: Column, pattern: str = "*", dry_run: bool = True) -> dict:
    """Delete the files below a path that were last changed before `cutoff`; with `dry_run` only say what would go.

    Gives deleted_count, deleted_size_mb and dry_run. Names come to the driver one after the other; a file that is gone
    by then does not count.
    """
    count = size = 0
    for row in _old_files(spark, path, cutoff, pattern).toLocalIterator():
        files, place = file_system(spark, row["path"])
        if dry_run or files.delete(place, False):
            count += 1
            size += row["length"]
    return {"deleted_count": count, "deleted_size_mb": round(size / 1024**2, 2), "dry_run": dry_run}


def archive_files(spark: SparkSession, path: str, archive_path: str, cutoff: Column, pattern: str = "*") -> dict:
    """Move the files below a path that match and were last changed before `cutoff` to the same places below the archive.

    Gives archived_count and archive_dir. A file that lies there already is an error, so that none is lost; a run that
    broke off is ended by the next one.
    """
    count = 0
    files, root = file_system(spark, path)
    root = files.makeQualified(root)
    target_files, target_root = file_system(spark, archive_path)
    make = spark._jvm.org.apache.hadoop.fs.Path
    for row in _old_files(spark, path, cutoff, pattern).toLocalIterator():
        source = files.makeQualified(make(row["path"]))
        inside = root.toUri().relativize(source.toUri()).getPath()
        target = make(target_root, inside)
        if target_files.exists(target):
            raise FileExistsError(f"{target} is there already")
        target_files.mkdirs(target.getParent())
        moved = spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, source, target_files, target, True, spark._jsc.hadoopConfiguration())
        count += bool(moved)
    return {"archived_count": count, "archive_dir": archive_path}


def read_audit(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Audit events from JSON lines, lines that do not parse left out."""
    lines = spark.read.text(path)
    if category is not None and "log_category" in lines.columns:
        lines = lines.where(F.col("log_category") == category)
    schema = T.StructType([*AUDIT_SCHEMA.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = lines.where(F.length(F.trim("value")) > 0).select(F.from_json("value", schema).alias("e"))
    events = parsed.where("e is not null and e._corrupt_record is null").select("e.*").drop("_corrupt_record")
    return events if category is None else events.where(F.col("category") == category)


def write_audit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, one folder per category so that a query reads only its own."""
    events.withColumn("log_category", F.col("category")).write.mode("append").partitionBy("log_category").json(path)
