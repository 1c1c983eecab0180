"""The dataset catalog and validation log: append-only tables read by their newest row."""

from __future__ import annotations

import json
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.ordering import top_per_group
from tidewater.functions.text import UNNAMED, from_safe_dir_name
from tidewater.session import file_system
from tidewater.sources.files import list_files, read_file

CATALOG_SCHEMA = (
    "dataset_id string, name string, path string, num_rows long, columns array<string>, text_column string, "
    "label_column string, source_file string, quality_status string, quality_score double, report_path string, "
    "registered_at timestamp_ntz, deleted boolean"
)
# Folders that hold a split of the dataset above them.
SPLIT_FOLDER = "/(train|validation|test)$"
DESCRIPTION_SCHEMA = (
    "dataset_id string, path string, num_rows long, num_columns int, columns array<string>, size_mb double, splits array<string>"
)
VALIDATION_SCHEMA = (
    "dataset_id string, dataset_name string, status string, quality_score double, report_path string, "
    "issues string, created_at timestamp_ntz"
)


def safe_name(dataset_id: str) -> str:
    """Folder name of a dataset id; an empty one has a name of its own."""
    return dataset_id.replace("/", "--") or UNNAMED


def read_catalog(spark: SparkSession, root: str, deleted: bool = False) -> DataFrame:
    """One row per dataset, its newest; deleted ones only on request. Columns an older row lacks are null."""
    if not path_exists(spark, f"{root}/catalog"):
        return spark.createDataFrame([], CATALOG_SCHEMA)
    rows = spark.read.schema(CATALOG_SCHEMA).parquet(f"{root}/catalog")
    newest = top_per_group(rows, ["dataset_id"], [F.desc("registered_at"), F.desc("deleted"), F.col("path")], 1, "_n").drop("_n")
    return newest if deleted else newest.where("deleted IS NOT TRUE")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, on any store that Spark reads."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(name)


def delete_dataset(spark: SparkSession, root: str, dataset_id: str, deleted_at: str) -> bool:
    """Take a dataset out of the catalog; its files stay for a clean-up. False if it was not there."""
    return _change(spark, root, dataset_id, registered_at=deleted_at, deleted=True)


def update_quality(
    spark: SparkSession, root: str, dataset_id: str, updated_at: str, status: str, score: float, report_path: str | None = None
) -> bool:
    """Set the quality of a catalogued dataset; False if it is not there."""
    changes = {"quality_status": status, "quality_score": score, "registered_at": updated_at}
    return _change(spark, root, dataset_id, **changes, **({"report_path": report_path} if report_path else {}))


def _change(spark: SparkSession, root: str, dataset_id: str, **changes) -> bool:
    """Append the dataset's newest row with changes."""
    row = read_catalog(spark, root).where(F.col("dataset_id") == F.lit(dataset_id)).first()
    if row is None:
        return False
    values = {k: v for k, v in row.asDict().items() if k != "columns"} | changes
    _append(spark, f"{root}/catalog", CATALOG_SCHEMA, values, {"columns": row["columns"] or []})
    return True


def register(
    df: DataFrame,
    root: str,
    dataset_id: str,
    registered_at: str,
    text_column: str = "text",
    label_column: str | None = None,
    path: str | None = None,
    written: bool = False,
    **extra,
) -> str:
    """Write a table under its id and add it to the catalog. `written` skips the write of data already at `path`."""
    spark = df.sparkSession
    path = path or f"{root}/datasets/{safe_name(dataset_id)}"
    if not written:
        df.write.mode("overwrite").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    values = {
        "dataset_id": dataset_id, "name": dataset_id, "path": path, "num_rows": stored.count(),
        "text_column": text_column, "label_column": label_column, "registered_at": registered_at, **extra,
    }
    _append(spark, f"{root}/catalog", CATALOG_SCHEMA, values, {"columns": df.columns})
    return path


def import_file(
    spark: SparkSession,
    root: str,
    file_path: str,
    dataset_id: str,
    registered_at: str,
    text_column: str = "text",
    label_column: str | None = None,
) -> str:
    """Import a csv, json, jsonl or parquet file under a name."""
    return register(
        read_file(spark, file_path), root, dataset_id, registered_at, text_column, label_column, source_file=file_path
    )


def record_validation(spark: SparkSession, root: str, created_at: str, issues: list | None = None, **values) -> None:
    """Append one validation outcome."""
    row = {**values, "issues": json.dumps(issues or []), "created_at": created_at}
    _append(spark, f"{root}/validations", VALIDATION_SCHEMA, row)


def append_records(df: DataFrame, path: str) -> None:
    """Append a batch of log or metric rows."""
    df.write.mode("append").parquet(path)


def read_validations(spark: SparkSession, root: str) -> DataFrame:
    if not path_exists(spark, f"{root}/validations"):
        return spark.createDataFrame([], VALIDATION_SCHEMA)
    return spark.read.schema(VALIDATION_SCHEMA).parquet(f"{root}/validations")


def _append(spark: SparkSession, path: str, schema: str, values: Mapping, lists: Mapping | None = None) -> None:
    empty = spark.createDataFrame([], schema).schema
    unknown = set(values) - set(empty.names)
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    columns = []
    for f in empty.fields:
        value = F.array(*[F.lit(v) for v in lists[f.name]]) if lists and f.name in lists else F.lit(values.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    spark.range(1).select(*columns).write.mode("append").parquet(path)


def discover_datasets(spark: SparkSession, root: str) -> DataFrame:
    """The Parquet datasets below a folder: dataset_id, path, num_rows, n_files, size_mb, splits.

    A dataset is a folder with Parquet files, itself or in `column=value` folders; a folder named as a split (`train`,
    `validation`, `test`) belongs to the one above. The id is the path below the root, `--` read as `/`; of ids that
    differ in case the first by path counts. Files are listed once and counted from their footers in one job, whatever
    the number of datasets; no column is read.
    """
    files, place = file_system(spark, root)
    base = files.makeQualified(place).toUri().getPath().rstrip("/")
    inside = F.substring_index("file", f"{base}/", -1)
    # What follows the dataset's folder: partitions, then maybe a split, then the file.
    parted = F.regexp_replace(inside, r"(/[^/=]+=[^/]*)*/[^/]+$", "")
    split = F.regexp_extract(parted, SPLIT_FOLDER, 1)
    folder = F.regexp_replace(parted, SPLIT_FOLDER, "")
    listed = list_files(spark, root, "*.parquet").select(F.col("path").alias("file"), "length")
    counted = (
        spark.read.schema("_none string")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .parquet(root)
        .groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    placed = listed.where(inside.contains("/")).select("file", "length", folder.alias("folder"), split.alias("split"))
    found = (
        placed.join(counted, "file", "left")
        .groupBy("folder")
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("num_rows"),
            F.count(F.lit(1)).alias("n_files"),
            (F.sum("length") / 1024**2).alias("size_mb"),
            F.sort_array(F.collect_set(F.when(F.col("split") == "", "train").otherwise(F.col("split")))).alias("splits"),
        )
        .withColumn("dataset_id", from_safe_dir_name(F.col("folder")))
    )
    named = found.withColumn("_key", F.lower("dataset_id"))
    return top_per_group(named, ["_key"], [F.col("folder")], 1).select(
        "dataset_id", F.concat(F.lit(f"{root.rstrip('/')}/"), "folder").alias("path"), "num_rows", "n_files", "size_mb", "splits"
    )


def describe_datasets(spark: SparkSession, datasets: Mapping[str, str], split: str = "split") -> DataFrame:
    """Rows, columns, size and splits of the Parquet datasets `{id: path}`.

    Ids that differ in case or `/` against `--` name one dataset: the first listed wins. For a survey of some datasets;
    a whole catalog has its row counts in `read_catalog`, without a scan.
    """
    parts, seen = [], set()
    for dataset_id, path in datasets.items():
        if safe_name(dataset_id).lower() in seen:
            continue
        seen.add(safe_name(dataset_id).lower())
        df = spark.read.parquet(path)
        size = list_files(spark, path).agg(F.sum("length"))
        splits = F.sort_array(F.collect_set(split)) if split in df.columns else F.array(F.lit("train"))
        parts.append(
            df.agg(F.count(F.lit(1)).alias("num_rows"), splits.alias("splits")).select(
                F.lit(dataset_id).alias("dataset_id"), F.lit(path).alias("path"), "num_rows",
                F.lit(len(df.columns)).alias("num_columns"),
                F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
                (size.scalar() / 1024**2).alias("size_mb"), "splits",
            )
        )
    if not parts:
        return spark.createDataFrame([], DESCRIPTION_SCHEMA)
    return reduce(DataFrame.unionByName, parts)
