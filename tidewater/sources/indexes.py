"""Search indexes and other derived tables that are kept: per state of the files they come from; listed and dropped."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.fulltext import TextIndex, text_index, write_text_index
from tidewater.session import ensure_checkpoint_dir, file_system


def exists(spark: SparkSession, path: str) -> bool:
    files, place = file_system(spark, path)
    return files.exists(place)


def state_of(df: DataFrame) -> str:
    """What the files of a table's scans are now: their paths, lengths and times of change, as one hash."""
    spark = df.sparkSession
    seen = []
    for name in df.inputFiles():
        files, place = file_system(spark, name)
        status = files.getFileStatus(place)
        seen.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return sha256("\n".join(sorted(seen)).encode()).hexdigest()[:32]


def index_root(spark: SparkSession) -> str:
    """Where indexes are kept: below the shared folder that the session names."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or ensure_checkpoint_dir(spark)).rstrip('/')}/indexes"


def kept_table(df: DataFrame, name: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`make(df)` as a table that is written once for each state of the files `df` reads. One writer at a time."""
    spark = df.sparkSession
    path = f"{index_root(spark)}/{name}-{state_of(df)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make(df).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def kept_text_index(df: DataFrame, name: str) -> TextIndex:
    """The text index of `df(id, text)`, built once for each state of the files `df` reads. One writer at a time."""
    spark = df.sparkSession
    path = f"{index_root(spark)}/{name}-{state_of(df)}"
    if not exists(spark, f"{path}/totals/segment=0/_SUCCESS"):
        return write_text_index(df.select("id", "text"), path)
    return text_index(spark, path)


def list_indexes(spark: SparkSession, root: str) -> DataFrame:
    """Name and time of change of every index below a folder; none if there is no such folder."""
    files, place = file_system(spark, root)
    found = files.listStatus(place) if files.exists(place) else []
    rows = [(s.getPath().getName(), s.getModificationTime() / 1000) for s in found if s.isDirectory()]
    return spark.createDataFrame(rows, "name string, seconds double").select("name", F.timestamp_seconds("seconds").alias("changed"))


def drop_index(spark: SparkSession, root: str, name: str) -> bool:
    """Delete an index with all its files; False if there is none of this name."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"not a name of an index: {name!r}")
    files, place = file_system(spark, f"{root.rstrip('/')}/{name}")
    return bool(files.exists(place) and files.delete(place, True))
