"""Envelope encryption: a data key for each group of rows, wrapped by a master key in a key table.

Rows are encrypted under their group's data key, which is stored only in wrapped form, bound to its group. A new master
key means that the key table is written anew; the data stays as it is. Without a group's row in the table nobody opens
the group's values any more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators.governance import secret_key
from tidewater.session import checkpointed, file_system

KEY_SCHEMA = "key_group string, wrapped binary, master_id string"


def _bound(group: Column) -> Column:
    """What ties a wrapped key to its group."""
    return F.coalesce(F.concat(F.lit("group "), group), F.lit("no group"))


def new_keys(groups: DataFrame, master: str | bytes, master_id: str) -> DataFrame:
    """A random data key of 32 bytes for each row of `groups(key_group)`, wrapped: key_group, wrapped, master_id.

    The keys are random, so the table is written once before it is used.
    """
    secret = secret_key(groups.sparkSession, master)
    drawn = F.unhex(F.sha2(F.concat(*(F.uuid() for _ in range(3))), 256))
    wrapped = F.aes_encrypt(drawn, secret, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), _bound(F.col("key_group")))
    return checkpointed(groups.select("key_group", wrapped.alias("wrapped"), F.lit(master_id).alias("master_id")))


def _generations(spark: SparkSession, path: str) -> list[int]:
    files, place = file_system(spark, path)
    if not files.exists(place):
        return []
    found = []
    for status in files.listStatus(place):
        name = status.getPath().getName()
        if name.startswith("generation=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found.append(int(name.split("=")[1]))
    return sorted(found)


def key_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation of the key table that was written to its end; empty if there is none."""
    known = _generations(spark, path)
    if not known:
        return spark.createDataFrame([], KEY_SCHEMA)
    return spark.read.schema(KEY_SCHEMA).parquet(f"{path}/generation={known[-1]}")


def add_groups(df: DataFrame, group: str, path: str, master: str | bytes, master_id: str) -> DataFrame:
    """The key table with a key for every group of `df`; groups that have one keep it. One writer at a time."""
    spark = df.sparkSession
    known = key_table(spark, path).select(F.col("key_group").alias("_known"))
    groups = df.select(F.col(group).cast("string").alias("key_group")).distinct()
    missing = groups.join(known, F.col("key_group").eqNullSafe(F.col("_known")), "left_anti")
    generation = max(_generations(spark, path), default=0)
    new_keys(missing, master, master_id).write.mode("append").parquet(f"{path}/generation={generation}")
    return key_table(spark, path)


def _with_key(df: DataFrame, group: str, keys: DataFrame, opened: Column) -> DataFrame:
    data = keys.select(F.col("key_group").alias("_group"), opened.alias("_data_key"))
    return df.join(data, F.col(group).cast("string").eqNullSafe(F.col("_group")), "left").drop("_group")


def encrypt_by_group(df: DataFrame, columns: Sequence[str], group: str, keys: DataFrame, master: str | bytes) -> DataFrame:
    """Replace columns by their AES-GCM form under their group's data key; null stays null, equal values differ.

    A row whose group has no key, or one that the master key does not open, fails the job: nothing is stored in plain.
    A null group has a key of its own.
    """
    secret = secret_key(df.sparkSession, master)
    opened = F.aes_decrypt(F.col("wrapped"), secret, F.lit("GCM"), F.lit("DEFAULT"), _bound(F.col("key_group")))
    keyed = _with_key(df, group, keys, opened)
    data_key = F.coalesce("_data_key", F.raise_error(F.lit("a group without a data key")).cast("binary"))
    return keyed.withColumns({c: F.aes_encrypt(F.col(c).cast("string"), data_key) for c in columns}).drop("_data_key")


def decrypt_by_group(df: DataFrame, columns: Sequence[str], group: str, keys: DataFrame, master: str | bytes) -> DataFrame:
    """Decrypt to text; what the master key and the key table do not open becomes null."""
    secret = secret_key(df.sparkSession, master)
    opened = F.try_aes_decrypt(F.col("wrapped"), secret, F.lit("GCM"), F.lit("DEFAULT"), _bound(F.col("key_group")))
    keyed = _with_key(df, group, keys, opened)
    return keyed.withColumns({c: F.try_aes_decrypt(F.col(c), F.col("_data_key")).cast("string") for c in columns}).drop("_data_key")


def rotate_master(spark: SparkSession, path: str, old: str | bytes, new: str | bytes, master_id: str) -> DataFrame:
    """Wrap all data keys under a new master key, as a new generation of the key table, and delete the older ones.

    The data is not touched. A key that the old master does not open fails the job, and the old generation stays.
    """
    known = _generations(spark, path)
    if not known:
        raise ValueError("there is no key table")
    before, after, tied = secret_key(spark, old), secret_key(spark, new), _bound(F.col("key_group"))
    opened = F.aes_decrypt(F.col("wrapped"), before, F.lit("GCM"), F.lit("DEFAULT"), tied)
    wrapped = F.aes_encrypt(opened, after, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), tied)
    turned = key_table(spark, path).select("key_group", wrapped.alias("wrapped"), F.lit(master_id).alias("master_id"))
    turned.write.mode("overwrite").parquet(f"{path}/generation={known[-1] + 1}")
    for generation in known:
        files, place = file_system(spark, f"{path}/generation={generation}")
        files.delete(place, True)
    return key_table(spark, path)
