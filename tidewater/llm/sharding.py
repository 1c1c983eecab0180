"""Sharding: contiguous shards of equal bytes, cut in the prefix sums of all sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tidewater.llm.common import partitions
from tidewater.session import checkpointed


def shard_by_bytes(df: DataFrame, shards: int = 16, text: str = "text", identifier: str = "doc_id") -> DataFrame:
    """One row per input row: (identifier, size, text_crc32, shard, slot); shards are contiguous in order of identifier.

    The size of a row is the UTF-8 bytes of its text plus 1, so empty and null texts count 1. Texts are read once, for
    size and checksum, and never move: narrow rows go to ranges of the identifier and are written to the shared folder.
    One row per range gives the bytes and rows before it, a running sum inside the range gives the position of a row,
    and the row goes to the shard in which its middle byte lies. So a shard misses its target by half a row at each end.
    `slot` numbers the rows of a shard from 0.

    Null identifiers come first; rows with equal identifiers are ordered by checksum, then size. Repeated rows take one
    position each. A text longer than a target fills its shard and may leave others empty. An empty table gives no rows.
    Other columns are not read.
    """
    narrow = df.select(
        F.col(identifier).alias("identifier"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    order = ("identifier", "text_crc32", "size")
    ranged = checkpointed(
        narrow.repartitionByRange(partitions(df.sparkSession), *order).withColumn("range", F.spark_partition_id())
    )
    sums = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sums.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("total"),
    )
    inside = Window.partitionBy("range").orderBy(*order)
    # As many rows as there are ranges: broadcast.
    placed = (
        ranged.withColumn("bytes_to", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("number", F.row_number().over(inside))
        .join(F.broadcast(offsets), "range")
        .withColumn("middle", 2 * (F.col("bytes_before") + F.col("bytes_to")) - F.col("size"))
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (middle * {shards}) div (2 * total)) as int)"))
        .select("identifier", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("number") - 1).alias("row"))
    )
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("identifier").alias(identifier), "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
