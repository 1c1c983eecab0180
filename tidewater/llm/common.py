"""What several operators share: sizes, sampling keys, packing of rows, components of a graph."""

from __future__ import annotations

import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewater.session import checkpointed, ensure_checkpoint_dir

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of an Arrow batch that goes to Python; a task holds a few times that in texts and results.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A table that the code broadcasts has at most so many rows of fixed width.
BROADCAST_ROWS = 100_000


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on Arrow batches to BATCH_BYTES, so that long texts do not pile up in a Python worker."""
    current = re.fullmatch(r"(\d+)b?", spark.conf.get(BATCH_SETTING))
    if not current or int(current[1]) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the session's shared checkpoint folder, for a table that a job writes."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid4().hex}"


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table of counted, narrow rows; a larger one is joined as Spark decides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remainder(identifier: Column, modulus: int) -> Column:
    """crc32 of the identifier as text, modulo `modulus`; null for a null identifier."""
    return F.crc32(identifier.cast("string").cast("binary")) % modulus


def numbered(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Add the place of each row, from 0, in the order of its key's rows.

    Ranges of (key, order) are numbered each on its own; one row a key and range carries what comes before.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), F.col(key), *order).withColumn("_part", F.spark_partition_id())
    placed = checkpointed(ranged.withColumn("_here", F.row_number().over(Window.partitionBy(key, "_part").orderBy(*order)) - 1))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(key, "_part").agg(F.count("*").alias("_count"))
    offsets = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_range"), F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_offset"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_part") == F.col("_range"))
    return placed.join(offsets, same).withColumn(name, F.col("_offset") + F.col("_here")).drop("_part", "_here", "_key", "_range", "_offset")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected `edges` (a long, b long) as (node, root), root the smallest node.

    Large-star and small-star steps: the first hangs the larger neighbours of a node on its smallest one, the second
    hangs a node and its smaller neighbours on the smallest. Each step is a grouped minimum, summed before the shuffle,
    and one join back whose other side has one row a node, so that adaptive execution can split a popular node. A step
    never makes more rows than it reads. Steps end when the edges stay as they are, after about log(n) rounds. Each
    round is written to the shared checkpoint folder, so that a lost executor costs a reread.
    """
    current = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = _state(current)
    while state[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpointed(large)
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(smallest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = checkpointed(below.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(current)
        if before == state:
            break
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.bit_xor(mixed), F.sum(F.shiftright(mixed, 20))).first()
    return tuple(row)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)
