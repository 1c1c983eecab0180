"""Windowed metrics, accuracy drift and cleaning on streams; each also runs on a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.ordering import top_per_group
from tidewater.operators import clean as C
from tidewater.sources.catalog import path_exists


def event_time(df: DataFrame, ts: str = "ts", delay: str | None = "10 minutes") -> DataFrame:
    """Event time with a watermark on a stream; a batch is left as it is.

    Watermarks reject zone-less timestamps, so a stream reads them in the session time zone: set it
    to UTC, or windows of a day start at another hour than those of a batch.
    """
    if not df.isStreaming:
        return df
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out if delay is None else out.withWatermark(ts, delay)


def windowed_metrics(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    size: str,
    slide: str | None = None,
    bounds: Sequence[float] = (),
    ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Count, mean, sum and cumulative buckets per window and key. Late rows beyond the watermark are dropped."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}") for b in bounds]
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return (
        event_time(df, ts, delay)
        .groupBy(window.alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"), *buckets)
        .select(
            F.col("window.start").cast("timestamp_ntz").alias("window_start"),
            F.col("window.end").cast("timestamp_ntz").alias("window_end"),
            *by, "n", "mean", "total", *[f"le_{b:g}" for b in bounds],
        )
    )


def windowed_accuracy(
    df: DataFrame, correct: Column, size: str, by: Sequence[str] = (), ts: str = "ts", delay: str = "10 minutes"
) -> DataFrame:
    """Accuracy per window: the part that runs on the stream."""
    return (
        event_time(df.withColumn("_hit", correct.cast("double")), ts, delay)
        .groupBy(F.window(ts, size).alias("window"), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_hit").alias("accuracy"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, "n", "accuracy")
    )


def accuracy_drift(windows: DataFrame, threshold: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """Drop in accuracy from the window before; the input has one row per window and key."""
    before = F.lag("accuracy").over(W.partitionBy(*by).orderBy("window_start"))
    drop = before - F.col("accuracy")
    return windows.withColumn("accuracy_drop", drop).withColumn(
        "drift_detected", F.coalesce(drop > threshold, F.lit(False))
    )


def write_accuracy_drift(path: str, threshold: float = 0.05, by: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function over `windowed_accuracy` in append mode: each finished window against the one before.

    Finished windows are written below `path/windows/batch_id=…`, so a replay overwrites its own. Like `accuracy_drift`,
    the window before is the last one that has rows, however long ago. `path/last/batch_id=…` holds the last finished
    window of every key after a batch, one row a key; a batch reads that of the batch before, and older ones are deleted.
    If it is missing, or a key's row is not older than the key's windows (a batch given again under another number),
    all finished windows are read.
    """
    key = W.partitionBy(*by)

    def write(windows: DataFrame, batch_id: int) -> None:
        spark = windows.sparkSession
        own = windows.persist()
        schema = ", ".join(f"`{name}` {kind}" for name, kind in own.dtypes)

        def after(earlier: DataFrame) -> DataFrame:
            """The batch's windows and earlier ones, with the start of the batch's first window of the key, if any."""
            rows = own.withColumn("_own", F.lit(True)).unionByName(earlier.withColumn("_own", F.lit(False)))
            return rows.withColumn("_first", F.min(F.when(F.col("_own"), F.col("window_start"))).over(key))

        older = F.col("_own") | F.col("_first").isNull() | (F.col("window_start") < F.col("_first"))
        latest = [F.desc("window_start")]
        states = sorted(k for k in batch_ids(spark, f"{path}/last") if k < batch_id)
        known = spark.read.schema(schema).parquet(f"{path}/last/batch_id={states[-1]}") if states else None
        if known is None or not after(known).where(~older).isEmpty():
            known = spark.createDataFrame([], own.schema)
            if path_exists(spark, f"{path}/windows"):
                found = spark.read.schema(f"{schema}, batch_id long").option("basePath", f"{path}/windows").parquet(f"{path}/windows")
                known = found.where(F.col("batch_id") != batch_id).drop("batch_id")
        before = top_per_group(after(known).where(older & ~F.col("_own")), by, latest, 1, "_n").select(*own.columns, "_own")
        compared = accuracy_drift(own.withColumn("_own", F.lit(True)).unionByName(before), threshold, by).where("_own").drop("_own")
        compared.write.mode("overwrite").parquet(f"{path}/drift/batch_id={batch_id}")
        last = top_per_group(own.unionByName(known), by, latest, 1, "_n").select(own.columns)
        last.write.mode("overwrite").parquet(f"{path}/last/batch_id={batch_id}")
        own.write.mode("overwrite").parquet(f"{path}/windows/batch_id={batch_id}")
        for k in states[:-1]:
            delete_folder(spark, f"{path}/last/batch_id={k}")
        own.unpersist()

    return write


def batch_ids(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the `batch_id=…` folders below a folder, which may be missing."""
    if not path_exists(spark, folder):
        return []
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(name)
    names = [f.getPath().getName() for f in found]
    return [int(n.removeprefix("batch_id=")) for n in names if n.startswith("batch_id=")]


def delete_folder(spark: SparkSession, folder: str) -> None:
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(name, True)


def clean_stream(
    df: DataFrame, config: C.CleanConfig, arrival: str = "arrived_at", delay: str = "1 hour"
) -> DataFrame:
    """Clean, label and deduplicate a stream of texts.

    Repeats are removed within the watermark delay of the arrival time; the batch rule at publishing
    time removes those further apart.
    """
    if config.output_text not in df.columns and config.text_column is None:
        raise ValueError("a stream needs an explicit text column")
    steps = C.clean(df, config.with_overrides(drop_duplicates=False), keep=(arrival,))
    if not config.drop_duplicates:
        return steps
    keys = [config.output_text, config.output_label]
    if not df.isStreaming:
        return steps.groupBy(*keys).agg(F.min(arrival).alias(arrival))
    return event_time(steps, arrival, delay).dropDuplicatesWithinWatermark(keys)
