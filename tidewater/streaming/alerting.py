"""Alerts from a stream of windowed metrics, written once per rule and window."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators.monitor import AlertRule, alerts
from tidewater.sources.catalog import path_exists

ALERT_KEY = ["rule", "key", "window_start", "channel"]


def write_alerts(path: str, rules: Sequence[AlertRule]) -> Callable[[DataFrame, int], None]:
    """A `foreachBatch` function that writes alerts below `window_day=…/batch_id=…`.

    The batch id names the folder, so a replay overwrites its own rows. A batch looks back only into the days its own
    windows lie in, with the schema of its rows, so earlier days are neither listed nor read.
    """

    def write(metrics: DataFrame, batch_id: int) -> None:
        spark = metrics.sparkSession
        found = alerts(metrics, rules).withColumn("window_day", F.to_date("window_start")).persist()
        days = [r["window_day"] for r in found.select("window_day").distinct().collect()]
        for day in days:
            folder = f"{path}/window_day={day}"
            new = found.where(F.col("window_day") == F.lit(day)).drop("window_day")
            if path_exists(spark, folder):
                written = spark.read.schema(f"{_ddl(new)}, batch_id long").option("basePath", folder).parquet(folder)
                earlier = written.where(F.col("batch_id") != batch_id).select(*ALERT_KEY)
                new = new.join(earlier, ALERT_KEY, "left_anti")
            new.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
        found.unpersist()

    return write


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def start_alerts(metrics: DataFrame, rules: Sequence[AlertRule], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing alerts for `metrics(key, metric, value, window_start, window_end)`."""
    return (
        metrics.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write_alerts(path, rules))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
