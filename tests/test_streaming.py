import datetime as dt
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import clean as C
from tidewater.operators import monitor as M
from tidewater.operators import sessions as S
from tidewater.streaming import alerting
from tidewater.streaming import sessions as SS
from tidewater.streaming import windows as SW

SCHEMA = "id long, user long, ts timestamp_ntz, value double, out boolean"
START = dt.datetime(2024, 1, 1)


def make_events(n=300, seed=4):
    rng = np.random.default_rng(seed)
    minutes = np.sort(rng.integers(0, 6 * 24 * 60, n))
    return [(int(i), int(rng.integers(0, 4)), START + timedelta(minutes=int(m)), float(rng.integers(0, 100)), bool(rng.random() < 0.15))
            for i, m in enumerate(minutes)]


def feed(spark, path, batches):
    """A stream that reads one file per micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / f"part={i:03d}"))
    return (spark.readStream.schema(SCHEMA + ", part int").option("maxFilesPerTrigger", 1).parquet(str(path)).drop("part"))


def run(stream, name, mode="append"):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def in_batches(rows, size, shuffled=False):
    parts = [rows[i : i + size] for i in range(0, len(rows), size)]
    if shuffled:
        rng = np.random.default_rng(0)
        parts = [[p[i] for i in rng.permutation(len(p))] for p in parts]
    return parts


def test_windows_equal_the_batch_on_closed_windows(spark, tmp_path):
    rows = make_events()
    stream = SW.windowed_metrics(feed(spark, tmp_path, in_batches(rows, 60)), ["user"], "value", "6 hours", bounds=(50.0,))
    got = run(stream, "windows")
    batch = SW.windowed_metrics(spark.createDataFrame(rows, SCHEMA), ["user"], "value", "6 hours", bounds=(50.0,))
    assert not got.isEmpty() and got.exceptAll(batch).isEmpty()
    last = got.agg(F.max("window_end")).first()[0]
    assert batch.where(F.col("window_end") <= last).exceptAll(got).isEmpty()


def one(i, hours):
    return [(i, 1, START + timedelta(hours=hours), 1.0, False)]


def test_late_event_is_dropped(spark, tmp_path):
    # A batch is filtered by the watermark of the batch before, so the late event comes two batches later.
    batches = [one(1, 0) + one(2, 30), one(3, 31), one(4, 1) + one(5, 60), one(6, 90)]
    got = run(SW.windowed_metrics(feed(spark, tmp_path, batches), ["user"], "value", "1 day"), "late")
    assert {r["window_start"]: r["n"] for r in got.collect()}[START] == 1


def test_late_event_changes_no_logout_session(spark, tmp_path):
    batches = [one(1, 0) + one(2, 30), one(4, 1) + one(5, 60), one(6, 90), one(7, 120)]
    got = run(SS.logout_sessions(feed(spark, tmp_path, batches), F.col("out"), "user"), "late_logout")
    found = sorted((r["session_start"] - START) // timedelta(hours=1) for r in got.collect())
    assert found[:2] == [0, 30] and 1 not in found


def test_inactivity_sessions(spark, tmp_path):
    rows = make_events()
    got = run(SS.inactivity_sessions(feed(spark, tmp_path, in_batches(rows, 60)), "user"), "inactive")
    batch = SS.inactivity_sessions(spark.createDataFrame(rows, SCHEMA), "user")
    plain = S.sessions(spark.createDataFrame(rows, SCHEMA), "user", ("ts", "id")).drop("closed_by")
    assert batch.exceptAll(plain).isEmpty() and plain.exceptAll(batch).isEmpty()
    assert not got.isEmpty() and got.exceptAll(batch).isEmpty()


@pytest.mark.parametrize("shuffled", [False, True])
def test_logout_sessions_equal_the_batch(spark, tmp_path, shuffled):
    rows = make_events()
    stream = feed(spark, tmp_path, in_batches(rows, 50, shuffled))
    got = run(SS.logout_sessions(stream, F.col("out"), "user"), f"logouts_{shuffled}")
    batch = S.sessions(spark.createDataFrame(rows, SCHEMA), "user", ("ts", "id"), logout=F.col("out"))
    closed = {tuple(r) for r in got.select("user", "session_start", "session_end", "n_events", "closed_by").collect()}
    every = {tuple(r) for r in batch.select("user", "session_start", "session_end", "n_events", "closed_by").collect()}
    assert closed <= every
    # Only sessions near the end of the stream may still be open.
    assert all(s[2] > START + timedelta(days=4) for s in every - closed)
    assert len(closed) > 0.8 * len(every)


def test_logout_sessions_of_named_users(spark, tmp_path):
    rows = make_events(120)
    stream = feed(spark, tmp_path, in_batches(rows, 40)).withColumn("who", F.concat(F.lit("user "), F.col("user").cast("string")))
    got = run(SS.logout_sessions(stream, F.col("out"), "who"), "named_logouts")
    assert got.columns[0] == "who" and {r["who"] for r in got.collect()} <= {f"user {k}" for k in range(4)} and not got.isEmpty()


def test_logout_arriving_out_of_order():
    minute = 60_000_000
    events = [(1 * minute, False), (3 * minute, True), (5 * minute, False)]
    closed, session = SS.fold(None, events, 60 * minute, 10 * minute)
    assert closed == [(1 * minute, 3 * minute, 2, "logout")] and session == (5 * minute, 5 * minute, 1)
    closed, session = SS.fold(session, [(70 * minute, False)], 60 * minute, 200 * minute)
    assert closed == [(5 * minute, 5 * minute, 1, "timeout"), (70 * minute, 70 * minute, 1, "timeout")] and session is None


def test_alerts_are_written_once(spark, tmp_path):
    rows = make_events()
    windows = SW.windowed_metrics(feed(spark, tmp_path / "in", in_batches(rows, 60)), ["user"], "value", "6 hours")
    metrics = windows.select(F.col("user").cast("string").alias("key"), F.lit("mean").alias("metric"), F.col("mean").alias("value"),
                             "window_start", "window_end")
    rules = [M.AlertRule("high", "mean", 60.0, channels=("email", "slack"))]
    out = str(tmp_path / "alerts")
    query = alerting.start_alerts(metrics, rules, out, str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert query.exception() is None
    written = spark.read.parquet(out)
    n = written.count()
    assert n > 0 and written.select(*alerting.ALERT_KEY).distinct().count() == n

    # The same rows under the same batch id replace themselves; under a new id nothing is new.
    batch = SW.windowed_metrics(spark.createDataFrame(rows, SCHEMA), ["user"], "value", "6 hours")
    batch = batch.select(F.col("user").cast("string").alias("key"), F.lit("mean").alias("metric"), F.col("mean").alias("value"),
                         "window_start", "window_end")
    write = alerting.write_alerts(str(tmp_path / "again"), rules)
    write(batch, 0)
    first = spark.read.parquet(str(tmp_path / "again")).count()
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "again")).count() == first > 0


def test_clean_stream(spark, tmp_path):
    texts = ["good day", "good day ", "bad day", "good day", ""]
    schema = "text string, arrived_at timestamp_ntz"
    for i, at in enumerate([0, 20]):
        rows = [(t, START + timedelta(minutes=at + j)) for j, t in enumerate(texts)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part={i}"))
    stream = spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path)).drop("part")
    got = run(SW.clean_stream(stream, C.SENTIMENT), "cleaned")
    assert sorted((r["text"], r["label"]) for r in got.collect()) == [("bad day", "negative"), ("good day", "positive")]
    batch = SW.clean_stream(spark.read.schema(schema + ", part int").parquet(str(tmp_path)), C.SENTIMENT)
    assert batch.count() == 2


def test_accuracy_drift(spark, tmp_path):
    rows = [(i, 0, START + timedelta(hours=i), 1.0 if i < 24 else 0.0, False) for i in range(72)]
    stream = SW.windowed_accuracy(feed(spark, tmp_path, in_batches(rows, 24)), F.col("value") == 1, "1 day")
    out = SW.accuracy_drift(run(stream, "accuracy"), 0.05).orderBy("window_start").collect()
    assert [(r["accuracy"], r["drift_detected"]) for r in out] == [(1.0, False), (0.0, True)]


def test_accuracy_drift_of_a_stream(spark, tmp_path):
    """Windows that finish in different micro-batches are compared as in a batch, and a replay changes nothing."""
    rows = [(i, i % 2, START + timedelta(hours=i), 1.0 if i < 24 or i % 3 else 0.0, False) for i in range(120)]
    stream = SW.windowed_accuracy(feed(spark, tmp_path / "in", in_batches(rows, 24)), F.col("value") == 1, "1 day", ["user"])
    out = str(tmp_path / "out")
    write = SW.write_accuracy_drift(out, 0.05, ["user"])
    query = stream.writeStream.outputMode("append").foreachBatch(write).trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "checkpoint")).start()
    query.awaitTermination(120)
    assert query.exception() is None
    columns = ["user", "window_start", "n", "accuracy", "accuracy_drop", "drift_detected"]
    got = {tuple(r) for r in spark.read.parquet(f"{out}/drift").select(*columns).collect()}
    windows = SW.windowed_accuracy(spark.createDataFrame(rows, SCHEMA), F.col("value") == 1, "1 day", ["user"])
    batch = {tuple(r) for r in SW.accuracy_drift(windows, 0.05, ["user"]).select(*columns).collect()}
    last = max(r[1] for r in got)
    assert got == {r for r in batch if r[1] <= last} and any(r[5] for r in got) and len(got) >= 6
    write(spark.read.parquet(f"{out}/windows").drop("batch_id").where(F.col("window_start") == last), 99)
    again = {tuple(r) for r in spark.read.parquet(f"{out}/drift/batch_id=99").select(*columns).collect()}
    assert again == {r for r in batch if r[1] == last}


def test_accuracy_drift_after_a_long_gap(spark, tmp_path):
    """Keys without rows for 40 windows, also a null key, are compared with their last window, whatever else a batch holds."""
    days = [(1, 0, 1.0), (1, 41, 0.0), (1, 42, 1.0), (2, 0, 1.0), (2, 1, 0.5), (2, 42, 0.25), (None, 0, 1.0), (None, 41, 0.5), (3, 42, 1.0)]
    windows = spark.createDataFrame(
        [(START + timedelta(days=d), u, 4, a) for u, d, a in days], "window_start timestamp_ntz, user long, n long, accuracy double"
    )
    expected = {tuple(r) for r in SW.accuracy_drift(windows, 0.05, ["user"]).collect()}
    assert sum(r[5] for r in expected) == 4
    write = SW.write_accuracy_drift(str(tmp_path), 0.05, ["user"])
    batches = [(0, 0), (1, 1), (2, 20), (21, 41), (0, 0), (42, 42)]  # one is given again under another number
    for batch_id, (low, high) in enumerate(batches):
        day = F.datediff("window_start", F.lit(START))
        for _ in range(2):  # a replay changes nothing
            write(windows.where(day.between(low, high)), batch_id)
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/drift").drop("batch_id").collect()]
    assert set(got) == expected
    assert sorted(SW.batch_ids(spark, f"{tmp_path}/last")) == [4, 5]
    assert spark.read.parquet(f"{tmp_path}/last/batch_id=5").count() == 4
