"""Batch forms of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import clean as C
from tidewater.operators import sessions as S
from tidewater.plans.base import query, table
from tidewater.streaming import sessions as SS
from tidewater.streaming import windows as SW


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


METRICS = """count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total,
  count(*) FILTER (WHERE value <= 5) AS le_5, count(*) FILTER (WHERE value <= 50) AS le_50"""


@query(
    "window_tumbling",
    f"""SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
      time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY AS window_end, event_type, {METRICS}
    FROM events GROUP BY ALL""",
)
def window_tumbling(spark: SparkSession, folder: str) -> DataFrame:
    out = SW.windowed_metrics(events(spark, folder), ["event_type"], "value", "1 day", bounds=(5.0, 50.0))
    return out.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query(
    "window_sliding",
    f"""WITH s AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - to_hours(6 * unnest([0, 1, 2, 3])) AS window_start, event_type, value FROM events)
    SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, event_type, {METRICS} FROM s GROUP BY window_start, event_type""",
)
def window_sliding(spark: SparkSession, folder: str) -> DataFrame:
    out = SW.windowed_metrics(events(spark, folder), ["event_type"], "value", "1 day", "6 hours", (5.0, 50.0))
    return out.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


SESSIONS_SQL = """marked AS (SELECT *, event_type = 'signup' AS out, lag(ts) OVER w AS pts, lag(event_type = 'signup') OVER w AS pout
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, sum((pts IS NULL OR ts >= pts + INTERVAL 1 HOUR {early})::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM marked),
found AS (SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events,
  CASE WHEN arg_max(out, (ts, event_id)) THEN 'logout' ELSE 'timeout' END AS closed_by FROM numbered GROUP BY user_id, s)"""


@query(
    "sessions_inactivity",
    f"WITH {SESSIONS_SQL.format(early='')} SELECT user_id, session_start, session_end, n_events FROM found",
)
def sessions_inactivity(spark: SparkSession, folder: str) -> DataFrame:
    return S.sessions(events(spark, folder)).drop("closed_by")


@query(
    "sessions_window",
    f"WITH {SESSIONS_SQL.format(early='')} SELECT user_id, session_start, session_end, n_events FROM found",
)
def sessions_window(spark: SparkSession, folder: str) -> DataFrame:
    return SS.inactivity_sessions(events(spark, folder))


@query("sessions_logout", f"WITH {SESSIONS_SQL.format(early='OR pout')} SELECT * FROM found")
def sessions_logout(spark: SparkSession, folder: str) -> DataFrame:
    return S.sessions(events(spark, folder), logout=F.col("event_type") == "signup")


@query(
    "open_sessions",
    f"""WITH {SESSIONS_SQL.format(early='OR pout')} SELECT * FROM found WHERE session_start <= TIMESTAMP '2024-01-15 12:00:00'
      AND session_end + INTERVAL 1 HOUR > TIMESTAMP '2024-01-15 12:00:00'
      AND (closed_by <> 'logout' OR session_end > TIMESTAMP '2024-01-15 12:00:00')""",
)
def open_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = S.sessions(events(spark, folder), logout=F.col("event_type") == "signup")
    return S.open_sessions(found, "2024-01-15 12:00:00")


@query(
    "accuracy_drift_windows",
    """WITH w AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, avg((value > 20)::INT) AS a FROM events GROUP BY ALL),
    d AS (SELECT *, lag(a) OVER (PARTITION BY event_type ORDER BY window_start) - a AS drop FROM w)
    SELECT window_start, event_type, n, round(a, 6) AS accuracy, round(drop, 6) AS accuracy_drop, coalesce(drop > 0.05, false) AS drift_detected FROM d""",
)
def accuracy_drift_windows(spark: SparkSession, folder: str) -> DataFrame:
    windows = SW.windowed_accuracy(events(spark, folder), F.col("value") > 20, "1 day", ["event_type"])
    out = SW.accuracy_drift(windows, 0.05, ["event_type"])
    return out.withColumns({c: F.round(c, 6) for c in ("accuracy", "accuracy_drop")})


@query(
    "clean_arrivals",
    """SELECT md5(text) AS digest, min(doc_id) AS first_id FROM documents GROUP BY text""",
)
def clean_arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Batch form of the cleaning stream, with the document number as arrival time."""
    rows = table(spark, folder, "documents").select("text", F.timestamp_seconds("doc_id").alias("arrived_at"))
    out = SW.clean_stream(rows, C.SENTIMENT)
    return out.select(F.md5("text").alias("digest"), F.unix_seconds("arrived_at").alias("first_id"))
