"""Queries over the monitoring operators, on the event stream as the metric log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import monitor as M
from tidewater.plans.base import query, table

HALF = "2024-01-16"


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def before(day: str):
    return F.col("ts") < F.lit(day).cast("timestamp_ntz")


KS_SQL = """
s AS (SELECT {value} AS v, ({base})::INT AS b FROM {relation}),
c AS (SELECT v, sum(b) AS nb, sum(1 - b) AS nc FROM s GROUP BY v),
t AS (SELECT sum(nb) AS n, sum(nc) AS m FROM c),
d AS (SELECT max(abs(cb / n - cc / m)) AS d, any_value(n) AS n, any_value(m) AS m FROM (
  SELECT sum(nb) OVER (ORDER BY v)::DOUBLE AS cb, sum(nc) OVER (ORDER BY v)::DOUBLE AS cc FROM c), t),
p AS (SELECT d, n, m, least(1, greatest(0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0::DOUBLE END
  * exp(-2.0::DOUBLE * k * k * d * d * (n * m / (n + m))::DOUBLE)) FROM range(1, 101) r(k)))) AS p FROM d)
SELECT '{feature}' AS feature, n::BIGINT AS n_base, m::BIGINT AS n_cur, round(d, 9) AS statistic, round(p, 6) AS p_value,
       p < 0.05 AS drift_detected FROM p"""


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query("data_drift_time", "WITH " + KS_SQL.format(value="value", base=f"ts < TIMESTAMP '{HALF}'", relation="events", feature="value"))
def data_drift_time(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).select("ts", "value")
    return rounded(M.data_drift(rows.where(before(HALF)), rows.where(~before(HALF))), statistic=9, p_value=6)


@query("data_drift_ties", "WITH " + KS_SQL.format(
    value="l_quantity + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END", base="l_returnflag <> 'R'", relation="lineitem", feature="quantity"))
def data_drift_ties(spark: SparkSession, folder: str) -> DataFrame:
    """Few distinct values with many rows each; one side is shifted."""
    rows = table(spark, folder, "lineitem").select("l_quantity", "l_returnflag")
    base = rows.where("l_returnflag <> 'R'").select(F.col("l_quantity").alias("quantity"))
    moved = rows.where("l_returnflag = 'R'").select((F.col("l_quantity") + 3).alias("quantity"))
    return rounded(M.data_drift(base, moved, "quantity"), statistic=9, p_value=6)


@query(
    "concept_drift",
    f"""WITH a AS (SELECT event_type, avg(CASE WHEN ts < TIMESTAMP '{HALF}' THEN (value > 20)::INT END) AS b,
                 avg(CASE WHEN ts >= TIMESTAMP '{HALF}' THEN (value > 20)::INT END) AS c FROM events GROUP BY event_type)
    SELECT event_type, round(b, 6) AS baseline_accuracy, round(c, 6) AS current_accuracy, round(b - c, 6) AS accuracy_drop,
           b - c > 0.01 AS drift_detected FROM a""",
)
def concept_drift(spark: SparkSession, folder: str) -> DataFrame:
    out = M.concept_drift(events(spark, folder), F.col("value") > 20, before(HALF), 0.01, ["event_type"])
    return rounded(out, baseline_accuracy=6, current_accuracy=6, accuracy_drop=6)


@query("counters", "SELECT event_type, count(*) AS total FROM events GROUP BY event_type")
def counters(spark: SparkSession, folder: str) -> DataFrame:
    return M.counters(events(spark, folder), ["event_type"])


@query(
    "latency_histogram",
    """WITH b AS (SELECT * FROM (VALUES ('1.0', 1.0), ('5.0', 5.0), ('25.0', 25.0), ('100.0', 100.0), ('250.0', 250.0), ('+Inf', 1e18)) t(le, bound)),
    g AS (SELECT event_type, count(*) AS n, sum(value) AS s FROM events GROUP BY event_type)
    SELECT e.event_type, g.n AS "count", round(g.s, 4) AS "sum", b.le, count(*) FILTER (WHERE e.value <= b.bound) AS cumulative
    FROM events e JOIN g ON g.event_type = e.event_type, b GROUP BY e.event_type, g.n, g.s, b.le""",
)
def latency_histogram(spark: SparkSession, folder: str) -> DataFrame:
    out = M.histogram(events(spark, folder), ["event_type"], "value", (1.0, 5.0, 25.0, 100.0, 250.0))
    return rounded(out, sum=4)


@query(
    "last_value_gauge",
    "SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
)
def last_value_gauge(spark: SparkSession, folder: str) -> DataFrame:
    return M.last_value(events(spark, folder), ["user_id"], "value", ["ts", "event_id"])


@query(
    "average_per_version",
    """SELECT c_custkey, round(coalesce(avg(o_totalprice), 0), 8) AS average
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def average_per_version(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "customer").select("c_custkey")
    log = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return rounded(M.average_per_key(keys, log, "c_custkey", "o_totalprice"), average=8)


RULES = (
    M.AlertRule("slow", "avg_value", 31.0, True, "high", "Slow responses", ("email", "slack")),
    M.AlertRule("busy", "n", 60.0, True, "low", "Busy day", ()),
    M.AlertRule("quiet", "n", 50.0, False, "medium", "Quiet day", ("webhook",)),
)


def daily_metrics(df: DataFrame) -> DataFrame:
    """Long metric rows per event type and day."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    wide = df.groupBy(F.col("event_type").alias("key"), day.alias("window_start")).agg(
        F.avg("value").alias("avg_value"), F.count("*").cast("double").alias("n")
    )
    return wide.withColumn("window_end", F.col("window_start") + F.expr("INTERVAL 1 DAY")).unpivot(
        ["key", "window_start", "window_end"], ["avg_value", "n"], "metric", "value"
    )


ALERTS_SQL = """
m AS (SELECT event_type AS key, date_trunc('day', ts)::TIMESTAMP AS window_start, avg(value) AS a, count(*) AS n FROM events GROUP BY ALL),
fired AS (
  SELECT 'slow' AS rule, key, window_start, 'high' AS severity, 'Slow responses' AS title,
         'avg_value of ' || key || ' is above 31.0' AS message, unnest(['email', 'slack']) AS channel FROM m WHERE a > 31
  UNION ALL SELECT 'busy', key, window_start, 'low', 'Busy day', 'n of ' || key || ' is above 60.0', 'email' FROM m WHERE n > 60
  UNION ALL SELECT 'quiet', key, window_start, 'medium', 'Quiet day', 'n of ' || key || ' is below 50.0', 'webhook' FROM m WHERE n < 50)"""


@query(
    "alerts",
    f"WITH {ALERTS_SQL} SELECT *, window_start + INTERVAL 1 DAY AS window_end, 'open' AS status FROM fired",
)
def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return M.alerts(daily_metrics(events(spark, folder)), RULES)


@query(
    "alerts_by_table",
    """WITH rules AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'avg_value' ELSE 'n' END AS metric,
      CASE WHEN p_partkey % 2 = 0 THEN p_retailprice / 30 ELSE p_retailprice / 10 END AS lim, p_size > 25 AS above FROM part),
    m AS (SELECT event_type AS key, date_trunc('day', ts)::TIMESTAMP AS window_start, avg(value) AS a, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
    l AS (SELECT key, window_start, 'avg_value' AS metric, a AS v FROM m UNION ALL SELECT key, window_start, 'n', n FROM m)
    SELECT key, window_start, metric, count(*) AS n_alerts, min(p_partkey) AS first_rule, max(p_partkey) AS last_rule
    FROM l JOIN rules USING (metric) WHERE CASE WHEN above THEN v > lim ELSE v < lim END GROUP BY ALL""",
)
def alerts_by_table(spark: SparkSession, folder: str) -> DataFrame:
    """A rule for every part, above or below a limit made of its price; the alerts of each metric row, counted."""
    even = F.col("p_partkey") % 2 == 0
    rules = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("rule"),
        F.when(even, "avg_value").otherwise("n").alias("metric"),
        F.when(even, F.col("p_retailprice") / 30).otherwise(F.col("p_retailprice") / 10).alias("limit"),
        (F.col("p_size") > 25).alias("above"),
        F.lit("low").alias("severity"),
        F.lit("").alias("title"),
        F.array(F.lit("email")).alias("channels"),
    )
    fired = M.alerts_by_table(daily_metrics(events(spark, folder)), rules)
    rule = F.col("rule").cast("long")
    return fired.withColumn("metric", F.substring_index("message", " of ", 1)).groupBy("key", "window_start", "metric").agg(
        F.count("*").alias("n_alerts"), F.min(rule).alias("first_rule"), F.max(rule).alias("last_rule")
    )


def alert_log(spark: SparkSession, folder: str) -> DataFrame:
    """All events as alert rows, those other than errors and views acknowledged."""
    return events(spark, folder).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), "user_id",
        F.when(F.col("event_type").isin("error", "view"), "open").otherwise("acknowledged").alias("status"),
    )


@query(
    "open_alerts",
    """SELECT event_id AS id, ts AS "timestamp", user_id, 'open' AS status FROM events WHERE event_type IN ('error', 'view')
    ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20""",
)
def open_alerts(spark: SparkSession, folder: str) -> DataFrame:
    return M.open_alerts(alert_log(spark, folder), 20, 50)


@query(
    "resolve_alerts",
    """WITH r AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id)
    SELECT e.event_id AS id, e.ts AS "timestamp", e.user_id,
      CASE WHEN r.seen IS NOT NULL THEN 'resolved' WHEN e.event_type IN ('error', 'view') THEN 'open' ELSE 'acknowledged' END AS status,
      CASE WHEN r.seen IS NOT NULL THEN 'user' || e.user_id END AS resolved_by, r.seen AS resolved_at
    FROM events e LEFT JOIN r ON r.user_id = e.user_id AND r.seen > e.ts""",
)
def resolve_alerts(spark: SparkSession, folder: str) -> DataFrame:
    """An alert is resolved by its user's last event, if that comes after it."""
    log = alert_log(spark, folder)
    seen = events(spark, folder).groupBy("user_id").agg(F.max("ts").alias("resolved_at"))
    done = log.join(seen, "user_id").where("resolved_at > timestamp").select(
        "id", F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("resolved_by"), "resolved_at"
    )
    return M.resolve_alerts(log, done)


@query(
    "metric_series",
    """SELECT event_id AS id, ts AS "timestamp", event_type AS metric_name, value AS metric_value FROM events
    WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 100 OFFSET 100""",
)
def metric_series(spark: SparkSession, folder: str) -> DataFrame:
    log = events(spark, folder).select(
        F.col("event_id").alias("id"), F.col("ts").alias("timestamp"),
        F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"),
    )
    return M.metric_series(log, "purchase", 100, 100)


PREDICTED_SQL = """predicted AS (
  SELECT d.lang, l.toxic, (contains(lower(d.text), 'hate') OR d.n_chars > 3000)::INT AS prediction
  FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def predicted(spark: SparkSession, folder: str) -> DataFrame:
    """A rule's prediction of the toxic label."""
    rule = F.lower("text").contains("hate") | (F.col("n_chars") > 3000)
    documents = table(spark, folder, "documents").select("doc_id", "lang", rule.cast("int").alias("prediction"))
    return table(spark, folder, "labels").select("doc_id", "toxic").join(documents, "doc_id")


@query(
    "classification_metrics",
    f"""WITH {PREDICTED_SQL}, c AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE toxic = 1 AND prediction = 1) AS tp,
      count(*) FILTER (WHERE toxic <> 1 AND prediction = 1) AS fp, count(*) FILTER (WHERE toxic = 1 AND prediction <> 1) AS fn
      FROM predicted GROUP BY lang)
    SELECT lang, n, round((n - fp - fn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision,
      round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1_score FROM c""",
)
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = M.classification_metrics(predicted(spark, folder), "toxic", "prediction", ["lang"])
    return rounded(out, accuracy=6, precision=6, recall=6, f1_score=6)


@query(
    "confusion_matrix",
    f"""WITH {PREDICTED_SQL} SELECT toxic, count(*) FILTER (WHERE prediction = 0) AS predicted_0,
      count(*) FILTER (WHERE prediction = 1) AS predicted_1, count(*) FILTER (WHERE prediction NOT IN (0, 1) OR prediction IS NULL) AS other
    FROM predicted GROUP BY toxic""",
)
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    out = M.confusion_matrix(predicted(spark, folder), "toxic", "prediction", [0, 1])
    return out.withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})


@query(
    "training_curve",
    """SELECT event_type, event_id, round(value / 100, 6) AS loss,
      round((value - lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 100, 6) AS delta,
      round(exp(value / 100), 5) AS perplexity FROM events""",
)
def training_curve(spark: SparkSession, folder: str) -> DataFrame:
    steps = events(spark, folder).select("event_type", "event_id", "ts", (F.col("value") / 100).alias("loss"))
    out = M.training_curve(steps, "event_type", ["ts", "event_id"], "loss", F.date_trunc("day", "ts"))
    return rounded(out.drop("ts"), loss=6, delta=6, perplexity=5)


@query(
    "final_metrics",
    """SELECT event_type, round(arg_max(value / 100, (ts, event_id)), 6) AS loss,
      round(exp(arg_max(value / 100, (ts, event_id))), 5) AS perplexity FROM events GROUP BY event_type""",
)
def final_metrics(spark: SparkSession, folder: str) -> DataFrame:
    steps = events(spark, folder).withColumn("loss", F.col("value") / 100)
    return rounded(M.final_metrics(steps, "event_type", ["ts", "event_id"], "loss"), loss=6, perplexity=5)


@query(
    "dashboard_status_counts",
    """SELECT 'all' AS scope, count(*) FILTER (WHERE o_orderstatus = 'O') AS "O", count(*) FILTER (WHERE o_orderstatus = 'F') AS "F",
       count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders
    UNION ALL SELECT 'latest', count(*) FILTER (WHERE s = 'O'), count(*) FILTER (WHERE s = 'F'), count(*) FILTER (WHERE s = 'P')
    FROM (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, -o_orderkey)) AS s FROM orders GROUP BY o_custkey)""",
)
def dashboard_status_counts(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    values = ["O", "F", "P"]
    every = M.status_counts(orders, "o_orderstatus", values).select(F.lit("all").alias("scope"), *values)
    newest = [F.desc("o_orderdate"), F.col("o_orderkey")]
    latest = M.latest_status_counts(orders, "o_custkey", newest, "o_orderstatus", values)
    return every.unionByName(latest.select(F.lit("latest").alias("scope"), *values))


@query(
    "weekly_trend",
    """WITH w AS (SELECT event_type, date_trunc('week', ts)::TIMESTAMP AS week, count(*) AS n FROM events GROUP BY ALL)
    SELECT *, CASE WHEN lag(week) OVER p = week - INTERVAL 7 DAY THEN round((n - lag(n) OVER p) / lag(n) OVER p * 100, 6) END AS change_pct
    FROM w WINDOW p AS (PARTITION BY event_type ORDER BY week)""",
)
def weekly_trend(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(M.weekly_trend(events(spark, folder), "ts", "event_type"), change_pct=6)


@query(
    "compare_runs",
    f"""WITH m AS (SELECT event_type AS metric, avg(value) FILTER (WHERE ts < TIMESTAMP '{HALF}') AS b,
                 avg(value) FILTER (WHERE ts >= TIMESTAMP '{HALF}') AS p FROM events GROUP BY event_type)
    SELECT metric, round(b, 6) AS baseline, round(p, 6) AS projected, round(p - b, 6) AS delta, round((p - b) / b * 100, 6) AS delta_pct FROM m""",
)
def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))

    rows = events(spark, folder)
    out = M.compare_runs(run(rows.where(before(HALF))), run(rows.where(~before(HALF))))
    return rounded(out, baseline=6, projected=6, delta=6, delta_pct=6)
