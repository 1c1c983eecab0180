"""Drift tests, counters, histograms, alerts, model metrics and dashboards."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.functions.numeric import kolmogorov_tail
from tidewater.functions.ordering import previous_row, running_sum_by_range, top_per_group
from tidewater.session import checkpointed

# Latency bucket bounds used when none are given, in seconds.
DEFAULT_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)
# Alert channels and the one used when a rule names none.
CHANNELS = ("email", "slack", "sms", "webhook")
DEFAULT_CHANNELS = ("email",)
# Buckets of the drift test: enough that one task orders a few million distinct values.
MIN_BUCKETS, MAX_BUCKETS, VALUES_PER_BUCKET = 200, 20_000, 2_000_000


def data_drift(
    baseline: DataFrame,
    current: DataFrame,
    value: str = "value",
    feature: str | None = None,
    threshold: float = 0.05,
    buckets: int | None = None,
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov test: the largest gap between the two empirical distributions.

    Equal values are collapsed first. Values then fall into buckets cut at approximate quantiles;
    each bucket is ordered on its own, starting from the totals of the buckets below. Without a given
    number there are 200 buckets, and more, up to 20,000, for samples above 400 million values. The
    p-value is the asymptotic one. With an empty sample the statistic is null and no drift is reported.
    """
    from pyspark.ml.feature import Bucketizer

    sides = baseline.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("b")).unionByName(
        current.select(F.col(value).cast("double").alias("v"), F.lit(0).alias("b"))
    )
    sides = sides.where(F.col("v").isNotNull() & ~F.isnan("v"))
    cuts, n = _cut_points(sides, buckets or MIN_BUCKETS)
    if buckets is None and n > MIN_BUCKETS * VALUES_PER_BUCKET:
        cuts, _ = _cut_points(sides, min(MAX_BUCKETS, n // VALUES_PER_BUCKET))
    finite = sorted({c for c in cuts if abs(c) != float("inf")}) or [0.0]
    collapsed = sides.groupBy("v").agg(F.sum("b").alias("nb"), F.sum(1 - F.col("b")).alias("nc"))
    splits = [-float("inf"), *finite, float("inf")]
    bucketed = Bucketizer(splits=splits, inputCol="v", outputCol="bucket").transform(collapsed)

    # One row per bucket: the only place where rows are ordered without a partition.
    below = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    totals = (
        bucketed.groupBy("bucket")
        .agg(F.sum("nb").alias("tb"), F.sum("nc").alias("tc"))
        .select(
            "bucket",
            F.coalesce(F.sum("tb").over(below), F.lit(0)).alias("ob"),
            F.coalesce(F.sum("tc").over(below), F.lit(0)).alias("oc"),
            F.sum("tb").over(every).alias("n_base"),
            F.sum("tc").over(every).alias("n_cur"),
        )
    )
    upto = W.partitionBy("bucket").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    share_base = F.try_divide(F.col("ob") + F.sum("nb").over(upto), F.col("n_base"))
    share_cur = F.try_divide(F.col("oc") + F.sum("nc").over(upto), F.col("n_cur"))
    gaps = bucketed.join(F.broadcast(totals), "bucket").select(
        F.abs(share_base - share_cur).alias("gap"), "n_base", "n_cur"
    )
    p_value = kolmogorov_tail(F.col("statistic"), F.col("n_base"), F.col("n_cur"))
    return (
        gaps.agg(
            F.coalesce(F.max("n_base"), F.lit(0)).alias("n_base"),
            F.coalesce(F.max("n_cur"), F.lit(0)).alias("n_cur"),
            F.max("gap").alias("statistic"),
        )
        .withColumn("p_value", F.when(F.col("statistic").isNotNull(), p_value))
        .select(
            F.lit(feature or value).alias("feature"), "n_base", "n_cur", "statistic", "p_value",
            F.coalesce(F.col("p_value") < threshold, F.lit(False)).alias("drift_detected"),
        )
    )


def _cut_points(sides: DataFrame, buckets: int) -> tuple[list[float], int]:
    share = [i / buckets for i in range(1, buckets)]
    row = sides.agg(F.percentile_approx("v", share, 10 * buckets).alias("cuts"), F.count("v").alias("n")).first()
    return row["cuts"] or [0.0], row["n"]


def concept_drift(
    df: DataFrame, correct: Column, is_baseline: Column, threshold: float = 0.05, by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy of the baseline rows minus accuracy of the others; drift when the drop exceeds the threshold."""
    hit = correct.cast("double")
    out = df.groupBy(*by).agg(
        F.avg(F.when(is_baseline, hit)).alias("baseline_accuracy"),
        F.avg(F.when(~is_baseline, hit)).alias("current_accuracy"),
    )
    drop = F.col("baseline_accuracy") - F.col("current_accuracy")
    return out.withColumn("accuracy_drop", drop).withColumn(
        "drift_detected", F.coalesce(drop > threshold, F.lit(False))
    )


def counters(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))


def histogram(
    df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float] = DEFAULT_BUCKETS
) -> DataFrame:
    """Cumulative buckets (`le`), with the sum and count of each group; the last bucket is infinite."""
    counted = [F.count(F.when(F.col(value) <= b, 1)).alias(f"_{i}") for i, b in enumerate(bounds)]
    grouped = df.groupBy(*by).agg(*counted, F.count(value).alias("count"), F.sum(value).alias("sum"))
    cells = [
        F.struct(F.lit(str(float(b))).alias("le"), F.col(f"_{i}").alias("cumulative")) for i, b in enumerate(bounds)
    ]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("count").alias("cumulative")))
    return grouped.select(*by, "count", "sum", F.inline(F.array(*cells)))


def last_value(df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """Gauge: the most recent value per key."""
    return df.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(value))


def average_per_key(keys: DataFrame, df: DataFrame, by: str, value: str) -> DataFrame:
    """Mean of `value` for every key, 0 for a key without rows."""
    means = df.groupBy(by).agg(F.avg(value).alias("average"))
    return keys.join(means, by, "left").select(by, F.coalesce("average", F.lit(0.0)).alias("average"))


@dataclass(frozen=True)
class AlertRule:
    """Fires for every metric row of `metric` above (or below) the limit."""

    rule: str
    metric: str
    limit: float
    above: bool = True
    severity: str = "medium"
    title: str = ""
    channels: tuple[str, ...] = DEFAULT_CHANNELS


def alerts(metrics: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """Alert rows, one per fired rule and channel, from `metrics(key, metric, value, window_start, window_end)`.

    Rules are configuration, so they travel inside the expression and no join is needed.
    """
    unknown = {c for r in rules for c in r.channels} - set(CHANNELS)
    if unknown:
        raise ValueError(f"unknown alert channels: {sorted(unknown)}")
    fired = []
    for r in rules:
        value, limit = F.col("value"), F.lit(float(r.limit))
        hit = (F.col("metric") == r.metric) & ((value > limit) if r.above else (value < limit))
        word = "above" if r.above else "below"
        row = F.struct(
            F.lit(r.rule).alias("rule"),
            F.lit(r.severity).alias("severity"),
            F.lit(r.title or r.rule).alias("title"),
            F.concat(F.lit(f"{r.metric} of "), F.col("key"), F.lit(f" is {word} {r.limit}")).alias("message"),
            F.array(*[F.lit(c) for c in (r.channels or DEFAULT_CHANNELS)]).alias("channels"),
        )
        fired.append(F.when(hit, row))
    return (
        metrics.withColumn("_alert", F.explode(F.array(*fired)))
        .where("_alert is not null")
        .withColumn("channel", F.explode("_alert.channels"))
        .select(
            "_alert.rule", "key", "window_start", "window_end",
            "_alert.severity", "_alert.title", "_alert.message", "channel", F.lit("open").alias("status"),
        )
    )


RULE_COLUMNS = "rule string, metric string, limit double, above boolean, severity string, title string, channels array<string>"


def alerts_by_table(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """What `alerts` gives, for rules in a table of RULE_COLUMNS; missing values stand for an AlertRule's defaults.

    The rules of a metric are numbered by their limit. For a metric row the rules below its value are counted in one
    sort of values and limits together, so those that fire are the first so many, and a join on the number brings them:
    work is that of the sort and of the alerts that come out, however many rules there are. For rules that fire below a
    limit both signs turn. Rows and rules without a metric, value or limit give nothing, a limit that is no number included.
    """
    unknown = rules.select(F.explode("channels").alias("c")).where(~F.col("c").isin(*CHANNELS)).distinct().limit(5).collect()
    if unknown:
        raise ValueError(f"unknown alert channels: {sorted(r['c'] for r in unknown)}")
    sign = F.when(F.coalesce("above", F.lit(True)), 1).otherwise(-1)
    given = rules.select(
        "rule",
        "metric",
        F.col("limit").alias("_limit"),
        sign.alias("_sign"),
        (F.col("limit") * sign).alias("_at"),
        F.coalesce("severity", F.lit("medium")).alias("severity"),
        F.when(F.length("title") > 0, F.col("title")).otherwise(F.col("rule")).alias("title"),
        F.when(F.size("channels") > 0, F.col("channels")).otherwise(F.array(*(F.lit(c) for c in DEFAULT_CHANNELS))).alias("channels"),
    ).dropna(subset=["metric", "_limit"])
    own = W.partitionBy("metric", "_sign").orderBy("_at", "rule")
    numbered = checkpointed(given.withColumn("_number", F.row_number().over(own).cast("long")))
    both = metrics.select(
        "metric",
        F.explode(F.array(F.lit(1), F.lit(-1))).alias("_sign"),
        F.col("value").cast("double").alias("_value_of"),
        F.struct("key", "window_start", "window_end").alias("_row"),
    ).where("metric IS NOT NULL AND _value_of IS NOT NULL")
    # What is not a number sorts above all limits, and is below none.
    valued = both.where("_sign = 1 OR NOT isnan(_value_of)").select("metric", "_sign", (F.col("_value_of") * F.col("_sign")).alias("_at"), F.lit(0).alias("_kind"), "_row")
    limits = numbered.select("metric", "_sign", "_at", F.lit(1).alias("_kind"))
    items = valued.unionByName(limits, allowMissingColumns=True)
    counted = running_sum_by_range(items, ["metric", "_sign"], [F.col("_at"), F.col("_kind")], F.col("_kind"), "_below")
    fired = counted.where("_kind = 0 AND _below > 0").select(
        "metric", "_sign", "_row.*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_below"))).alias("_number")
    )
    word = F.when(F.col("_sign") == 1, "above").otherwise("below")
    message = F.concat("metric", F.lit(" of "), "key", F.lit(" is "), word, F.lit(" "), F.col("_limit").cast("string"))
    return fired.join(numbered.drop("_at"), ["metric", "_sign", "_number"]).select(
        "rule", "key", "window_start", "window_end", "severity", "title", message.alias("message"),
        F.explode("channels").alias("channel"), F.lit("open").alias("status"),
    )


def open_alerts(df: DataFrame, skip: int = 0, limit: int = 100, key: str = "id") -> DataFrame:
    return df.where("status = 'open'").orderBy(F.desc("timestamp"), F.col(key)).offset(skip).limit(limit)


def resolve_alerts(df: DataFrame, resolutions: DataFrame, key: str = "id") -> DataFrame:
    """Set status, resolver and time on the alerts named in `resolutions(id, resolved_by, resolved_at)`.

    Of several resolutions of one alert the earliest counts; a resolution without a time resolves nothing.
    """
    first = F.min(F.struct("resolved_at", "resolved_by"))
    done = resolutions.where("resolved_at IS NOT NULL").groupBy(key).agg(first.alias("_first"))
    done = done.select(key, F.col("_first.resolved_by").alias("_by"), F.col("_first.resolved_at").alias("_at"))
    return df.join(done, key, "left").select(
        *[c for c in df.columns if c not in ("status", "resolved_by", "resolved_at")],
        F.when(F.col("_at").isNotNull(), "resolved").otherwise(F.col("status")).alias("status"),
        F.coalesce("_by", "resolved_by").alias("resolved_by") if "resolved_by" in df.columns else F.col("_by").alias("resolved_by"),
        F.coalesce("_at", "resolved_at").alias("resolved_at") if "resolved_at" in df.columns else F.col("_at").alias("resolved_at"),
    )


def metric_series(
    df: DataFrame, name: str, skip: int = 0, limit: int = 100, order: Sequence[str] = ("timestamp", "id")
) -> DataFrame:
    """One page of a metric's readings, newest first."""
    newest = [F.desc(order[0]), *[F.col(c) for c in order[1:]]]
    return df.where(F.col("metric_name") == name).orderBy(*newest).offset(skip).limit(limit)


def classification_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction; undefined ratios are null."""
    actual, predicted = F.col(label) == 1, F.col(prediction) == 1
    out = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(actual & predicted).alias("tp"),
        F.count_if(~actual & predicted).alias("fp"),
        F.count_if(actual & ~predicted).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(
        *by, "n",
        F.try_divide(F.col("n") - fp - fn, F.col("n")).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, values: Sequence, other: str = "other") -> DataFrame:
    """Counts per label (rows) and predicted value (columns); other and missing predictions count under `other`.

    The counts of a table add up to its rows.
    """
    known = F.col(prediction).isin(list(values))
    counts = [F.count_if(F.col(prediction) == F.lit(v)).alias(str(v)) for v in values]
    return df.groupBy(label).agg(*counts, F.count_if(~F.coalesce(known, F.lit(False))).alias(other))


def training_curve(
    df: DataFrame, run: str, order: Sequence[str], loss: str, slice_by: Column
) -> DataFrame:
    """Loss per step with its change from the step before and its perplexity."""
    stepped = previous_row(df, [run], order, slice_by, [loss], name="_before")
    return stepped.withColumn("delta", F.col(loss) - F.col(f"_before.{loss}")).withColumn(
        "perplexity", F.exp(loss)
    ).drop("_before")


def final_metrics(df: DataFrame, run: str, order: Sequence[str], loss: str) -> DataFrame:
    """Last loss and perplexity of every run."""
    return last_value(df, [run], loss, order).withColumn("perplexity", F.exp(loss))


def status_counts(df: DataFrame, status: str, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One column per status value."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(status) == v).alias(v) for v in values])


def latest_status_counts(
    df: DataFrame, parent: str, order: Sequence[Column], status: str, values: Sequence[str]
) -> DataFrame:
    """How many parents have a newest version in each status."""
    return status_counts(top_per_group(df, [parent], order, 1), status, values)


def weekly_trend(df: DataFrame, ts: str, by: str) -> DataFrame:
    """Rows per week and group with the change in percent from the week before; null if that week has no row."""
    weeks = df.groupBy(by, F.date_trunc("week", F.col(ts)).cast("timestamp_ntz").alias("week")).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = W.partitionBy(by).orderBy("week")
    adjacent = F.lag("week").over(ordered) == F.col("week") - F.expr("INTERVAL 7 DAYS")
    before = F.when(adjacent, F.lag("n").over(ordered))
    return weeks.withColumn("change_pct", F.try_divide(F.col("n") - before, before) * 100)


def compare_runs(baseline: DataFrame, projected: DataFrame, on: str = "metric", value: str = "value") -> DataFrame:
    """Metric table of two runs with difference and percentage."""
    left = baseline.select(on, F.col(value).alias("baseline"))
    right = projected.select(on, F.col(value).alias("projected"))
    delta = F.col("projected") - F.col("baseline")
    return left.join(right, on, "full").withColumn("delta", delta).withColumn(
        "delta_pct", F.try_divide(delta, F.col("baseline")) * 100
    )
