import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.ordering import last_known, previous_row, running_sum
from tidewater.operators import monitor as M
from tidewater.operators import sessions as S


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "value double").repartition(4)


def brute_ks(a, b):
    grid = np.unique(np.concatenate([a, b]))
    return max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)


@pytest.mark.parametrize("buckets", [3, 200])
@pytest.mark.parametrize("kind", ["shift", "ties", "same", "disjoint"])
def test_ks_matches_brute_force(spark, kind, buckets):
    rng = np.random.default_rng(3)
    a = rng.normal(size=400)
    b = {"shift": rng.normal(0.5, 1, 300), "ties": rng.integers(-2, 2, 300).astype(float), "same": a, "disjoint": a + 100}[kind]
    row = M.data_drift(column(spark, a), column(spark, b), buckets=buckets).first()
    assert row["statistic"] == pytest.approx(brute_ks(a, b), abs=1e-12)
    assert (row["n_base"], row["n_cur"]) == (len(a), len(b))
    assert row["drift_detected"] == (kind != "same")
    assert 0.0 <= row["p_value"] <= 1.0


def test_ks_with_an_empty_sample(spark):
    row = M.data_drift(column(spark, [1, 2]), column(spark, []).where("value > 0")).first()
    assert row["statistic"] is None and row["p_value"] is None and not row["drift_detected"]


def test_concept_drift_threshold_is_strict(spark):
    df = spark.createDataFrame([(1, True)] * 20 + [(0, False)] + [(1, False)] * 19, "hit int, base boolean")
    row = M.concept_drift(df, F.col("hit") == 1, F.col("base"), 0.04).first()
    assert row["accuracy_drop"] == pytest.approx(0.05) and row["drift_detected"]
    assert not M.concept_drift(df, F.col("hit") == 1, F.col("base"), 0.06).first()["drift_detected"]


def test_alerts(spark):
    start = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("m1", "accuracy", 0.7, start, start), ("m2", "accuracy", 0.8, start, start)],
                               "key string, metric string, value double, window_start timestamp_ntz, window_end timestamp_ntz")
    rules = [M.AlertRule("drop", "accuracy", 0.8, above=False, severity="high", title="Accuracy drop", channels=("email", "slack"))]
    out = M.alerts(df, rules).collect()
    assert sorted((r["key"], r["channel"], r["severity"], r["status"]) for r in out) == [
        ("m1", "email", "high", "open"), ("m1", "slack", "high", "open")]
    with pytest.raises(ValueError):
        M.alerts(df, [M.AlertRule("x", "accuracy", 1.0, channels=("pager",))])


def test_classification_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    row = M.classification_metrics(df, "y", "p").first()
    assert row["accuracy"] == 1.0 and row["precision"] is None and row["recall"] is None


def test_average_is_zero_without_rows(spark):
    keys = spark.createDataFrame([(1,), (2,)], "v int")
    log = spark.createDataFrame([(1, 4.0), (1, 6.0)], "v int, latency double")
    assert {r["v"]: r["average"] for r in M.average_per_key(keys, log, "v", "latency").collect()} == {1: 5.0, 2: 0.0}


def events(spark, n=400, users=3, seed=2):
    rng = np.random.default_rng(seed)
    start = dt.datetime(2024, 1, 1)
    # One user has most of the rows.
    rows = [(int(i), int(rng.choice(users, p=[0.8, 0.1, 0.1])), start + dt.timedelta(minutes=int(rng.integers(0, 10_000))),
             bool(rng.random() < 0.1)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, user long, ts timestamp_ntz, out boolean").repartition(7)


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "month"])
def test_sliced_windows_equal_plain_ones(spark, unit):
    rows, df = events(spark)
    cut = F.date_trunc(unit, "ts")
    back = {r["id"]: r["previous"] and r["previous"]["id"] for r in previous_row(df, ["user"], ["ts", "id"], cut, ["id"]).collect()}
    ahead = {r["id"]: r["previous"] and r["previous"]["id"]
             for r in previous_row(df, ["user"], ["ts", "id"], cut, ["id"], following=True).collect()}
    total = {r["id"]: r["s"] for r in running_sum(df, ["user"], ["ts", "id"], cut, F.col("id"), "s").collect()}
    known = {r["id"]: r["k"] for r in last_known(df, ["user"], ["ts", "id"], cut, F.when(F.col("out"), F.col("id")), "k").collect()}
    for user in range(3):
        mine = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0]))
        running, last = 0, None
        for i, r in enumerate(mine):
            running += r[0]
            last = r[0] if r[3] else last
            assert back[r[0]] == (mine[i - 1][0] if i else None)
            assert ahead[r[0]] == (mine[i + 1][0] if i + 1 < len(mine) else None)
            assert total[r[0]] == running and known[r[0]] == last


def brute_sessions(rows, logout):
    out = []
    for user in sorted({r[1] for r in rows}):
        current = None
        for r in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            if current and (current["left"] or r[2] >= current["end"] + dt.timedelta(hours=1)):
                out.append(current)
                current = None
            current = current or {"user": user, "start": r[2], "n": 0}
            current |= {"end": r[2], "n": current["n"] + 1, "left": logout and r[3]}
        if current:
            out.append(current)
    return sorted((c["user"], c["start"], c["end"], c["n"], "logout" if c["left"] else "timeout") for c in out)


@pytest.mark.parametrize("logout", [False, True])
def test_sessions_match_brute_force(spark, logout):
    rows, df = events(spark)
    out = S.sessions(df, "user", ("ts", "id"), logout=F.col("out") if logout else None)
    assert sorted(tuple(r) for r in out.collect()) == brute_sessions(rows, logout)


def test_training_curve_and_trend(spark):
    rows = [("r", i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i * 4), 2.0 - 0.5 * i) for i in range(3)]
    df = spark.createDataFrame(rows, "run string, step int, ts timestamp_ntz, loss double")
    out = M.training_curve(df, "run", ["ts", "step"], "loss", F.date_trunc("day", "ts")).orderBy("step").collect()
    assert [r["delta"] for r in out] == [None, -0.5, -0.5]
    assert M.final_metrics(df, "run", ["ts"], "loss").first()["perplexity"] == pytest.approx(np.exp(1.0))
    trend = M.weekly_trend(df, "ts", "run").orderBy("week").collect()
    assert [(r["n"], r["change_pct"]) for r in trend] == [(2, None), (1, -50.0)]
    later = df.union(spark.createDataFrame([("r", 9, dt.datetime(2024, 2, 1), 0.0)], df.schema))
    gap = M.weekly_trend(later, "ts", "run").orderBy("week").collect()
    assert [(r["n"], r["change_pct"]) for r in gap] == [(2, None), (1, -50.0), (1, None)]


def test_confusion_matrix_counts_every_row(spark):
    df = spark.createDataFrame([(0, 0), (0, 2), (1, 1), (1, None), (None, 1)], "label int, prediction int")
    got = {r["label"]: (r["0"], r["1"], r["other"]) for r in M.confusion_matrix(df, "label", "prediction", [0, 1]).collect()}
    assert got == {0: (1, 0, 1), 1: (0, 1, 1), None: (0, 1, 0)}


def test_rules_of_a_table_fire_like_rules_of_a_list(spark):
    chance = random.Random(2)
    at = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)]
    rows = [
        (f"k{i % 3}", chance.choice(["m", "n", "other", None]), chance.choice([None, float("nan"), 1.0, 2.0, chance.uniform(-5, 5)]), *at)
        for i in range(60)
    ]
    metrics = spark.createDataFrame(rows, "key string, metric string, value double, window_start timestamp_ntz, window_end timestamp_ntz").repartition(3)
    rules = [
        M.AlertRule(f"r{i}", chance.choice(["m", "n"]), chance.choice([1.0, 2.0, float(i % 7) - 3.5]), chance.random() < 0.5,
                    chance.choice(["low", "high"]), chance.choice(["", f"title {i}"]), chance.choice([(), ("email", "slack")]))
        for i in range(40)
    ]
    given = [(r.rule, r.metric, r.limit, r.above, r.severity, r.title, list(r.channels)) for r in rules]
    stored = spark.createDataFrame([*given, ("none", None, 1.0, True, "low", "", []), ("nolimit", "m", None, True, "low", "", [])], M.RULE_COLUMNS)
    columns = ("rule", "key", "window_start", "window_end", "severity", "title", "message", "channel", "status")
    listed = sorted((tuple(r[c] for c in columns) for r in M.alerts(metrics, rules).collect()), key=repr)
    out = M.alerts_by_table(metrics, stored)
    assert sorted((tuple(r[c] for c in columns) for r in out.collect()), key=repr) == listed
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    many = spark.range(100_000).select(
        F.concat(F.lit("r"), "id").alias("rule"), F.lit("m").alias("metric"), (F.col("id") / 1000).alias("limit"), F.lit(True).alias("above"),
        F.lit("low").alias("severity"), F.lit("t").alias("title"), F.array(F.lit("email")).alias("channels"),
    )
    assert M.alerts_by_table(metrics, many).count() == sum(
        100_000 if v != v else min(100_000, max(0, math.ceil(round(v * 1000, 9)))) for _, m, v, *_ in rows if m == "m" and v is not None
    )
    with pytest.raises(ValueError):
        M.alerts_by_table(metrics, stored.withColumn("channels", F.array(F.lit("pager"))))


def test_resolutions_of_one_alert(spark):
    alerts = spark.createDataFrame([(1, "open"), (2, "open"), (3, "open")], "id int, status string")
    at = dt.datetime(2024, 1, 1)
    done = spark.createDataFrame([(1, "late", at + dt.timedelta(hours=1)), (1, "early", at), (2, "x", None), (9, "y", at)],
                                 "id int, resolved_by string, resolved_at timestamp_ntz")
    got = {r["id"]: (r["status"], r["resolved_by"]) for r in M.resolve_alerts(alerts, done).collect()}
    assert got == {1: ("resolved", "early"), 2: ("open", None), 3: ("open", None)}
    assert M.resolve_alerts(alerts, done).count() == 3
