import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewater.operators import governance as G
from tidewater.sources import files

KEY, OTHER = "0123456789abcdef", b"fedcba9876543210"


def test_unknown_event_type_goes_to_system(spark):
    df = spark.createDataFrame([("login_failure",), ("model_train",), ("no_such_event",), (None,)], "event_type string")
    assert [r["category"] for r in G.route(df).collect()] == ["security", "model", "system", "system"]


def test_unknown_actions(spark):
    df = spark.createDataFrame([("WRITE",), ("list",)], "a string")
    got = [tuple(r) for r in df.select(G.data_event(F.col("a")), G.model_event(F.col("a"))).collect()]
    assert got == [("data_write", "model_update"), ("data_read", "model_update")]


def test_audit_round_trip(spark, tmp_path):
    at = dt.datetime(2024, 1, 1, 10)
    df = spark.createDataFrame([("u1", "read", at), ("u2", "export", at + dt.timedelta(hours=1)), ("u1", "write", at + dt.timedelta(hours=2))],
                               "user string, action string, ts timestamp_ntz")
    path = str(tmp_path / "audit")
    events = G.audit_events(df, G.data_event(F.col("action")), F.col("user"), F.col("ts"), F.col("action"))
    files.write_audit(events, path)
    logs = files.read_audit(spark, path, "data")
    assert G.query_audit(logs, "data", "2024-01-01 10:00:00", "2024-01-01 11:00:00").count() == 2
    assert G.query_audit(logs, "data", user_id="u1").count() == 2
    assert G.query_audit(logs).isEmpty()
    assert files.read_audit(spark, path, "security").isEmpty()


def test_malformed_lines_are_skipped(spark, tmp_path):
    line = {"timestamp": "2031-02-03 06:05:04,250", "level": "INFO", "category": "security", "message": {
        "event_type": "login_success", "user_id": "u", "resource": None, "action": "login", "status": "success",
        "ip_address": "10.20.30.40", "timestamp": "2031-02-03T04:05:04.125000", "details": {"a": "b"}}}
    (tmp_path / "security.log").write_text(json.dumps(line) + "\n{broken\n\n" + json.dumps(line) + "\n")
    logs = files.read_audit(spark, str(tmp_path / "security.log"))
    assert logs.count() == 2 and len(logs.collect()) == 2
    assert G.query_audit(logs, "security", start="2031-02-03 04:05:04.125000", end="2031-02-03 04:05:04.125000").count() == 2
    assert logs.first()["message"]["details"] == {"a": "b"}


def test_encryption(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, None)], "id int, s string")
    stored = G.encrypt_columns(df, ["s"], KEY, "k1")
    assert dict(stored.dtypes)["s"] == "binary"
    stored.createOrReplaceTempView("stored")
    values = [r["s"] for r in stored.orderBy("id").collect()]
    assert values[0] != values[1] and values[2] is None
    assert [r["s"] for r in G.decrypt_columns(stored, ["s"], KEY).orderBy("id").collect()] == ["same", "same", None]
    assert [r["s"] for r in G.decrypt_columns(stored, ["s"], OTHER).collect()] == [None] * 3
    turned = G.rotate_key(stored, ["s"], KEY, OTHER, "k2")
    assert [r["s"] for r in G.decrypt_columns(turned, ["s"], OTHER).orderBy("id").collect()] == ["same", "same", None]
    assert turned.first()["key_id"] == "k2"
    with pytest.raises(Exception):
        G.rotate_key(stored, ["s"], OTHER, KEY, "k3").collect()
    with pytest.raises(ValueError):
        G.encrypt_columns(df, ["s"], "short")


def test_key_is_not_in_the_plan(spark):
    df = spark.range(5).select("id", F.col("id").cast("string").alias("s"))
    stored = G.encrypt_columns(df, ["s"], KEY, "k1")
    opened = G.decrypt_columns(G.rotate_key(stored, ["s"], KEY, OTHER, "k2"), ["s"], OTHER)
    assert [r["s"] for r in opened.orderBy("id").collect()] == list("01234")
    for frame in (stored, opened):
        frame.collect()
        text = frame._jdf.queryExecution().toString() + frame._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        )
        for key in (KEY.encode(), OTHER):
            assert key.decode() not in text and key.hex() not in text.lower() and str(list(key))[1:-1] not in text


def test_encrypted_rows_round_trip_through_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5)], "id int, s string, d double")
    G.encrypt_columns(df, ["s", "d"], KEY).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert [t for _, t in stored.dtypes] == ["int", "binary", "binary"]
    assert tuple(G.decrypt_columns(stored, ["s", "d"], KEY).first()) == (1, "a", "2.5")


def test_fingerprint_is_the_hash_of_sorted_json(spark):
    device = {"user_agent": 'Moz "5" \\ x', "ip": "1.2.3.4", "os": None}
    df = spark.createDataFrame([(device,), (dict(reversed(device.items())),), ({},)], "d map<string,string>")
    got = [r[0] for r in df.select(G.device_fingerprint(F.col("d"))).collect()]
    expected = hashlib.sha256(json.dumps(device, sort_keys=True).encode()).hexdigest()
    assert got == [expected, expected, hashlib.sha256(b"{}").hexdigest()]


def test_permissions(spark):
    assert {r: len(p) for r, p in G.ROLE_PERMISSIONS.items()} == {"admin": 19, "data_scientist": 10, "ml_engineer": 14, "viewer": 5}
    df = spark.createDataFrame([("viewer", "model:read"), ("viewer", "model:delete"), ("nobody", "model:read"), ("admin", "user:manage")],
                               "role string, permission string")
    assert [r["granted"] for r in G.check_access(df).collect()] == [True, False, False, True]


def test_archive_keeps_every_row(spark, tmp_path):
    at = dt.datetime(2024, 1, 10)
    rows = [(i, None if i == 7 else at - dt.timedelta(days=i), "ab"[i % 2]) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, kind string")
    cutoff = F.lit("2024-01-05").cast("timestamp_ntz")
    old, keep = str(tmp_path / "old"), str(tmp_path / "keep")
    with pytest.raises(TypeError):
        G.archive(df, "ts", cutoff, old, keep)  # a run must be named
    assert G.archive(df, "ts", cutoff, old, keep, ["kind"], run="0") == {"archived_count": 3, "kept_count": 7}
    # A retry of a run replaces it; another run adds to it; other rows under its name are refused.
    assert G.archive(df, "ts", cutoff, old, keep, ["kind"], run="0") == {"archived_count": 3, "kept_count": 7}
    assert (tmp_path / "old" / "run=0" / "kind=a").is_dir()
    assert G.archived_rows(spark, old).count() == 3 and G.archived_rows(spark, keep).count() == 7
    later = df.withColumn("ts", F.col("ts") - F.expr("INTERVAL 1 HOUR"))
    with pytest.raises(ValueError):
        G.archive(later, "ts", cutoff, old, keep, ["kind"], run="0")
    assert G.archive(later, "ts", cutoff, old, keep, ["kind"], run="1")["archived_count"] == 4
    assert G.archived_rows(spark, old).count() == 7
    summary = G.retention(df.withColumn("size", F.lit(1024 * 1024)), "ts", "size", cutoff).first()
    assert (summary["deleted_count"], summary["deleted_size_mb"], summary["dry_run"]) == (3, 3.0, True)
    assert G.expired(df, "ts", cutoff).count() == 3
