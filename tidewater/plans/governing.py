"""Queries over the governance operators; events stand in for the audit log."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import envelope as V
from tidewater.operators import governance as G
from tidewater.plans.base import query, table
from tidewater.session import checkpointed, ensure_checkpoint_dir

ACTIONS = {"click": "read", "view": "EXPORT", "purchase": "write", "signup": "train", "error": "unknown"}
ACTION_SQL = "CASE event_type WHEN 'click' THEN 'read' WHEN 'view' THEN 'EXPORT' WHEN 'purchase' THEN 'write' WHEN 'signup' THEN 'train' ELSE 'unknown' END"
# Signups are model operations, the rest data accesses.
TYPE_SQL = """CASE event_type WHEN 'click' THEN 'data_read' WHEN 'view' THEN 'data_export' WHEN 'purchase' THEN 'data_write'
  WHEN 'signup' THEN 'model_train' ELSE 'data_read' END"""


def acted(spark: SparkSession, folder: str) -> DataFrame:
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return table(spark, folder, "events").withColumn("action", action[F.col("event_type")])


def audit_log(spark: SparkSession, folder: str) -> DataFrame:
    event_type = F.when(F.col("event_type") == "signup", G.model_event(F.col("action"))).otherwise(
        G.data_event(F.col("action"))
    )
    return G.audit_events(
        acted(spark, folder), event_type, F.col("user_id"), F.col("ts"), F.col("action"),
        status=F.when(F.col("event_type") == "error", "failure").otherwise("success"),
        details=F.from_json("props", "map<string,string>"),
    )


@query(
    "route_events",
    """SELECT event_id, CASE t WHEN 'login_failure' THEN 'security' WHEN 'access_granted' THEN 'access' WHEN 'access_denied' THEN 'access'
        WHEN 'login_success' THEN 'security' ELSE 'system' END AS category, t AS event_type
    FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN CASE WHEN value > 10 THEN 'login_success' ELSE 'login_failure' END
      WHEN 'purchase' THEN CASE WHEN value > 10 THEN 'access_granted' ELSE 'access_denied' END
      WHEN 'error' THEN 'system_error' ELSE event_type END AS t FROM events)""",
)
def route_events(spark: SparkSession, folder: str) -> DataFrame:
    high = F.col("value") > 10
    kind = (
        F.when(F.col("event_type") == "signup", G.login_event(high))
        .when(F.col("event_type") == "purchase", G.access_event(high))
        .when(F.col("event_type") == "error", "system_error")
        .otherwise(F.col("event_type"))
    )
    return G.route(table(spark, folder, "events").select("event_id", kind.alias("event_type")))


@query(
    "audit_events",
    f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", CASE WHEN event_type = 'signup' THEN 'model' ELSE 'data' END AS category,
      {TYPE_SQL} AS event_type, user_id::VARCHAR AS user_id, {ACTION_SQL} AS action,
      CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, json_extract_string(props, '$.k') AS k FROM events""",
)
def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    return audit_log(spark, folder).select(
        "timestamp", "category", *[F.col(f"message.{c}") for c in ("event_type", "user_id", "action", "status")],
        F.col("message.details")["k"].alias("k"),
    )


@query(
    "query_audit",
    f"""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "timestamp", {TYPE_SQL} AS event_type FROM events
    WHERE event_type <> 'signup' AND user_id = 12 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'""",
)
def query_audit(spark: SparkSession, folder: str) -> DataFrame:
    out = G.query_audit(audit_log(spark, folder), "data", "2024-01-05 00:00:00", "2024-01-20 12:00:00", "12")
    return out.select("timestamp", "message.event_type")


# A sample key for the round trip below; a job passes its own.
SAMPLE_KEY, NEXT_KEY = "0123456789abcdef", "fedcba9876543210fedcba9876543210"


def secrets(spark: SparkSession, folder: str) -> DataFrame:
    named = F.when(F.col("c_acctbal") > 0, F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", named.alias("c_name"), "c_acctbal")


@query("encrypt_columns")
def encrypt_columns(spark: SparkSession, folder: str) -> DataFrame:
    return G.encrypt_columns(secrets(spark, folder), ["c_name", "c_acctbal"], SAMPLE_KEY, "k1")


@query(
    "decrypt_columns",
    """SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS c_name, c_acctbal,
      CASE WHEN c_acctbal > 0 THEN length(c_name) + 28 END::INT AS stored_bytes, NULL::VARCHAR AS wrong_key FROM customer""",
)
def decrypt_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Round trip: names come back, the stored form adds 28 bytes, a wrong key opens nothing."""
    stored = G.encrypt_columns(secrets(spark, folder), ["c_name", "c_acctbal"], SAMPLE_KEY)
    kept = stored.withColumn("stored_bytes", F.length("c_name")).withColumn("wrong_key", F.col("c_name"))
    opened = G.decrypt_columns(kept, ["c_name", "c_acctbal"], SAMPLE_KEY)
    return G.decrypt_columns(opened, ["wrong_key"], NEXT_KEY).withColumn("c_acctbal", F.col("c_acctbal").cast("double"))


@query(
    "rotate_key",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS c_name, c_acctbal, 'k2' AS key_id FROM customer",
)
def rotate_key(spark: SparkSession, folder: str) -> DataFrame:
    stored = G.encrypt_columns(secrets(spark, folder), ["c_name"], SAMPLE_KEY, "k1")
    return G.decrypt_columns(G.rotate_key(stored, ["c_name"], SAMPLE_KEY, NEXT_KEY, "k2"), ["c_name"], NEXT_KEY)


@query(
    "envelope_rotation",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name END AS c_name, c_acctbal, NULL::VARCHAR AS old_key FROM customer",
)
def envelope_rotation(spark: SparkSession, folder: str) -> DataFrame:
    """A data key for each nation; after a new master key the new one opens all names and the old one none."""
    rows = secrets(spark, folder).join(table(spark, folder, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/keys-{uuid4().hex}"
    stored = V.encrypt_by_group(rows, ["c_name"], "c_nationkey", V.add_groups(rows, "c_nationkey", path, SAMPLE_KEY, "m1"), SAMPLE_KEY)
    stored = checkpointed(stored.withColumn("old_key", F.col("c_name")))
    keys = V.rotate_master(spark, path, SAMPLE_KEY, NEXT_KEY, "m2")
    opened = V.decrypt_by_group(stored, ["c_name"], "c_nationkey", keys, NEXT_KEY)
    return V.decrypt_by_group(opened, ["old_key"], "c_nationkey", keys, SAMPLE_KEY).drop("c_nationkey")


@query(
    "device_mismatches",
    """WITH f AS (SELECT event_id, user_id, ts, sha256('{"k": "' || json_extract_string(props, '$.k') || '", "type": "' || event_type || '"}') AS fp FROM events)
    SELECT event_id, fp AS fingerprint, fp = first_value(fp) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS device_matches FROM f""",
)
def device_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    device = F.map_concat(F.create_map(F.lit("type"), F.col("event_type")), F.from_json("props", "map<string,string>"))
    seen = table(spark, folder, "events").select("event_id", "user_id", "ts", G.device_entries(device).alias("device"))
    out = G.device_mismatches(seen, "user_id", "device", ["ts", "event_id"])
    return out.select("event_id", G.entries_fingerprint(F.col("device")).alias("fingerprint"), "device_matches")


ROLES = ("admin", "data_scientist", "ml_engineer", "viewer", "guest")
NEEDED = {"click": "dataset:read", "view": "model:read", "purchase": "artifact:promote", "signup": "user:manage", "error": "job:submit"}


@query(
    "check_access",
    """WITH e AS (SELECT event_id, ['admin', 'data_scientist', 'ml_engineer', 'viewer', 'guest'][user_id % 5 + 1] AS role,
      CASE event_type WHEN 'click' THEN 'dataset:read' WHEN 'view' THEN 'model:read' WHEN 'purchase' THEN 'artifact:promote'
        WHEN 'signup' THEN 'user:manage' ELSE 'job:submit' END AS permission FROM events)
    SELECT *, CASE role WHEN 'admin' THEN true WHEN 'data_scientist' THEN permission IN ('dataset:read', 'model:read', 'job:submit')
      WHEN 'ml_engineer' THEN permission IN ('dataset:read', 'model:read', 'job:submit', 'artifact:promote')
      WHEN 'viewer' THEN permission IN ('dataset:read', 'model:read') ELSE false END AS granted FROM e""",
)
def check_access(spark: SparkSession, folder: str) -> DataFrame:
    role = F.get(F.array(*[F.lit(r) for r in ROLES]), (F.col("user_id") % 5).cast("int"))
    needed = F.create_map(*[F.lit(x) for pair in NEEDED.items() for x in pair])[F.col("event_type")]
    return G.check_access(table(spark, folder, "events").select("event_id", role.alias("role"), needed.alias("permission")))


@query(
    "retention",
    """SELECT event_type, count(*) FILTER (WHERE old) AS deleted_count, round(coalesce(sum(size) FILTER (WHERE old), 0) / 1048576, 2) AS deleted_size_mb,
      count(*) FILTER (WHERE NOT old) AS kept_count, round(coalesce(sum(size) FILTER (WHERE NOT old), 0) / 1048576, 2) AS kept_size_mb, true AS dry_run
    FROM (SELECT event_type, ts < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY AS old, length(props) * 1000 AS size FROM events) GROUP BY event_type""",
)
def retention(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "events").withColumn("size", F.length("props") * 1000)
    cutoff = F.lit("2024-01-31").cast("timestamp_ntz") - F.expr("INTERVAL 10 DAY")
    return G.retention(files, "ts", "size", cutoff, ["event_type"])
