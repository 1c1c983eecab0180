"""Audit events, column encryption, device checks, permissions, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import file_system

# Audit categories and their event types.
EVENT_CATEGORIES = {
    "security": ("login_success", "login_failure", "logout", "mfa_enabled", "mfa_disabled", "password_change"),
    "access": ("access_granted", "access_denied", "permission_change"),
    "data": ("data_read", "data_write", "data_delete", "data_export"),
    "model": ("model_train", "model_deploy", "model_delete", "model_update"),
    "system": ("config_change", "key_rotation", "backup_created", "system_error"),
}
# Action -> event type, with the type of an unknown action.
DATA_ACTIONS = {"read": "data_read", "write": "data_write", "delete": "data_delete", "export": "data_export"}
UNKNOWN_DATA_ACTION = "data_read"
MODEL_ACTIONS = {"train": "model_train", "deploy": "model_deploy", "delete": "model_delete", "update": "model_update"}
UNKNOWN_MODEL_ACTION = "model_update"

# Permissions, and those of each role ("admin" has all).
PERMISSIONS = (
    "dataset:read", "dataset:write", "dataset:delete",
    "model:read", "model:create", "model:update", "model:delete",
    "job:read", "job:submit", "job:cancel",
    "artifact:read", "artifact:write", "artifact:delete", "artifact:promote",
    "deploy:read", "deploy:create", "deploy:delete",
    "user:manage", "system:config",
)
ROLE_PERMISSIONS = {
    "admin": PERMISSIONS,
    "data_scientist": (
        "dataset:read", "dataset:write", "model:read", "model:create", "model:update",
        "job:read", "job:submit", "artifact:read", "artifact:write", "deploy:read",
    ),
    "ml_engineer": (
        "dataset:read", "model:read", "model:create", "model:update", "model:delete",
        "job:read", "job:submit", "job:cancel", "artifact:read", "artifact:write", "artifact:promote",
        "deploy:read", "deploy:create", "deploy:delete",
    ),
    "viewer": ("dataset:read", "model:read", "job:read", "artifact:read", "deploy:read"),
}

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("message", T.StructType([
        T.StructField("event_type", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("resource", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("ip_address", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ])),
])


def _lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed mapping, null for an unknown key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), key)


def category(event_type: Column) -> Column:
    """Audit category of an event type; an unknown type goes to the system log."""
    by_type = {event: name for name, events in EVENT_CATEGORIES.items() for event in events}
    return F.coalesce(_lookup(by_type, event_type), F.lit("system"))


def route(df: DataFrame, event_type: str = "event_type") -> DataFrame:
    return df.withColumn("category", category(F.col(event_type)))


def login_event(success: Column) -> Column:
    return F.when(success, "login_success").otherwise("login_failure")


def access_event(granted: Column) -> Column:
    return F.when(granted, "access_granted").otherwise("access_denied")


def data_event(action: Column) -> Column:
    return F.coalesce(_lookup(DATA_ACTIONS, F.lower(action)), F.lit(UNKNOWN_DATA_ACTION))


def model_event(action: Column) -> Column:
    return F.coalesce(_lookup(MODEL_ACTIONS, F.lower(action)), F.lit(UNKNOWN_MODEL_ACTION))


def audit_events(
    df: DataFrame,
    event_type: Column,
    user_id: Column,
    timestamp: Column,
    action: Column,
    status: Column | None = None,
    resource: Column | None = None,
    ip_address: Column | None = None,
    details: Column | None = None,
    level: str = "INFO",
) -> DataFrame:
    """Audit log rows in the shape of the log files: category beside a nested message."""
    moment = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    nothing = F.lit(None).cast("string")
    message = F.struct(
        event_type.alias("event_type"),
        user_id.cast("string").alias("user_id"),
        (resource if resource is not None else nothing).alias("resource"),
        action.alias("action"),
        (status if status is not None else F.lit("success")).alias("status"),
        (ip_address if ip_address is not None else nothing).alias("ip_address"),
        moment.alias("timestamp"),
        (details if details is not None else F.create_map().cast("map<string,string>")).alias("details"),
    )
    return df.select(moment.alias("timestamp"), F.lit(level).alias("level"), category(event_type).alias("category"), message.alias("message"))


def query_audit(
    logs: DataFrame,
    category: str | None = "security",
    start: str | None = None,
    end: str | None = None,
    user_id: str | None = None,
) -> DataFrame:
    """Log rows by category, time range (both ends included) and user.

    Time and user are those inside the message: the outer stamp carries the writer's local time.
    """
    out = logs if category is None else logs.where(F.col("category") == category)
    moment = F.to_timestamp_ntz(F.col("message.timestamp"))
    if start is not None:
        out = out.where(moment >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(moment <= F.lit(end).cast("timestamp_ntz"))
    return out if user_id is None else out.where(F.col("message.user_id") == user_id)


def encrypt_columns(df: DataFrame, columns: Sequence[str], key: str | bytes, key_id: str | None = None) -> DataFrame:
    """Replace columns by their AES-GCM form (binary); null stays null, equal values differ."""
    secret = secret_key(df.sparkSession, key)
    out = df.withColumns({c: F.aes_encrypt(F.col(c).cast("string"), secret) for c in columns})
    return out if key_id is None else out.withColumn("key_id", F.lit(key_id))


def decrypt_columns(df: DataFrame, columns: Sequence[str], key: str | bytes) -> DataFrame:
    """Decrypt to text; a value the key does not open becomes null."""
    secret = secret_key(df.sparkSession, key)
    return df.withColumns({c: F.try_aes_decrypt(F.col(c), secret).cast("string") for c in columns})


def rotate_key(df: DataFrame, columns: Sequence[str], old: str | bytes, new: str | bytes, key_id: str) -> DataFrame:
    """Encrypt again under a new key. A value the old key does not open fails the job instead of being lost."""
    before, after = secret_key(df.sparkSession, old), secret_key(df.sparkSession, new)
    opened = {c: F.aes_encrypt(F.aes_decrypt(F.col(c), before), after) for c in columns}
    return df.withColumns(opened).withColumn("key_id", F.lit(key_id))


def secret_key(spark: SparkSession, key: str | bytes) -> Column:
    """The key as a scalar subquery over a one-row table: a literal would stand in plans and event logs."""
    raw = key.encode() if isinstance(key, str) else key
    if len(raw) not in (16, 24, 32):
        raise ValueError("an AES key has 16, 24 or 32 bytes")
    return spark.createDataFrame(spark.sparkContext.parallelize([(bytearray(raw),)], 1), "secret binary").scalar()


def device_entries(device: Column) -> Column:
    """A device map as a sorted list of its entries, which can be compared and grouped."""
    return F.array_sort(F.map_entries(device))


def device_fingerprint(device: Column) -> Column:
    """SHA-256 of a device map as JSON with sorted keys."""
    return entries_fingerprint(device_entries(device))


def entries_fingerprint(entries: Column) -> Column:
    """The fingerprint of a device whose entries are sorted already."""

    def quoted(value: Column) -> Column:
        listed = F.to_json(F.array(value))
        return F.substring(listed, F.lit(2), F.length(listed) - 2)

    pairs = F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), quoted(e["value"])))
    return F.sha2(F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")), 256)


def device_mismatches(df: DataFrame, session: str, device: str, order: Sequence[str]) -> DataFrame:
    """Mark accesses whose device differs from the first one of their session.

    `device` is any column that can be compared: a stored fingerprint, or the sorted entries, so that hashes are only
    made of what is kept.
    """
    first = df.groupBy(session).agg(F.min_by(device, F.struct(*order)).alias("_first"))
    return df.join(first, session).withColumn("device_matches", F.col(device) == F.col("_first")).drop("_first")


def has_permission(role: Column, permission: Column) -> Column:
    """Whether the role grants the permission; an unknown role grants none."""
    granted = F.create_map(
        *[x for name, owned in ROLE_PERMISSIONS.items() for x in (F.lit(name), F.array(*[F.lit(p) for p in owned]))]
    )
    return F.coalesce(F.array_contains(F.try_element_at(granted, role), permission), F.lit(False))


def check_access(df: DataFrame, role: str = "role", permission: str = "permission") -> DataFrame:
    return df.withColumn("granted", has_permission(F.col(role), F.col(permission)))


def retention(df: DataFrame, modified: str, size: str, cutoff: Column, by: Sequence[str] = ()) -> DataFrame:
    """What a clean-up up to `cutoff` would remove and keep: rows and MB (rounded to 2 digits).

    A plan only, which `dry_run` says; `sources.files.expire_files` deletes.
    """
    old = F.col(modified) < cutoff
    mb = 1024 * 1024

    def total(condition: Column) -> Column:
        return F.round(F.coalesce(F.sum(F.when(condition, F.col(size))), F.lit(0)) / mb, 2)

    return df.groupBy(*by).agg(
        F.count_if(old).alias("deleted_count"), total(old).alias("deleted_size_mb"),
        F.count_if(~old).alias("kept_count"), total(~old).alias("kept_size_mb"),
    ).withColumn("dry_run", F.lit(True))


def expired(df: DataFrame, modified: str, cutoff: Column) -> DataFrame:
    return df.where(F.col(modified) < cutoff)


def archive(
    df: DataFrame,
    modified: str,
    cutoff: Column,
    archive_path: str,
    keep_path: str,
    partition_by: Sequence[str] = (),
    *,
    run: str,
) -> dict[str, int]:
    """Write old rows to the archive and the rest to a new path, both in the same layout, under the run's own folder.

    The source stays untouched. A run that is repeated, after a failure for example, replaces what it wrote before and
    nothing else, so a retry archives no row twice; `archived_rows` reads the runs together. A run of the same name over
    other rows is refused: each run notes the number of its rows and a digest of the column that decides. The input is
    read once for each output; the counts read back from both must add up to those of a pass over that one column.
    """
    spark = df.sparkSession
    old = F.coalesce(F.col(modified) < cutoff, F.lit(False))
    mixed = F.xxhash64(F.col(modified))
    counts = df.select(old.alias("old"), mixed.alias("mixed")).agg(
        F.count_if("old").alias("old"),
        F.count_if(~F.col("old")).alias("kept"),
        F.coalesce(F.bit_xor("mixed"), F.lit(0)).alias("digest"),
        F.coalesce(F.sum(F.shiftright("mixed", 32)), F.lit(0)).alias("total"),
    ).first()
    _claim_run(spark, f"{archive_path}/_runs/{run}", [counts[c] for c in ("old", "kept", "digest", "total")])
    expected = {"archived_count": counts["old"], "kept_count": counts["kept"]}
    parts = {"archived_count": (old, f"{archive_path}/run={run}"), "kept_count": (~old, f"{keep_path}/run={run}")}
    written = {}
    for name, (condition, path) in parts.items():
        df.where(condition).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        written[name] = spark.read.schema(df.schema).parquet(path).count()
    if written != expected:
        raise RuntimeError(f"archive wrote {written} of {expected}")
    return written


def _claim_run(spark: SparkSession, path: str, facts: list[int]) -> None:
    """Note what a run reads before it writes; an error if a run of this name read something else."""
    files, place = file_system(spark, path)
    schema = "old long, kept long, digest long, total long"
    if files.exists(place) and (known := spark.read.schema(schema).json(path).first()):
        if list(known) != facts:
            raise ValueError(f"another input was archived as this run: {path}")
        return
    spark.createDataFrame([tuple(facts)], schema).coalesce(1).write.mode("overwrite").json(path)


def archived_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows that runs have archived (or kept), with the `run` that wrote them."""
    return spark.read.option("basePath", path).parquet(path)
