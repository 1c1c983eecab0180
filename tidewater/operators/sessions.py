"""User sessions: closed by inactivity or by logout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SESSION_TTL = "INTERVAL 3600 SECONDS"


def sessions(
    df: DataFrame,
    user: str = "user_id",
    order: Sequence[str] = ("ts", "event_id"),
    ttl: str = SESSION_TTL,
    logout: Column | None = None,
    slice_by: Column | None = None,
) -> DataFrame:
    """Sessions per user: start, end, number of events and how it closed.

    An access within `ttl` of the one before extends the session; a logout closes it. Sessions are
    built inside one day of a user (or another `slice_by`), so a very active user is shared by many
    tasks. Only the first and last session of a slice can continue in a neighbour; those are joined
    up per user, two rows per slice.
    """
    ts = order[0]
    slices = slice_by if slice_by is not None else F.date_trunc("day", F.col(ts))
    rows = df.select(
        user, *order, (logout if logout is not None else F.lit(False)).alias("_logout"), slices.alias("_slice")
    )
    inside = W.partitionBy(user, "_slice").orderBy(*order)
    apart = F.lag("_logout").over(inside) | (F.col(ts) >= F.lag(ts).over(inside) + F.expr(ttl))
    local = (
        rows.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int"))
        .withColumn("_no", F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(user, "_slice", "_no")
        .agg(
            F.min(ts).alias("session_start"),
            F.max(ts).alias("session_end"),
            F.count(F.lit(1)).alias("n_events"),
            F.max_by("_logout", F.struct(*order)).alias("_logout"),
        )
        .withColumn("_last", F.max("_no").over(W.partitionBy(user, "_slice")))
    )
    at_edge = (F.col("_no") == 0) | (F.col("_no") == F.col("_last"))

    per_user = W.partitionBy(user).orderBy("_slice", "_no")
    continues = (
        (F.lag("_slice").over(per_user) != F.col("_slice"))
        & ~F.lag("_logout").over(per_user)
        & (F.col("session_start") < F.lag("session_end").over(per_user) + F.expr(ttl))
    )
    joined = (
        local.where(at_edge)
        .withColumn("_new", (~F.coalesce(continues, F.lit(False))).cast("int"))
        .withColumn("_no", F.sum("_new").over(per_user.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(user, "_no")
        .agg(
            F.min("session_start").alias("session_start"),
            F.max("session_end").alias("session_end"),
            F.sum("n_events").alias("n_events"),
            F.max_by("_logout", "_slice").alias("_logout"),
        )
    )
    columns = [user, "session_start", "session_end", "n_events", "_logout"]
    return (
        local.where(~at_edge).select(*columns).unionByName(joined.select(*columns))
        .withColumn("closed_by", F.when(F.col("_logout"), "logout").otherwise("timeout"))
        .drop("_logout")
    )


def open_sessions(found: DataFrame, at: Column | str, ttl: str = SESSION_TTL) -> DataFrame:
    """Sessions still open at a time: begun, not logged out, and the last access less than `ttl` ago."""
    moment = F.lit(at).cast("timestamp_ntz") if isinstance(at, str) else at
    alive = (F.col("session_end") + F.expr(ttl) > moment) & (
        (F.col("closed_by") != "logout") | (F.col("session_end") > moment)
    )
    return found.where((F.col("session_start") <= moment) & alive)
