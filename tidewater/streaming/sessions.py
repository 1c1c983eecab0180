"""Sessions on a stream: by inactivity alone, and with logouts."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewater.operators import sessions as S
from tidewater.streaming.windows import event_time


def inactivity_sessions(
    df: DataFrame,
    user: str = "user_id",
    ttl: timedelta = timedelta(hours=1),
    ts: str = "ts",
    delay: str = "10 minutes",
) -> DataFrame:
    """Sessions that end after `ttl` without an event; works on streams and batches.

    On a stream Spark merges the windows of a user in state. A batch has all events of a user at hand, so it uses the
    sliced sessions, which give a very active user to many tasks.
    """
    if not df.isStreaming:
        seconds = ttl / timedelta(seconds=1)
        sliced = S.sessions(df, user, (ts,), f"INTERVAL {seconds:.6f} SECONDS")
        return sliced.select(
            user, *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n_events"
        )
    # Spark joins windows that touch, while an access exactly `ttl` later is a new session.
    gap = f"{ttl // timedelta(microseconds=1) - 1} microseconds"
    return (
        event_time(df, ts, delay)
        .groupBy(F.session_window(ts, gap).alias("session"), user)
        .agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last"))
        .select(
            user,
            F.col("session.start").cast("timestamp_ntz").alias("session_start"),
            F.col("last").cast("timestamp_ntz").alias("session_end"),
            "n_events",
        )
    )


STATE = "start long, last long, n long, pending array<long>, logouts array<boolean>"
OpenSession = tuple[int, int, int]


def fold(
    session: OpenSession | None, events: list[tuple[int, bool]], ttl: int, watermark: int
) -> tuple[list[tuple], OpenSession | None]:
    """Run events in time order into the open session (start, last, n); returns the sessions this closes.

    Times are microseconds. Nothing older than the watermark can still arrive, so a session whose
    last event lies `ttl` behind it is closed as well.
    """
    closed = []
    for moment, left in events:
        if session is not None and moment >= session[1] + ttl:
            closed.append((*session, "timeout"))
            session = None
        session = (session[0], moment, session[2] + 1) if session else (moment, moment, 1)
        if left:
            closed.append((*session, "logout"))
            session = None
    if session is not None and watermark >= session[1] + ttl:
        closed.append((*session, "timeout"))
        session = None
    return closed, session


def logout_sessions(
    df: DataFrame,
    logout: Column,
    user: str = "user_id",
    ts: str = "ts",
    ttl: timedelta = timedelta(hours=1),
    delay: str = "10 minutes",
) -> DataFrame:
    """Sessions closed by logout or by `ttl` of inactivity, in event time.

    Users keep their column's name and type. The state of a user is three numbers for the open session and the events not yet behind the
    watermark; those are put in order before they count, so a late logout closes the right session.
    """
    ttl_micros = int(ttl.total_seconds() * 1_000_000)

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, waiting = None, []
        if state.exists:
            start, last, n, pending, logouts = state.get
            session = (start, last, n) if n else None
            waiting = list(zip(pending, logouts))
        watermark = state.getCurrentWatermarkMs() * 1000
        for batch in batches:
            # What is older than the watermark is late: the sessions there are settled.
            batch = batch[batch["moment"] >= watermark]
            waiting += list(zip(batch["moment"].tolist(), batch["logout"].tolist()))
        waiting.sort()
        ready = [e for e in waiting if e[0] < watermark]
        waiting = waiting[len(ready):]
        closed, session = fold(session, ready, ttl_micros, watermark)
        if session or waiting:
            start, last, n = session or (0, 0, 0)
            state.update((start, last, n, [e[0] for e in waiting], [bool(e[1]) for e in waiting]))
            wake = last + ttl_micros if session else waiting[0][0]
            state.setTimeoutTimestamp(max(wake // 1000, state.getCurrentWatermarkMs()) + 1)
        elif state.exists:
            state.remove()
        if closed:
            rows = [(key[0], start, last, n, how) for start, last, n, how in closed]
            yield pd.DataFrame(rows, columns=[user, "session_start", "session_end", "n_events", "closed_by"])

    rows = event_time(df, ts, delay).select(user, ts, F.unix_micros(ts).alias("moment"), logout.alias("logout"))
    output = f"`{user}` {dict(df.dtypes)[user]}, session_start long, session_end long, n_events long, closed_by string"
    found = rows.groupBy(user).applyInPandasWithState(advance, output, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    stamps = {c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}
    return found.withColumns(stamps)
