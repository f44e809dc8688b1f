"""Session lifetime as a stream: the state of each session, with a timer at its expiry.

A login opens a session until its expiry; a logout ends it; when event time passes the expiry, the timer closes what is
still open. A session is given out once, when it closes, as ``ended`` or ``expired``. Events may come late and in any order
as long as the watermark has not passed them: a logout that comes before its login is kept until that comes.

Sessions are dealt to ``BUCKETS`` by a hash. A bucket's sessions are one state, changed as columns: a call to the state store
for each session took most of the time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "session_id long, user_id long, kind string, at timestamp, expires_at timestamp"
CLOSED = "session_id long, user_id long, state string, login_at timestamp, closed_at timestamp"
#: Timers and several states of one key need the state store that keeps column families.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ORPHANS_MS = 86_400_000
#: Fixed once a stream has state: of a hundred million sessions that are not over, a bucket holds 5 MB.
BUCKETS = 1_024
#: The sessions of a bucket that are not over, six longs each (times are microseconds), and when their timer is set.
_STATE = "sessions binary, timer long"


#: Times and ids that are not known.
_NONE = np.iinfo(np.int64).min
_COLUMNS = ["session_id", "user_id", "login_at", "expires_at", "ended_at", "closed"]


def _longs(values: pd.Series) -> np.ndarray:
    """Ids, or times as microseconds."""
    none = values.isna().to_numpy()
    if values.dtype.kind == "M":
        longs = values.to_numpy("datetime64[us]").view(np.int64)
    else:
        longs = values.mask(none, 0).astype(np.int64).to_numpy()
    return np.where(none, _NONE, longs)


def _due(held: pd.DataFrame) -> pd.Series:
    """When the timer of each session is due, in milliseconds."""
    orphan = ORPHANS_MS + held["ended_at"] // 1_000
    return orphan.where(held["login_at"] == _NONE, -(-held["expires_at"] // 1_000))


def _rows(sessions: pd.DataFrame, state: str, closed_at: pd.Series) -> pd.DataFrame:
    def nulls(longs):
        return longs.astype("Int64").mask(longs == _NONE)

    return pd.DataFrame(
        {
            "session_id": nulls(sessions["session_id"]),
            "user_id": nulls(sessions["user_id"]),
            "state": state,
            "login_at": pd.to_datetime(sessions["login_at"], unit="us"),
            "closed_at": pd.to_datetime(closed_at, unit="us"),
        }
    )


class SessionLife(StatefulProcessor):
    """Keyed by a bucket of sessions, which share a state and a timer at what is due first. An expired session goes at once, an
    ended one at its expiry: until then what else comes for it is passed over. A logout without a login is kept for
    ``ORPHANS_MS``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", _STATE)

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        if not self.bucket.exists():
            return pd.DataFrame({c: np.empty(0, np.int64) for c in _COLUMNS}), None
        packed, timer = self.bucket.get()
        return pd.DataFrame(np.frombuffer(packed, np.int64).reshape(-1, len(_COLUMNS)), columns=_COLUMNS), timer

    def _hold(self, held: pd.DataFrame, timer: int | None) -> None:
        first = None if held.empty else int(_due(held).min())
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if first is None:
            self.bucket.clear()
        else:
            self.bucket.update((np.ascontiguousarray(held[_COLUMNS].to_numpy(np.int64)).tobytes(), first))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[part["kind"].isin(["login", "logout"])] for part in rows]  # others only move time
        came = pd.concat(parts, ignore_index=True)
        if came.empty:
            return
        held, timer = self._held()
        login = (came["kind"] == "login").to_numpy()
        at = _longs(came["at"])
        events = pd.DataFrame(
            {
                "session_id": _longs(came["session_id"]),
                "user_id": np.where(login, _longs(came["user_id"]), _NONE),
                "login_at": np.where(login, at, _NONE),
                "expires_at": np.where(login, _longs(came["expires_at"]), _NONE),
                "ended_at": np.where(login, _NONE, at),
                "closed": 0,
            }
        )
        done = held[held["closed"] == 1]
        events = events[~events["session_id"].isin(done["session_id"])]
        touched = held["session_id"].isin(events["session_id"]) & (held["closed"] == 0)
        # The first login and the first end count; what is held goes before what comes at the same time.
        both = pd.concat([held[touched], events], ignore_index=True)
        logins = both[both["login_at"] != _NONE].sort_values("login_at", kind="stable").drop_duplicates("session_id")
        ends = both[both["ended_at"] != _NONE].groupby("session_id", as_index=False)["ended_at"].min()
        merged = logins.drop(columns="ended_at").merge(ends, "outer", "session_id")
        merged = merged.assign(closed=0)[_COLUMNS]
        for name in _COLUMNS[1:5]:
            merged[name] = merged[name].astype("Int64").fillna(_NONE).astype(np.int64)
        over = (merged["login_at"] != _NONE) & (merged["ended_at"] != _NONE) & (merged["ended_at"] < merged["expires_at"])
        merged["closed"] = over.astype(np.int64)
        self._hold(pd.concat([held[~touched], merged], ignore_index=True), timer)
        if over.any():
            ended = merged[over]
            yield _rows(ended, "ended", ended[["login_at", "ended_at"]].max(axis=1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if timer is None or now < timer:
            return
        due = _due(held) <= max(now, timerValues.getCurrentWatermarkInMs() - 1)
        self._hold(held[~due], None if now == timer else timer)
        expired = held[due & (held["closed"] == 0) & (held["login_at"] != _NONE)]
        if not expired.empty:
            yield _rows(expired, "expired", expired["expires_at"])

    def close(self) -> None:
        pass


def closed_sessions(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The sessions of a stream of ``EVENTS`` as they close."""
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS))
    keyed = events.withWatermark("at", delay).withColumn("bucket", bucket).groupBy("bucket")
    return keyed.transformWithStateInPandas(
        statefulProcessor=SessionLife(), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime"
    )


def landed(sessions: DataFrame, until: Column, folder: str, delay: str = "1 hour") -> None:
    """Logins and logouts up to ``until`` as files of events, and one event that moves the watermark to ``until``.

    ``sessions`` are (session_id, user_id, login_at, expires_at, ended_at).
    """
    login = F.struct(F.lit("login").alias("kind"), F.col("login_at").alias("at"), "expires_at")
    logout = F.struct(F.lit("logout").alias("kind"), F.col("ended_at").alias("at"), "expires_at")
    both = F.filter(F.array(login, logout), lambda e: e["at"].isNotNull() & (e["at"] <= until))
    rows = sessions.select(
        F.col("session_id").cast("long").alias("session_id"), F.col("user_id").cast("long").alias("user_id"), F.explode(both).alias("e")
    )
    rows = rows.select("session_id", "user_id", "e.kind", "e.at", "e.expires_at")
    later = until + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")
    tick = sessions.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("session_id"), F.lit(None).cast("long").alias("user_id"), F.lit("tick").alias("kind"),
        later.alias("at"), F.lit(None).cast("timestamp").alias("expires_at"),
    )
    rows.unionByName(tick).write.mode("append").parquet(folder)


def run(spark: SparkSession, events: str, checkpoint: str, out: str, delay: str = "1 hour") -> DataFrame:
    """Reads what has landed as a stream, closes sessions, and returns the rows written so far."""
    stream = spark.readStream.schema(EVENTS).parquet(events)
    closed = closed_sessions(stream, delay)
    writer = closed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)  # a query keeps the store it is started with
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE[0], before)
    query.awaitTermination()
    return spark.read.schema(CLOSED).parquet(out)
