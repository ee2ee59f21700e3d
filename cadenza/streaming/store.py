"""Keyed state that expires: counters and values with lifetimes over event time.

State lives in the RocksDB state store (see ``PROVIDER``). Every stored row registers a timer for its end; when the watermark
has passed it, the row is dropped, so the store holds what is alive and not every key ever seen. Streams need a watermark on
``ts``. Rows of one key are taken in order of (ts, seq) within a micro-batch; rows behind the watermark are dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _by_key(df: DataFrame):
    """Rows with their time in milliseconds, by key."""
    for name, value in PROVIDER.items():
        if df.sparkSession.conf.get(name) != value:
            raise ValueError(f"keyed state with timers needs {name}={value}")
    return df.withColumn("at_ms", F.unix_millis("ts")).groupBy("key")


def with_provider(spark: SparkSession) -> SparkSession:
    """The session, set to the state store that timers need; streams that run already keep their own."""
    for name, value in PROVIDER.items():
        spark.conf.set(name, value)
    return spark


class _Expiring(StatefulProcessor):
    """One row of state a key, (value, end in ms), that a timer drops at its end."""

    kind = "value string, end_ms long"

    def init(self, handle) -> None:
        self._handle = handle
        self._state = handle.getValueState("alive", self.kind)

    def _alive(self, now: int) -> tuple | None:
        found = tuple(self._state.get()) if self._state.exists() else None
        return found if found and now < found[1] else None

    def _keep(self, value, end: int) -> None:
        self._state.update((value, end))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [x for x in rows if len(x)]
        if not parts:  # only timers have ended
            return
        found = pd.concat(parts).sort_values(["at_ms", "seq"])
        yield self.answered(key, found, found["at_ms"].tolist())
        if self._state.exists():
            self._handle.registerTimer(int(self._state.get()[1]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self._state.exists() and self._state.get()[1] <= expiredTimerInfo.getExpiryTimeInMs():
            self._state.clear()  # a row that was written anew has a later timer of its own
        return iter(())

    def close(self) -> None:
        pass


class _Limit(_Expiring):
    kind = "value long, end_ms long"

    def __init__(self, most: int, ttl_s: int):
        self._most, self._ttl = most, ttl_s * 1000

    def answered(self, key, rows: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        allowed = []
        for now in at:
            n, end = self._alive(now) or (0, now + self._ttl)
            self._keep(n + 1, end)
            allowed.append(n < self._most)
        return pd.DataFrame({"key": [key[0]] * len(rows), "seq": rows["seq"].tolist(), "allowed": allowed})


class _Lockout(_Limit):
    def answered(self, key, rows: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        outcomes = []
        for now, success in zip(at, rows["success"]):
            alive = self._alive(now)
            if alive and alive[0] >= self._most:
                outcomes.append("locked")
            elif success:
                self._state.clear()
                outcomes.append("ok")
            else:
                n, end = alive or (0, now + self._ttl)
                self._keep(n + 1, end)
                outcomes.append("failed")
        return pd.DataFrame({"key": [key[0]] * len(rows), "seq": rows["seq"].tolist(), "outcome": outcomes})


class _Values(_Expiring):
    def answered(self, key, rows: pd.DataFrame, at: list[int]) -> pd.DataFrame:
        found = []
        for now, op, value, ttl in zip(at, rows["op"], rows["value"], rows["ttl_s"]):
            alive, out = self._alive(now), None
            if op == "set":
                self._keep(value, now + int(ttl) * 1000)
            elif op == "del":
                self._state.clear()
            elif op == "incr":
                out = str(int(alive[0]) + 1) if alive else "1"
                self._keep(out, alive[1] if alive else now + int(ttl) * 1000)
            elif alive:
                out = alive[0]
            found.append(out)
        return pd.DataFrame({"key": [key[0]] * len(rows), "seq": rows["seq"].tolist(), "found": found})


def rate_limit(hits: DataFrame, most: int, ttl_s: int) -> DataFrame:
    """(key, seq, allowed) of each hit (key, seq, ts): append mode.

    The counter starts with the first hit after the one before has ended; later hits do not prolong it.
    """
    return _by_key(hits).transformWithStateInPandas(_Limit(most, ttl_s), "key long, seq long, allowed boolean", "append", "eventTime")


def lockouts(attempts: DataFrame, most: int, ttl_s: int) -> DataFrame:
    """(key, seq, outcome) of each sign-in attempt (key, seq, ts, success): append mode.

    A key with ``most`` failures is locked until its counter ends, a lifetime after the first of them; success clears it.
    """
    return _by_key(attempts).transformWithStateInPandas(_Lockout(most, ttl_s), "key long, seq long, outcome string", "append", "eventTime")


def keyed_values(calls: DataFrame) -> DataFrame:
    """(key, seq, found) of each call (key, seq, ts, op, value, ttl_s): append mode; the rules are those of the batch fold.

    Calls are ``set``, ``get``, ``del`` and ``incr``; ``get`` and ``incr`` find the value.
    """
    return _by_key(calls).transformWithStateInPandas(_Values(), "key long, seq long, found string", "append", "eventTime")
