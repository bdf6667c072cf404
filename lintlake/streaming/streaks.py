"""Failure streaks of a call log as keyed state.

A provider's state is one row: the failures in a row so far and the time of the last one. Calls are taken in their order in
time within a micro batch, and micro batches in theirs, as a log is written. After ``threshold`` failures in a row the
provider's circuit is open; with ``expire`` a call that comes ``open_seconds`` or more after the failure that
opened it starts from no failures. A timer at that time drops the state of a provider that is not called again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming import StreamingQuery

from lintlake.streaming.changes import _start

PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"
#: The store that keyed state with timers needs: on the disk of an executor, and as change files in the checkpoint folder.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "provider string, call_id long, created_at timestamp, streak long, circuit_open boolean, open_until timestamp"


def follow(rows: pd.DataFrame, failures: int, last: pd.Timestamp | None, threshold: int, wait: pd.Timedelta, expire: bool) -> pd.DataFrame:
    """The streak at each call of ``rows`` (``created_at``, ``call_id``, ``success``) in order, given what was before."""
    rows = rows.sort_values(["created_at", "call_id"], kind="stable")
    streaks = []
    for at, success in zip(rows["created_at"], rows["success"]):
        if expire and failures >= threshold and at - last >= wait:
            failures = 0
        failures = 0 if success else failures + 1
        last = last if success else at
        streaks.append(failures)
    rows = rows.assign(streak=streaks)
    rows["circuit_open"] = rows["streak"] >= threshold
    rows["open_until"] = (rows["created_at"] + wait).where(rows["circuit_open"])
    return rows


class StreakProcessor(StatefulProcessor):
    """One row of state a provider; see the module."""

    def __init__(self, threshold: int, open_seconds: int, expire: bool):
        self.threshold, self.wait, self.expire = threshold, pd.Timedelta(seconds=open_seconds), expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("streak", "failures long, last_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, last = 0, None
        if self.state.exists():
            failures, last_us = self.state.get()
            last = pd.Timestamp(last_us, unit="us")
        out = follow(pd.concat(list(rows)), failures, last, self.threshold, self.wait, self.expire)
        failures = int(out["streak"].iloc[-1])
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if failures:
            last = out["created_at"].iloc[-1]
            self.state.update((failures, last.value // 1000))
            if self.expire and failures >= self.threshold:
                self.handle.registerTimer((last + self.wait).value // 1_000_000)
        else:
            self.state.clear()
        yield out.assign(provider=key[0])[["provider", "call_id", "created_at", "streak", "circuit_open", "open_until"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def streak_stream(calls: DataFrame, threshold: int = 3, open_seconds: int = 60, expire: bool = True, lateness: str = "0 seconds") -> DataFrame:
    """``calls(provider, call_id, created_at, success)`` as a stream, each with its streak and until when that opens the circuit."""
    timed = calls.select("provider", "call_id", calls["created_at"].cast("timestamp").alias("created_at"), "success")
    return timed.withWatermark("created_at", lateness).groupBy("provider").transformWithStateInPandas(
        StreakProcessor(threshold, open_seconds, expire), OUT, "Append", "EventTime")


def follow_streaks(calls: DataFrame, folder: str, **options) -> StreamingQuery:
    """Run :func:`streak_stream` over what is there now, into parquet at ``folder/out``; a later run goes on where this one ended."""
    spark = calls.sparkSession
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, STATE_STORE)
    try:
        out = streak_stream(calls, **options)
        return _start(out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out"), f"{folder}/state")
    finally:
        if before is None:
            spark.conf.unset(PROVIDER_KEY)
        else:
            spark.conf.set(PROVIDER_KEY, before)
