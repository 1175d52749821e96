"""Stateful processors of the streaming jobs. A processor holds one key's state between triggers, in RocksDB, with an expiry time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Processors need the RocksDB state store; set for the session, unless it has another one by its own choice."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def processed(df: DataFrame, key: str, processor: StatefulProcessor, schema, timed: bool, frames: bool = True) -> DataFrame:
    """timed: whether state expires or timers run. frames: whether the processor takes pandas frames, or rows, which cost less where keys have few of them."""
    use_state_store(df.sparkSession)
    by = df.groupBy(key)
    return (by.transformWithStateInPandas if frames else by.transformWithState)(processor, schema, "append", "ProcessingTime" if timed else "None")


@contextmanager
def no_empty_batches(spark: SparkSession):
    """For starting a query over all there is: with timers it would run empty batches for ever. Its session's settings are its own from the start on."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def in_order(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """A trigger's rows of one key, in order. How many these may be is for the source to bound (`maxFilesPerTrigger`, `maxBytesPerTrigger`)."""
    return pd.concat(list(frames)).sort_values(order, kind="stable", ignore_index=True)


class RunningBest(StatefulProcessor):
    """A run's best score, and its validations since that was saved.

    patience: once so many validations have passed the run is stopped, and later rows are no longer judged. ttl_ms: state that has not been written for so long is
    gone, and the run begins anew. idle_ms: a run from which nothing has come for so long is closed by a row of its own, and its state removed.
    """

    def __init__(self, key: str, patience: int | None, ttl_ms: int | None, idle_ms: int | None) -> None:
        self.key, self.patience, self.ttl_ms, self.idle_ms = key, patience, ttl_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "best DOUBLE, waited INT, stopped BOOLEAN", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best, waited, stopped = self.best.get() if self.best.exists() else (None, 0, False)
        rows = in_order(rows, ["ts", "event_id"])
        out = []
        for event, metric, kind in zip(rows["event_id"], rows["value"], rows["event_type"]):
            saved = False
            if not stopped:
                saved = bool(kind != "error" and metric is not None and metric == metric and (best is None or metric > best))
                best, waited = (float(metric), 0) if saved else (best, waited + 1)
                stopped = self.patience is not None and waited >= self.patience
            out.append((key[0], event, metric, saved, waited, stopped, False))
        self.best.update((best, waited, stopped))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        best, waited, _ = self.best.get() if self.best.exists() else (None, 0, False)
        self.best.clear()
        yield self._frame([(key[0], None, best, False, waited, True, True)])

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["run", "event_id", "metric", "saved", "waited", "stopped", "closed"])
        return frame.astype({"run": "Int64", "event_id": "Int64"})

    def close(self) -> None:
        pass


class Quarantine(StatefulProcessor):
    """A key's latest time; rows before it are late. Only the latest time is kept, for ttl_ms."""

    def __init__(self, kind: str, order: str, value: str, ttl_ms: int | None) -> None:
        self.kind, self.order, self.value, self.ttl_ms = kind, order, value, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", f"latest {self.kind}", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = in_order(rows, [self.order])
        times = rows[self.value]
        known = pd.Series([self.latest.get()[0] if self.latest.exists() else None], dtype=times.dtype)
        seen = pd.concat([known, times], ignore_index=True).cummax().ffill()
        late = times < seen.iloc[:-1].reset_index(drop=True)
        last = seen.iloc[-1]
        if not pd.isna(last):
            self.latest.update((last.to_pydatetime() if isinstance(last, pd.Timestamp) else last.item() if hasattr(last, "item") else last,))
        yield rows.assign(outcome__=late.map({True: "late", False: "good"}).to_numpy())

    def close(self) -> None:
        pass


class PublishOnce(StatefulProcessor):
    """The hash of a key's published content, kept for ttl_ms; rows are folded one by one, and of a trigger's contents one row for each hash is held."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.hash = handle.getValueState("hash", "hash STRING", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {}
        for row in rows:
            held.setdefault(row["hash__"], row)
        state = self.hash.get()
        known = state[0] if state else None
        for at, content in enumerate(sorted(held)):
            outcome = "same" if content == known else "conflict"
            if known is None and at == 0:
                outcome = "new"
                self.hash.update((content,))
            yield Row(**held[content].asDict(), outcome__=outcome)

    def close(self) -> None:
        pass
