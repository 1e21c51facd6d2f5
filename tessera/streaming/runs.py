"""Leases and throttled consolidations over streams, by arbitrary state with timers.

They need the RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` set to :data:`PROVIDER`.  Operations are taken in order of
time as far as the watermark allows: what arrives is held in the key's list state until the watermark has passed it, so that late rows are placed rightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.runs import OUTCOMES, WINDOWS, Lease, Throttle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Ordered(StatefulProcessor):
    """Holds rows ``id, at, op, run, cursor`` of a key until the watermark has passed them, then hands them on in order."""

    _FIELDS = "id long, at long, op string, run long, cursor long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self._FIELDS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for b in rows:
            whole = [[None if pd.isna(v) else int(v) for v in b[c]] for c in ("id", "us", "run", "cursor")]
            ops = [None if pd.isna(v) else v for v in b["op"]]
            new += list(zip(whole[0], whole[1], ops, whole[2], whole[3], strict=True))
        if new:
            self.held.appendList([tuple(r) for r in new])
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs() + 1, min(r[1] for r in new) // 1000 + 1))
        yield pd.DataFrame(columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.held.get(), key=lambda r: (r[1], r[0])) if self.held.exists() else []
        ready = [r for r in held if r[1] // 1000 < mark]
        later = held[len(ready):]
        self.held.clear()
        if later:
            self.held.put([tuple(r) for r in later])
        out, then = self.walked(int(key[0]), ready, mark)
        wake = [r[1] // 1000 + 1 for r in later[:1]] + ([then] if then else [])
        if wake:
            self.handle.registerTimer(max(mark + 1, min(wake)))
        yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


class Leases(_Ordered):
    columns = ["key", "id", "at", "outcome", "cursor"]

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("lease", "holder long, until long, cursor long")

    def walked(self, key: int, rows: list, mark: int) -> tuple[list, int | None]:
        lease = Lease(*self.state.get()) if self.state.exists() else Lease()
        out = []

        def ended(at: int) -> None:
            gone = lease.expired(at)
            if gone:
                out.append((key, gone[0], gone[1], "expired", lease.cursor))

        for i, at, op, run, cursor in rows:
            ended(at)
            outcome, seen = lease.step(i, at, op, run, cursor, self.ttl)
            out.append((key, i, at, outcome, seen))
        if lease.holder is not None and lease.until // 1000 < mark:
            ended(lease.until)
        self.state.update((lease.holder, lease.until, lease.cursor))
        return out, lease.until // 1000 + 1 if lease.holder is not None else None


class Consolidations(_Ordered):
    columns = ["key", "at", "events", "window"]

    def __init__(self, least_new: int, interval: int, size: int):
        self.bounds = (least_new, interval, size)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("throttle", "new long, last long, window array<long>")

    def walked(self, key: int, rows: list, mark: int) -> tuple[list, int | None]:
        state = Throttle()
        if self.state.exists():
            new, last, window = self.state.get()
            state = Throttle(new, last, list(window))
        out = []
        for i, at, *_ in rows:
            new = state.new + 1
            due = state.step(i, at, *self.bounds)
            if due is not None:
                out.append((key, at, new, due))
        self.state.update((state.new, state.last, state.window))
        return out, None


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """Rows with a watermark on ``ts``, and their time in microseconds."""
    have = set(rows.columns)
    blank = {"op": "string", "run": "long", "cursor": "long"}
    more = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in blank.items()]
    timed = rows.where("key is not null and id is not null and ts is not null").select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), "ts", F.unix_micros("ts").alias("us"), *more)
    return timed.withWatermark("ts", late)


def lease_outcomes(ops: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """The stream form of :func:`tessera.operators.runs.lease_outcomes` over ``key, id, ts, op, run, cursor``; timers end leases once the watermark has passed them."""
    return _timed(ops, late).groupBy("key").transformWithStateInPandas(Leases(ttl_seconds * 1_000_000), outputStructType=OUTCOMES, outputMode="append", timeMode="EventTime")


def consolidations(events: DataFrame, least_new: int, interval_seconds: int, size: int, late: str = "10 minutes") -> DataFrame:
    """The stream form of :func:`tessera.operators.runs.consolidations` over ``key, id, ts``."""
    return _timed(events, late).groupBy("key").transformWithStateInPandas(Consolidations(least_new, interval_seconds * 1_000_000, size), outputStructType=WINDOWS, outputMode="append", timeMode="EventTime")
