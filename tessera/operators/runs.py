"""Runs under a lease and throttled consolidations: small state machines a key, the same for a table and for a stream.

A table is read in order of its keys and times with one state in memory, so no key is gathered; a stream keeps the
state in the state store, with an event-time timer for what time alone brings about.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Lease:
    """The run of a key that holds the lease, until when, and the cursor that the last run left; times are in microseconds.

    ``begin`` takes the lease unless a live run holds it, and gives the cursor to go on from.  ``beat`` renews it and moves the cursor, and ``complete`` ends the run; both fence off a
    run that is no longer the holder.  A run whose lease ends is expired, and its cursor stays for the next.
    """

    holder: int | None = None
    until: int = 0
    cursor: int | None = None

    def expired(self, at: int) -> tuple[int, int] | None:
        """The run, and the time, whose lease has ended by ``at``."""
        if self.holder is None or self.until > at:
            return None
        out, self.holder = (self.holder, self.until), None
        return out

    def step(self, id_: int, at: int, op: str, run: int | None, cursor: int | None, ttl: int) -> tuple[str, int | None]:
        """The outcome of one operation, after :meth:`expired`, and the cursor that it sees."""
        if op == "begin":
            if self.holder is not None:
                return "busy", self.cursor
            self.holder, self.until = id_, at + ttl
            return "acquired", self.cursor
        if self.holder is None or self.holder != run:
            return "lost", self.cursor
        if op == "beat":
            self.until, self.cursor = at + ttl, cursor if cursor is not None else self.cursor
            return "renewed", self.cursor
        self.holder = self.cursor = None
        return "completed", None


OUTCOMES = "key long, id long, at long, outcome string, cursor long"


def lease_outcomes(ops: DataFrame, ttl_seconds: int, now: int | None = None) -> DataFrame:
    """``key, id, at, outcome, cursor`` of each operation ``key, id, at, op, run, cursor`` and of each lease that ends by ``now``.

    ``at`` is in microseconds and orders the operations of a key, ties by ``id``.  Rows with a null key, id or time are left out.
    """
    ttl = ttl_seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lease = None, Lease()

        def ended(at: int | None) -> list[tuple]:
            gone = lease.expired(at) if at is not None else None
            return [(key, gone[0], gone[1], "expired", lease.cursor)] if gone else []

        for b in batches:
            out = []
            for k, i, at, op, run, cursor in b.astype(object).where(b.notna(), None).itertuples(index=False):
                if k != key:
                    out += ended(now)
                    key, lease = k, Lease()
                out += ended(at)
                outcome, seen = lease.step(i, at, op, run, cursor, ttl)
                out.append((k, i, at, outcome, seen))
            yield _frame(out)
        if key is not None:
            yield _frame(ended(now))

    rows = ops.select(*[F.col(c).cast("long").alias(c) for c in ("key", "id", "at")], "op", F.col("run").cast("long").alias("run"), F.col("cursor").cast("long").alias("cursor")).where("key is not null and id is not null and at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(walk, OUTCOMES)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "id", "at", "outcome", "cursor"])
    return out.astype({"key": "int64", "id": "int64", "at": "int64", "outcome": "object", "cursor": "Int64"})


@dataclass
class Throttle:
    """New events of a key since its last consolidation, when that was, and the last events."""

    new: int = 0
    last: int | None = None
    window: list[int] = field(default_factory=list)

    def step(self, id_: int, at: int, least_new: int, interval: int, size: int) -> list[int] | None:
        """The window to consolidate if this event makes one due; events below the bounds are kept for later."""
        self.new += 1
        self.window = [*self.window, id_][-size:]
        if self.new < least_new or (self.last is not None and at - self.last < interval):
            return None
        self.new, self.last = 0, at
        return list(self.window)


WINDOWS = "key long, at long, events long, window array<long>"


def consolidations(events: DataFrame, least_new: int, interval_seconds: int, size: int) -> DataFrame:
    """``key, at, events, window``: when a key's events ``key, id, at`` make a consolidation due, how many are new, and the last ``size`` of them.

    Due is a key with ``least_new`` events since the last one and ``interval_seconds`` since then; what comes before is put off, not lost.
    """
    interval = interval_seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, Throttle()
        for b in batches:
            out = []
            for k, i, at in b.itertuples(index=False):
                if k != key:
                    key, state = k, Throttle()
                new = state.new + 1
                due = state.step(int(i), int(at), least_new, interval, size)
                if due is not None:
                    out.append((int(k), int(at), new, due))
            yield pd.DataFrame(out, columns=["key", "at", "events", "window"])

    rows = events.select(*[F.col(c).cast("long").alias(c) for c in ("key", "id", "at")]).where("key is not null and id is not null and at is not null")
    return rows.repartition("key").sortWithinPartitions("key", "at", "id").mapInPandas(walk, WINDOWS)
