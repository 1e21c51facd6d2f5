"""Structured Streaming forms of the event operators.

Event time has to be a TIMESTAMP: cast TIMESTAMP_NTZ columns first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """A bounded-rate stream of Parquet files, with ``ts`` as TIMESTAMP; ``path`` is a folder, or one file in a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def ttl_dedup(events: DataFrame, key: str, ttl_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """``key, event_id``: as the batch operator, within and across micro-batches; a key's state ends ``ttl_seconds`` after what it kept last."""

    def walk(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        keep = []
        for at in (rows["ts"].astype("int64") // (1 if str(rows["ts"].dtype).startswith("datetime64[us") else 1000)).tolist():
            ok = last is None or at - last >= ttl_seconds * 1_000_000
            last = at if ok else last
            keep.append(ok)
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: rows.loc[keep, key].astype(str), "event_id": rows.loc[keep, "event_id"]})

    return (
        events.withWatermark("ts", late).groupBy(key)
        .applyInPandasWithState(walk, f"{key} string, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    )


def rollup(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type, once each window is closed by the watermark."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def co_occurrence(events: DataFrame, seconds: int = 600, late: str = "10 minutes") -> DataFrame:
    """Pairs of a user's events within ``seconds`` of each other, joined by key and time so that state is bounded."""
    a = events.withWatermark("ts", late).select("user_id", "event_id", "ts")
    b = events.withWatermark("ts", late).select(F.col("user_id").alias("user2"), F.col("event_id").alias("peer"), F.col("ts").alias("ts2"))
    return a.join(b, F.expr(f"user_id = user2 and ts2 >= ts - interval {seconds} seconds and ts2 <= ts and peer <> event_id")).select("user_id", "event_id", "peer")


def throttled(job: Callable[[DataFrame, int], None], least_new: int) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that runs ``job`` on batches with enough rows, and passes over smaller ones."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.limit(least_new).count() >= least_new:
            job(batch, number)

    return run


def parquet_sink(events: DataFrame, folder: str, checkpoint: str):
    """Append the stream to Parquet, exactly once."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def working_memory(puts: DataFrame, size: int = 20, ttl_seconds: int = 900) -> DataFrame:
    """``session, id, score, place`` of each session's buffer after a micro-batch with puts for it (update mode).

    Reads ``session, id, at, score`` with ``at`` in seconds.  What is older than the TTL at the session's last put goes, and beyond
    ``size`` entries the lowest scores; a session's state ends when it has had no puts for the TTL.
    """

    def walk(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {i: (at, score) for i, at, score in zip(*state.get, strict=True)} if state.exists else {}
        for b in batches:
            for r in b.itertuples():
                if r.id not in held or (r.at, r.score) >= held[r.id]:
                    held[r.id] = (r.at, r.score)
        last = max(at for at, _ in held.values())
        alive = sorted(((i, at, s) for i, (at, s) in held.items() if at > last - ttl_seconds), key=lambda x: (-x[2], x[0]))[:size]
        state.update(tuple(list(c) for c in zip(*alive, strict=True)))
        state.setTimeoutDuration(ttl_seconds * 1000)
        yield pd.DataFrame({"session": k[0], "id": [x[0] for x in alive], "score": [x[2] for x in alive], "place": range(1, len(alive) + 1)})

    return puts.groupBy("session").applyInPandasWithState(
        walk, "session long, id long, score double, place long", "ids array<long>, ats array<long>, scores array<double>", "update", GroupStateTimeout.ProcessingTimeTimeout
    )
