"""Streams against the batch operators over the same events."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import events as batch
from tessera.streaming import operators as stream


@pytest.fixture
def log(spark, sf, tmp_path):
    df = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts")
    folder = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(folder)
    return df, folder


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_ttl_dedup_stream(spark, log, tmp_path):
    df, folder = log
    out = stream.ttl_dedup(stream.event_stream(spark, folder, df.schema).withColumn("user_id", F.col("user_id").cast("string")), "user_id", 3600, "1 day")
    drain(stream.parquet_sink(out, f"{tmp_path}/out", f"{tmp_path}/ck"))
    got = {r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.event_id for r in batch.ttl_dedup(df, "user_id", 3600).collect()} and got


def test_rollup_stream(spark, log, tmp_path):
    df, folder = log
    drain(stream.parquet_sink(stream.rollup(stream.event_stream(spark, folder, df.schema), "1 day"), f"{tmp_path}/out", f"{tmp_path}/ck"))
    got = {(r.start, r.event_type): (r.n, round(r.total, 4)) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    whole = df.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    want = {(r.start, r.event_type): (r.n, round(r.total, 4)) for r in whole.collect()}
    assert got and all(want[k] == v for k, v in got.items())


def test_co_occurrence_stream(spark, log, tmp_path):
    df, folder = log
    out = stream.co_occurrence(stream.event_stream(spark, folder, df.schema), 7200, "30 days")
    drain(stream.parquet_sink(out, f"{tmp_path}/out", f"{tmp_path}/ck"))
    got = {(r.event_id, r.peer) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    e = df.select("user_id", "event_id", "ts").collect()
    want = {(a.event_id, b.event_id) for a in e for b in e if a.user_id == b.user_id and a.event_id != b.event_id and 0 <= (a.ts - b.ts).total_seconds() <= 7200}
    assert got == want


def test_throttled(spark):
    ran = []
    job = stream.throttled(lambda df, n: ran.append(n), 3)
    job(spark.range(2), 1)
    job(spark.range(3), 2)
    assert ran == [2]


def test_working_memory_stream(spark, log, tmp_path):
    df, folder = log
    puts = lambda ev: ev.select(F.col("user_id").alias("session"), (F.col("event_id") % 50).alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("value").alias("score"))
    out = stream.working_memory(puts(stream.event_stream(spark, folder, df.schema)), 3, 864_000)
    query = out.writeStream.format("memory").queryName("buffers").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    drain(query)
    got = {tuple(r) for r in spark.table("buffers").collect()}
    assert got == {tuple(r) for r in batch.working_memory(puts(df), 3, 864_000).collect()} and got
