"""Leases and consolidations: outcomes by hand, streams against tables, late rows and restarts."""

import pytest
from pyspark.sql import functions as F
from tessera.operators import runs
from tessera.streaming import runs as streamed
from tessera.streaming.operators import parquet_sink

OPS = "key long, id long, at long, op string, run long, cursor long"
S = 1_000_000


def test_outcomes_of_leases(spark):
    ops = [
        (1, 1, 0, "begin", None, None), (1, 2, 5 * S, "beat", 1, 70), (1, 3, 6 * S, "begin", None, None), (1, 4, 14 * S, "complete", 1, None),
        (1, 5, 15 * S, "begin", None, None), (1, 6, 20 * S, "beat", 5, 80), (1, 7, 31 * S, "beat", 5, 90), (1, 8, 32 * S, "begin", None, None), (1, 9, 33 * S, "complete", 5, None),
        (2, 10, 0, "beat", 3, 1), (None, 11, 0, "begin", None, None),
    ]
    got = {(r.key, r.id, r.outcome): (r.at, r.cursor) for r in runs.lease_outcomes(spark.createDataFrame(ops, OPS), 10, 60 * S).collect()}
    assert got == {
        (1, 1, "acquired"): (0, None), (1, 2, "renewed"): (5 * S, 70), (1, 3, "busy"): (6 * S, 70), (1, 4, "completed"): (14 * S, None), (1, 5, "acquired"): (15 * S, None),
        (1, 6, "renewed"): (20 * S, 80), (1, 5, "expired"): (30 * S, 80), (1, 7, "lost"): (31 * S, 80), (1, 8, "acquired"): (32 * S, 80), (1, 9, "lost"): (33 * S, 80), (1, 8, "expired"): (42 * S, 80),
        (2, 10, "lost"): (0, None),
    }


def test_consolidations_put_events_off(spark):
    events = spark.createDataFrame([(1, i, t * S) for i, t in enumerate([0, 1, 2, 3, 4, 50, 51, 52, 200, 201])] + [(2, 99, 0)], "key long, id long, at long")
    got = [tuple(r) for r in runs.consolidations(events, 3, 40, 4).orderBy("at").collect()]
    assert got == [(1, 2 * S, 3, [0, 1, 2]), (1, 50 * S, 3, [2, 3, 4, 5]), (1, 200 * S, 3, [5, 6, 7, 8])]
    assert runs.consolidations(events.limit(0), 3, 40, 4).collect() == []


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, streamed.PROVIDER)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drain(frame, tmp_path):
    query = parquet_sink(frame, f"{tmp_path}/out", f"{tmp_path}/ck")
    query.awaitTermination(240)
    assert query.exception() is None


def source(spark, tmp_path, schema, rows):
    """Rows as one more file of a stream."""
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(f"{schema}, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_a_stream_of_leases_is_the_table(spark, tmp_path, rocks):
    early = [(k, 10 * k + n, (k + 30 * n) * S, op, run, 5 * n) for k in (1, 2) for n, (op, run) in enumerate([("begin", None), ("beat", 10 * k), ("begin", None), ("beat", 10 * k), ("complete", 10 * k + 2)])]
    late = [(1, 500, 20 * S, "beat", 10, 777)]  # out of order, within the watermark's bound
    last = [(9, 900, 5000 * S, "begin", None, None)]
    frame = source(spark, tmp_path, OPS, early)
    drain(streamed.lease_outcomes(frame, 25, "10 minutes"), tmp_path)
    source(spark, tmp_path, OPS, late)
    drain(streamed.lease_outcomes(frame, 25, "10 minutes"), tmp_path)  # a restart from the checkpoint
    source(spark, tmp_path, OPS, last)
    drain(streamed.lease_outcomes(frame, 25, "10 minutes"), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.key != 9)
    want = sorted(tuple(r) for r in runs.lease_outcomes(spark.createDataFrame([*early, *late], OPS), 25, 4000 * S).collect())
    assert got == want and {r[3] for r in want} >= {"acquired", "renewed", "expired", "lost"}


def test_a_stream_of_consolidations_is_the_table(spark, tmp_path, rocks):
    schema = "key long, id long, at long"
    rows = [(k, 100 * k + i, (100 + 7 * i * k + i) * S) for k in (1, 2, 3) for i in range(12)]
    frame = source(spark, tmp_path, schema, rows[::2])
    drain(streamed.consolidations(frame, 3, 30, 4, "10 minutes"), tmp_path)
    source(spark, tmp_path, schema, rows[1::2])
    drain(streamed.consolidations(frame, 3, 30, 4, "10 minutes"), tmp_path)
    source(spark, tmp_path, schema, [(9, 900, 9000 * S)])
    drain(streamed.consolidations(frame, 3, 30, 4, "10 minutes"), tmp_path)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = sorted(tuple(r) for r in runs.consolidations(spark.createDataFrame(rows, schema), 3, 30, 4).collect())
    assert got == want and len(want) > 4
