"""As-of joins over many pieces of one key, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from tessera.operators import joins


@pytest.fixture
def pieces(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_hot_key_is_spread(spark, pieces):
    rng = random.Random(3)
    left = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(500), i) for i in range(400)]
    right = [(k, at, 1000 * at + n) for n, (k, at) in enumerate([(1, 100), (1, 100), (1, 420), (2, 250), (None, 10), (7, 3)])]
    frame = spark.createDataFrame(left, "k long, at long, id long")
    got = {r.id: r.anchor for r in joins.as_of(frame, spark.createDataFrame(right, "k long, at long, v long"), "k", "at", "v").collect()}
    want = {}
    for k, at, i in left:
        mine = [(t, v) for x, t, v in right if x == k]
        before, after = [m for m in mine if m[0] <= at], [m for m in mine if m[0] > at]
        want[i] = max(before)[1] if before else min(after)[1] if after else None
    assert got == want
    rows = spark.createDataFrame([(1, i, None if i % 50 else i) for i in range(500)], "k long, at long, v long")
    out = joins.carried(rows, "k", ["at"], "v")
    assert {(r["at"], r["_before"]) for r in out.collect()} == {(i, i - i % 50) for i in range(500)}
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_no_rows(spark):
    empty = spark.createDataFrame([], "k long, at long, v long")
    assert joins.as_of(spark.createDataFrame([(1, 2)], "k long, at long"), empty, "k", "at", "v").collect()[0].anchor is None
    assert joins.as_of(empty.select("k", "at"), empty, "k", "at", "v").collect() == []


def test_no_frame_reaches_to_the_end_of_a_piece(spark):
    """Such a frame is gone through anew for each row: the square of a piece."""
    rows = spark.createDataFrame([(1, i, None if i % 9 else i) for i in range(100)], "k long, at long, v long")
    out = joins.carried(rows, "k", ["at"], "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "unboundedpreceding" in plan and "unboundedfollowing" not in plan
    assert {(r["at"], r["_before"], r["_after"]) for r in out.collect()} == {(i, i - i % 9, -(-i // 9) * 9 if i else 0) for i in range(100)}
