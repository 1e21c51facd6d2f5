"""Mixing sources to target weights by weighted fair queueing.

Each document gets a virtual finish time: the words of its source up to and with it,
in shuffled order, over the source's target.  Every source then runs through its
target by time one, so the global order by that time is a well-mixed stream, which
is cut at the total budget.  A source that is larger in target than in words runs
through its documents a second time.

All sums over an order are taken in two levels: within buckets of the shuffle
hash (or of the virtual time), and over the buckets' totals, so that a source with a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, scope, stored, text_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Rows that one bucket of a source holds on average at most.
BUCKET_ROWS = 1_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, source_size`` -> the same with ``weight`` and ``target``.

    Shares the budget by weight; a target stops at ``repeats`` times its source's
    size and what is above goes to the others by weight.  In closed form: in the order
    of size over weight, the capped sources are those before the first whose share of
    what the earlier ones leave lies below its own cap.  ``sources`` has one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * repeats
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    here_on = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(here_on)
    return (
        sources.withColumn("weight", cycle).withColumn("cap", cap)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", level)
        .withColumn("nth", F.row_number().over(order))
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct("nth", "level"))).over(everything)["level"])
        .select(
            "source", "source_size", "weight",
            F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))).alias("target"),
        )
    )


def finish_times(docs: DataFrame, **shares) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, k, size, source, h, source_size, target, first``.

    ``first`` is the virtual finish time of the first run through the source; the
    second run's is later by ``source_size / target``.
    """
    light = stored(
        docs.select("doc_id", text_key().alias("k"), "source", word_count(F.col("text")).alias("size"))
        .withColumn("h", F.xxhash64("doc_id", "k", F.lit("mix"))),
        "mix",
    )
    per_source = light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    goal = stored(
        targets(per_source.select("source", "source_size"), **shares).join(
            per_source.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))
        ).drop("s"),
        "mix-targets",
    )
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    rows = light.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the top 31 bits of the hash, in order, fall into equal ranges
    rows = rows.withColumn("bucket", F.floor((F.shiftright("h", 33) + F.lit(1 << 30)) * buckets / F.lit(float(1 << 31))))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        rows.withColumn("run", F.sum("size").over(within))
        .join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
        .select(
            "doc_id", "k", "size", "source", "h", "source_size", "target",
            F.when(F.col("target") > 0, (F.col("ahead") + F.col("run")) / F.col("target")).alias("first"),
        )
    )


#: Ranges of virtual time in a coarse one.
COARSE = 1_024


def _first_over(totals: DataFrame, by: str, ahead: float, budget: float) -> tuple[int, float] | None:
    """The first value of ``by`` with which the running sum of ``words``, from ``ahead`` on, is over ``budget``, and the sum before it."""
    upto = Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.withColumn("ahead", F.coalesce(F.sum("words").over(upto), F.lit(0)) + ahead)
    row = summed.where(F.col("ahead") + F.col("words") > F.lit(budget)).orderBy(by).select(by, "ahead").first()
    return None if row is None else (row[0], row[1])


def mix(docs: DataFrame, **shares) -> DataFrame:
    """:func:`finish_times` with ``taken``: words that the mix takes of each document.

    The stream is cut at the first entry that would bring it over the budget.  Where
    that is, is found by the totals of coarse ranges of virtual time, of the ranges in one of them, and by the order
    within the one range in which the budget ends.

    Null sources are one source; null and empty texts have size 0 and are never
    taken; repeated rows are taken each on its own; an empty table gives no rows; texts of any length count whole.
    Only the four columns of documents are read, so that others may have any name.
    """
    with scope(docs.sparkSession) as keep:
        timed = keep(stored(finish_times(docs, **shares), "mix-timed"))
        goals = timed.groupBy("source").agg(F.first("target").alias("t"), F.count("*").alias("n")).agg(F.sum("t"), F.sum("n")).first()
    budget, n = float(goals[0] or 0), goals[1] or 0
    runs = [
        timed.where(F.col("size") > 0).select(
            (F.col("first") + i * F.col("source_size") / F.col("target")).alias("at"), "h", "doc_id", F.lit(i).alias("pass"), "size"
        )
        for i in range(REPEATS)
    ]
    stream = runs[0]
    for r in runs[1:]:
        stream = stream.unionByName(r)
    ranges = max(64, -(-n // BUCKET_ROWS))
    stream = stream.withColumn("range", F.least(F.floor(F.col("at") * ranges), F.lit(REPEATS * ranges * 4)).cast("long"))
    coarse = F.floor(F.col("range") / COARSE)
    over = _first_over(stream.groupBy(coarse.alias("range")).agg(F.sum("size").alias("words")), "range", 0, budget)
    if over is None:  # no words at all
        return timed.withColumn("taken", F.when(F.col("target") > 0, F.col("size") * REPEATS).otherwise(0).cast("long"))
    cut, ahead = _first_over(stream.where(coarse == over[0]).groupBy("range").agg(F.sum("size").alias("words")), "range", over[1], budget)
    inside = stream.where(F.col("range") == cut).withColumn("entry", F.struct("at", "h", F.coalesce("doc_id", F.lit(-1 << 63)), "pass"))
    last = (
        inside.withColumn("run", F.sum("size").over(Window.orderBy("entry").rowsBetween(Window.unboundedPreceding, 0)) + ahead)
        .where(F.col("run") > F.lit(budget)).agg(F.min("entry").alias("e")).select("e.*").first()
    )
    stop = F.struct(*[F.lit(v).cast(t) for v, t in zip(last, ("double", "long", "long", "int"), strict=True)])
    taken = F.lit(0)
    for i in range(REPEATS):
        entry = F.struct(F.col("first") + i * F.col("source_size") / F.col("target"), F.col("h"), F.coalesce("doc_id", F.lit(-1 << 63)), F.lit(i))
        taken = taken + F.when((F.col("size") > 0) & (entry < stop), 1).otherwise(0)
    return timed.withColumn("taken", (taken * F.col("size")).cast("long"))


def mixed(docs: DataFrame, **shares) -> DataFrame:
    """The mix itself: the rows of ``docs`` that are taken, as often as they are taken,
    range-sorted by virtual finish time.  Columns of any name pass through."""
    id_, key, own, first, again, times, nth, at = fresh(docs, "_id", "_key", "_own", "_first", "_again", "_times", "_nth", "_at")
    picked = mix(docs, **shares).where(F.col("taken") > 0).select(
        F.col("doc_id").alias(id_), F.col("k").alias(key), F.col("first").alias(first), (F.col("source_size") / F.col("target")).alias(again),
        (F.col("taken") / F.col("size")).cast("int").alias(times),
    ).dropDuplicates([id_, key])
    out = docs.withColumn(own, text_key()).join(picked, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)))
    out = out.withColumn(nth, F.explode(F.sequence(F.lit(0), F.col(times) - 1))).withColumn(at, F.col(first) + F.col(nth) * F.col(again))
    return out.repartitionByRange(at).sortWithinPartitions(at).drop(id_, key, own, first, again, times, nth, at)


def op5_mix(docs: DataFrame) -> DataFrame:
    """:func:`mix`, range-sorted by virtual finish time; nulls, repeats, long texts and empty tables as there."""
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", F.col("first").alias("finish_time"))
    return out.repartitionByRange("finish_time", "doc_id").sortWithinPartitions("finish_time", "doc_id")
