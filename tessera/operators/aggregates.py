"""Rollups, percentiles, histograms and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles of each group, with count, mean, least and largest.

    Values are counted before they are ranked, so a group costs its different values and no list of all its
    rows is built: the running count of each value tells which ranks it covers.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("c"))
    per = Window.partitionBy(*group)
    upto = F.sum("c").over(per.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    runs = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(per))
    out = [F.max("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most")]
    for name, share in shares.items():
        at = F.least(F.floor(F.col("n") * share), F.col("n") - 1)
        out.append(F.min(F.when(F.col("upto") > at, F.col(value))).alias(name))
    return runs.groupBy(*group).agg(*out)


def top_and_other(df: DataFrame, group: str, most: int, other: str = "(other)") -> DataFrame:
    """The ``most - 1`` largest groups and all others as one: ``group, n``."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.col("n").desc(), F.col(group).asc_nulls_last()).limit(most - 1).select(F.col(group).alias("_g"), F.lit(True).alias("_top"))
    named = counts.join(F.broadcast(top), F.col(group).eqNullSafe(F.col("_g")), "left")  # at most ``most - 1`` rows
    return named.select(F.when(F.col("_top"), F.col(group)).otherwise(other).alias(group), "n").groupBy(group).agg(F.sum("n").cast("long").alias("n"))


def histogram_map(df: DataFrame, group: str, kind: str) -> DataFrame:
    """A map of kind to count for each group."""
    counts = df.groupBy(group, kind).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(kind), F.col("n"))))).alias("counts"))


def ranking_metrics(run: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """``query_id`` with precision, recall, reciprocal rank and nDCG at ``k``, with binary and with graded gains.

    ``run(query_id, id, rank)`` and ``qrels(query_id, id, rel)``; every query of ``qrels`` with a relevant document counts.
    """
    good = qrels.where("rel > 0")
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rel").desc(), "id"))
    gain = lambda r: 1 / F.log2(r + F.lit(1.0))
    ideal = good.withColumn("r", ideal_rank).groupBy("query_id").agg(
        F.count("*").alias("n_good"),
        F.sum(F.when(F.col("r") <= k, gain(F.col("r")))).alias("idcg"),
        F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("rel")) - 1) * gain(F.col("r")))).alias("idcg_graded"),
    )
    hit = run.where(F.col("rank") <= k).join(good, ["query_id", "id"])
    got = hit.groupBy("query_id").agg(
        F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(gain(F.col("rank"))).alias("dcg"),
        F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) * gain(F.col("rank"))).alias("dcg_graded"),
    )
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "query_id", "left").select(
        "query_id", F.round(z(F.col("hits") / k), 6).alias("precision"), F.round(z(F.col("hits") / F.col("n_good")), 6).alias("recall"),
        F.round(z(1 / F.col("first")), 6).alias("mrr"), F.round(z(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.round(z(F.col("dcg_graded") / F.col("idcg_graded")), 6).alias("ndcg_graded"),
    )


def hit_rates(run: DataFrame, expected: DataFrame, at: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """Share of queries whose expected document is among the first, and the mean reciprocal rank, by category."""
    found = expected.join(run, ["query_id", "id"], "left").groupBy("query_id", "category").agg(F.min("rank").alias("first"))
    rates = [F.round(F.avg((F.coalesce(F.col("first"), F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"hit_{k}") for k in at]
    return found.groupBy("category").agg(F.count("*").alias("n"), *rates, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


def confusion(df: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: counts, precision, recall, F1 and accuracy; a ratio of nothing is 0."""
    c = df.agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"), F.count_if(~truth & ~said).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return c.select("tp", "fp", "fn", "tn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 6).alias("f1"), F.round(ratio(tp + tn, tp + fp + fn + tn), 6).alias("accuracy"))


def cumulative(df: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(value).over(w))
