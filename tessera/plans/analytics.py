"""Aggregation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.plans.registry import Tables, query


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN value >= 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate,
      round(coalesce(avg(value) FILTER (WHERE value < 50), 0), 6) AS low_mean, round(avg(value) FILTER (WHERE value >= 50) / greatest(avg(value) FILTER (WHERE value < 50), 1), 6) AS speedup, count(DISTINCT user_id) AS users
    FROM events GROUP BY event_type"""
)
def search_analytics(t: Tables) -> DataFrame:
    high = F.col("value") >= 50
    low_mean = F.avg(F.when(~high, F.col("value")))
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(high, 1.0).otherwise(0.0)), 6).alias("hit_rate"),
        F.round(F.coalesce(low_mean, F.lit(0.0)), 6).alias("low_mean"), F.round(F.avg(F.when(high, F.col("value"))) / F.greatest(low_mean, F.lit(1.0)), 6).alias("speedup"), F.countDistinct("user_id").alias("users"),
    )


@query("SELECT props, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY props ORDER BY n DESC, props LIMIT 10")
def top_queries(t: Tables) -> DataFrame:
    return t.events.groupBy("props").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).orderBy(F.col("n").desc(), "props").limit(10)


@query("SELECT DISTINCT source FROM documents")
def active_projects(t: Tables) -> DataFrame:
    return t.documents.select("source").distinct()


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40")
def recent_page(t: Tables) -> DataFrame:
    return t.events.select("event_id", "ts", "user_id", "event_type").orderBy(F.col("ts").desc(), "event_id").offset(40).limit(20)


@query(
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, max(value) FILTER (WHERE i = least(CAST(floor(n * 0.5) AS BIGINT), n - 1)) AS p50,
      max(value) FILTER (WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)) AS p95, max(value) FILTER (WHERE i = least(CAST(floor(n * 0.99) AS BIGINT), n - 1)) AS p99 FROM s GROUP BY event_type"""
)
def latency_percentiles(t: Tables) -> DataFrame:
    return A.percentiles(t.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).withColumn("mean", F.round("mean", 6))


@query(
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source) AS k FROM c)
    SELECT CASE WHEN k < 6 THEN source ELSE '(other)' END AS source, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1"""
)
def prefix_rollup_other(t: Tables) -> DataFrame:
    return A.top_and_other(t.documents, "source", 6)


@query("SELECT coalesce(nullif(regexp_extract(url, '\\.([a-z0-9]+)$', 1), ''), 'other') AS extension, count(*) AS n FROM pages GROUP BY 1")
def kind_histogram(t: Tables) -> DataFrame:
    ext = F.regexp_extract("url", r"\.([a-z0-9]+)$", 1)
    return t.pages.groupBy(F.when(ext == "", "other").otherwise(F.coalesce(ext, F.lit("other"))).alias("extension")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS dear, round(avg(o_totalprice) FILTER (WHERE o_orderpriority LIKE '1%'), 4) AS urgent_mean FROM orders GROUP BY o_orderstatus")
def filtered_agg(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("dear"), F.round(F.avg(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))), 4).alias("urgent_mean")
    )


@query("SELECT source, string_agg(lang || '=' || n, ',' ORDER BY lang) AS counts FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source")
def map_agg(t: Tables) -> DataFrame:
    m = A.histogram_map(t.documents, "source", "lang")
    pairs = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("source", F.array_join(pairs, ",").alias("counts"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS closed, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT max(n_chars) FROM documents) AS longest")
def graph_snapshot(t: Tables) -> DataFrame:
    parts = [
        t.documents.agg(F.count("*").alias("documents"), F.max("n_chars").alias("longest")), t.events.agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users")), t.orders.agg(F.count_if(F.col("o_orderstatus") == "F").alias("closed")),
    ]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # each has one row


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 1")
def having_distinct_one(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(F.count_distinct("l_suppkey").alias("n")).where("n = 1").select("l_orderkey")


@query("SELECT n, count(*) AS c FROM (SELECT node, count(*) AS n FROM (SELECT l_suppkey AS node FROM lineitem UNION ALL SELECT -l_partkey FROM lineitem) GROUP BY node) GROUP BY n")
def degree_distribution(t: Tables) -> DataFrame:
    ends = t.lineitem.select(F.col("l_suppkey").alias("node")).unionByName(t.lineitem.select((-F.col("l_partkey")).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))


@query("SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT l_suppkey AS node, 1 AS o, 0 AS i FROM lineitem UNION ALL SELECT l_partkey, 0, 1 FROM lineitem) GROUP BY node ORDER BY sum(o) + sum(i) DESC, node LIMIT 10")
def degree_hubs(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_suppkey").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    b = t.lineitem.select(F.col("l_partkey").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    d = a.unionByName(b).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return d.orderBy((F.col("out_degree") + F.col("in_degree")).desc(), "node").limit(10)


@query("SELECT l_suppkey AS package, count(DISTINCT l_partkey) AS fan_out, count(DISTINCT l_orderkey) AS fan_in FROM lineitem GROUP BY l_suppkey")
def fan_in_out(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_suppkey").alias("package")).agg(F.count_distinct("l_partkey").alias("fan_out"), F.count_distinct("l_orderkey").alias("fan_in"))


@query("SELECT p_brand, count(*) AS n, min(p_retailprice) AS cheapest, max(p_retailprice) AS dearest, round(avg(p_retailprice), 4) AS mean FROM part WHERE contains(lower(p_name), 'a') GROUP BY p_brand")
def price_table(t: Tables) -> DataFrame:
    return t.part.where(F.contains(F.lower("p_name"), F.lit("a"))).groupBy("p_brand").agg(
        F.count("*").alias("n"), F.min("p_retailprice").alias("cheapest"), F.max("p_retailprice").alias("dearest"), F.round(F.avg("p_retailprice"), 4).alias("mean")
    )


@query(
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
    SELECT user_id, event_type, n, k FROM r WHERE k <= 2"""
)
def warm_up_set(t: Tables) -> DataFrame:
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("n").desc(), "event_type"))
    return c.withColumn("k", nth.cast("long")).where("k <= 2")


@query(
    "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM events"
)
def savings_series(t: Tables) -> DataFrame:
    return A.cumulative(t.events, "user_id", ["ts", "event_id"], "value").select("event_id", "user_id", F.round("running", 6).alias("running"))


@query("SELECT event_type, round(median(value), 6) AS median, round(var_samp(value) / avg(value), 6) AS variance_ratio FROM events GROUP BY event_type")
def median_variance(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.var_samp("value") / F.avg("value"), 6).alias("variance_ratio"))


_RUN = """run AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents), rel AS (SELECT lang AS query_id, l.doc_id AS id, l.quality * 2 + l.toxic AS rel FROM labels l JOIN documents d ON d.doc_id = l.doc_id)"""


def _run(t: Tables) -> tuple[DataFrame, DataFrame]:
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n_chars").desc(), "doc_id"))
    run = t.documents.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), nth.alias("rank"))
    rel = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("rel"))
    return run, rel


@query(
    f"""WITH {_RUN}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS r FROM rel WHERE rel > 0),
    i AS (SELECT query_id, count(*) AS n, sum(1 / log2(r + 1.0)) FILTER (WHERE r <= 20) AS idcg, sum((pow(2.0, rel) - 1) / log2(r + 1.0)) FILTER (WHERE r <= 20) AS ig FROM g GROUP BY query_id),
    h AS (SELECT run.query_id, count(*) AS hits, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg, sum((pow(2.0, rel) - 1) / log2(rank + 1.0)) AS dg FROM run JOIN g ON run.query_id = g.query_id AND run.id = g.id WHERE rank <= 20 GROUP BY run.query_id)
    SELECT i.query_id, round(coalesce(hits / 20, 0), 6) AS precision, round(coalesce(hits / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(dg / ig, 0), 6) AS ndcg_graded FROM i LEFT JOIN h ON i.query_id = h.query_id"""
)
def ir_metrics(t: Tables) -> DataFrame:
    run, rel = _run(t)
    return A.ranking_metrics(run, rel, 20)


@query(
    f"""WITH {_RUN}, e AS (SELECT id AS query_id, id % 10 AS id2, rel AS category FROM rel), f AS (SELECT e.query_id, e.category, min(CASE WHEN r.rank <= 1000000 THEN r.rank END) AS first FROM e LEFT JOIN run r ON r.id = e.query_id GROUP BY ALL)
    SELECT category, count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_1, round(avg(CASE WHEN first <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_3, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_5,
      round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 6) AS hit_10, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM f GROUP BY category"""
)
def hit_rates(t: Tables) -> DataFrame:
    run, rel = _run(t)
    expected = rel.select(F.col("id").alias("query_id"), "id", F.col("rel").alias("category"))
    return A.hit_rates(run.select(F.col("id").alias("query_id"), "id", "rank"), expected)


@query(
    """WITH c AS (SELECT l.toxic = 1 AS y, contains(lower(d.text), 'idiot') OR contains(lower(d.text), 'scum') AS p FROM labels l JOIN documents d USING (doc_id)),
    n AS (SELECT count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn FROM c)
    SELECT tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
      round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1, round(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0 END, 6) AS accuracy FROM n"""
)
def confusion(t: Tables) -> DataFrame:
    rows = t.labels.join(t.documents.select("doc_id", "text"), "doc_id")
    low = F.lower("text")
    return A.confusion(rows, F.col("toxic") == 1, F.contains(low, F.lit("idiot")) | F.contains(low, F.lit("scum")))
