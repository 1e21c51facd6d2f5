"""Queries of project identities, leased runs and throttled consolidations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import identity, runs
from tessera.operators.identity import Store
from tessera.plans.registry import Tables, query
from tessera.session import scratch_path

STORES = {"files": Store("project_id", ("path",)), "documents": Store("project_id", ("doc_id",)), "customers": Store("owner", ("c_custkey",))}
_TABLES = """files AS (SELECT source AS project_id, n_chars % 97 AS path, max(lang) AS lang FROM documents GROUP BY ALL), docs AS (SELECT source AS project_id, doc_id, n_chars FROM documents),
    customers AS (SELECT 'src' || (c_custkey % 20) AS owner, c_custkey, c_acctbal FROM customer)"""


def project_tables(t: Tables) -> dict[str, DataFrame]:
    d = t.documents
    return {
        "files": d.groupBy(F.col("source").alias("project_id"), (F.col("n_chars") % 97).alias("path")).agg(F.max("lang").alias("lang")),
        "documents": d.select(F.col("source").alias("project_id"), "doc_id", "n_chars"),
        "customers": t.customer.select(F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string")).alias("owner"), "c_custkey", "c_acctbal"),
        "workspaces": d.select(F.col("source").alias("project_id"), F.lit("/work").alias("root")).distinct(),
        "aliases": t.spark.createDataFrame([], "retired string, target string"),
    }


@query(
    f"""WITH {_TABLES} SELECT 'files' AS store, count(*) FILTER (WHERE project_id = 'src3') AS rows, (SELECT count(*) FROM files a JOIN files b USING (path) WHERE a.project_id = 'src3' AND b.project_id = 'src4' AND a.lang IS DISTINCT FROM b.lang) AS conflicts FROM files
    UNION ALL SELECT 'documents', count(*) FILTER (WHERE project_id = 'src3'), 0 FROM docs UNION ALL SELECT 'customers', count(*) FILTER (WHERE owner = 'src3'), 0 FROM customers"""
)
def project_merge_plan(t: Tables) -> DataFrame:
    """What a merge of two projects would touch and where it would clash, over all tables."""
    return identity.counted(STORES, project_tables(t), "merge", "src3", "src4").drop("mark")


@query(
    f"""WITH {_TABLES}, r AS (SELECT 'files' AS store, project_id AS project FROM files UNION ALL SELECT 'documents', project_id FROM docs UNION ALL SELECT 'customers', owner FROM customers)
    SELECT store, CASE WHEN project = 'src3' THEN 'renamed' ELSE project END AS project, count(*) AS n FROM r GROUP BY ALL"""
)
def project_renamed(t: Tables) -> DataFrame:
    """All tables after a plan to rename has been carried out."""
    tables = identity.TableSet(t.spark, scratch_path(t.spark, "projects"))
    tables.write(project_tables(t))
    identity.applied(tables, STORES, identity.planned(STORES, tables.tables(), "rename", "src3", "renamed"))
    now, out = tables.tables(), None
    for name, store in STORES.items():
        part = now[name].groupBy(F.col(store.column).alias("project")).agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "project", "n")
        out = part if out is None else out.unionByName(part)
    return out


TTL = 12 * 3600


@query(
    f"""WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, CASE event_type WHEN 'purchase' THEN 'begin' WHEN 'view' THEN 'beat' WHEN 'click' THEN 'beat' ELSE 'complete' END AS op,
      last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    s AS (SELECT key, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS us, NULL::VARCHAR AS outcome, NULL::BIGINT AS seen, NULL::BIGINT AS holder, 0::BIGINT AS until, NULL::BIGINT AS cur, NULL::BIGINT AS gone, NULL::BIGINT AS gone_at FROM (SELECT DISTINCT key FROM o)
      UNION ALL SELECT key, n, id, us, outcome, CASE outcome WHEN 'renewed' THEN id WHEN 'completed' THEN NULL ELSE cur END, CASE WHEN outcome = 'acquired' THEN id WHEN outcome = 'completed' OR NOT live THEN NULL ELSE holder END,
        CASE WHEN outcome IN ('acquired', 'renewed') THEN us + {TTL}000000::BIGINT ELSE until END, CASE outcome WHEN 'renewed' THEN id WHEN 'completed' THEN NULL ELSE cur END, CASE WHEN holder IS NOT NULL AND NOT live THEN holder END, until
      FROM (SELECT *, CASE WHEN op = 'begin' THEN CASE WHEN live THEN 'busy' ELSE 'acquired' END WHEN NOT live OR run IS NULL OR holder <> run THEN 'lost' WHEN op = 'beat' THEN 'renewed' ELSE 'completed' END AS outcome
        FROM (SELECT o.*, s.holder, s.until, s.cur, s.holder IS NOT NULL AND s.until > o.us AS live FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1)))
    SELECT key, id, us AS "at", outcome, seen AS cursor FROM s WHERE n > 0 UNION ALL SELECT s.key, s.gone, s.gone_at, 'expired', p.cur FROM s JOIN s AS p ON p.key = s.key AND p.n = s.n - 1 WHERE s.gone IS NOT NULL"""
)
def managed_runs(t: Tables) -> DataFrame:
    """Purchases begin runs, views and clicks keep the last one alive, and other events complete it."""
    ev = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    kind = F.col("event_type")
    op = F.when(kind == "purchase", "begin").when(kind.isin("view", "click"), "beat").otherwise("complete")
    begun = F.last(F.when(kind == "purchase", F.col("event_id")), ignorenulls=True).over(Window.partitionBy("user_id").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    ops = ev.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "at", op.alias("op"), begun.alias("run"), F.when(kind.isin("view", "click"), F.col("event_id")).alias("cursor"))
    return runs.lease_outcomes(ops, TTL)


@query(
    """WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER w AS n, array_to_string(list(event_id) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), ',') AS win FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT key, 0::BIGINT AS n, 0::BIGINT AS new, NULL::BIGINT AS prev, NULL::BIGINT AS us, NULL::BIGINT AS fired, NULL::VARCHAR AS win FROM (SELECT DISTINCT key FROM o)
      UNION ALL SELECT key, n, CASE WHEN due THEN 0 ELSE new END, CASE WHEN due THEN us ELSE prev END, us, CASE WHEN due THEN new END, win
      FROM (SELECT o.key, o.n, o.us, o.win, s.prev, s.new + 1 AS new, s.new + 1 >= 5 AND (s.prev IS NULL OR o.us - s.prev >= 172800000000) AS due FROM s JOIN o ON o.key = s.key AND o.n = s.n + 1))
    SELECT key, us AS "at", fired AS events, win AS "window" FROM s WHERE fired IS NOT NULL"""
)
def throttled_consolidations(t: Tables) -> DataFrame:
    """A user's consolidations: five new events and two days at least, over the last four."""
    ev = t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = runs.consolidations(ev, 5, 172_800, 4)
    return out.select("key", "at", "events", F.array_join(F.col("window").cast("array<string>"), ",").alias("window"))
