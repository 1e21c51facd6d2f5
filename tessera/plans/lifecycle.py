"""Queries on what lives and changes: generations of an index, memories, logs, proposals and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import events, joins, symbols
from tessera.plans.registry import Tables, query

#: Lines stand for rows of files (parts) in generations (line numbers) of projects.
_ROWS = "g AS (SELECT l_suppkey % 5 AS project_id, l_linenumber AS generation_id, l_partkey AS path, l_quantity AS v FROM lineitem), a AS (SELECT project_id, max(generation_id) AS m FROM g GROUP BY project_id)"


def generation_rows(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_suppkey") % 5).alias("project_id"), F.col("l_linenumber").alias("generation_id"), F.col("l_partkey").alias("path"), F.col("l_quantity").alias("v"))


def active(rows: DataFrame) -> DataFrame:
    return rows.groupBy("project_id").agg(F.max("generation_id").alias("generation_id"))


@query(
    f"""WITH {_ROWS}, c AS (SELECT DISTINCT project_id, path FROM g WHERE v >= 45), n AS (SELECT g.project_id, m + 1 AS generation_id, path, v FROM g JOIN a ON g.project_id = a.project_id AND generation_id = m
      WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.project_id = g.project_id AND c.path = g.path) UNION ALL SELECT c.project_id, m + 1, path, 0 FROM c JOIN a USING (project_id))
    SELECT project_id, CAST(generation_id AS BIGINT) AS generation_id, path, count(*) AS n, sum(v) AS v FROM n GROUP BY ALL"""
)
def generation_copy_forward(t: Tables) -> DataFrame:
    """The next generation: unchanged files are copied from the active one, changed ones are written anew."""
    g = generation_rows(t)
    changed = g.where("v >= 45").select("project_id", "path").distinct()
    same = g.select("project_id", "path").distinct().join(changed, ["project_id", "path"], "left_anti")
    new = active(g).select("project_id", (F.col("generation_id") + 1).alias("generation_id"))
    copied = joins.copied_forward(g, active(g), new, same)
    fresh = changed.join(new, "project_id").select("project_id", "generation_id", "path", F.lit(0.0).alias("v"))
    return joins.written(copied, fresh).groupBy("project_id", F.col("generation_id").cast("long").alias("generation_id"), "path").agg(F.count("*").alias("n"), F.sum("v").alias("v"))


@query(
    f"""WITH {_ROWS}, f AS (SELECT DISTINCT project_id, generation_id, path FROM g), b AS (SELECT DISTINCT project_id, path FROM g WHERE v = 50)
    SELECT f.project_id, f.generation_id, f.path, b.path IS NOT NULL AS is_stale, CASE WHEN b.path IS NOT NULL THEN m - 1 ELSE f.generation_id END AS last_good FROM f JOIN a USING (project_id) LEFT JOIN b ON b.project_id = f.project_id AND b.path = f.path"""
)
def generation_stale_files(t: Tables) -> DataFrame:
    g = generation_rows(t)
    files = g.select("project_id", "generation_id", "path").distinct()
    good = active(g).select("project_id", (F.col("generation_id") - 1).alias("generation_id"))
    return joins.marked_stale(files, g.where("v = 50"), good).select("project_id", "generation_id", "path", "is_stale", "last_good")


_POINTERS = "p AS (SELECT c_nationkey AS project_id, min(c_custkey) AS generation_id FROM customer GROUP BY 1), n AS (SELECT c_nationkey AS project_id, c_custkey AS generation_id, CASE WHEN c_acctbal > 0 THEN 'complete' ELSE 'pending' END AS status, c_custkey % 40 AS expected FROM customer)"


@query(f"WITH {_POINTERS} SELECT p.project_id, coalesce(max(n.generation_id), p.generation_id) AS generation_id FROM p LEFT JOIN n ON n.project_id = p.project_id AND status = 'complete' AND expected = p.generation_id GROUP BY p.project_id, p.generation_id")
def generation_activation(t: Tables) -> DataFrame:
    c = t.customer
    pointers = c.groupBy(F.col("c_nationkey").alias("project_id")).agg(F.min("c_custkey").alias("generation_id"))
    made = c.select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("generation_id"), F.when(F.col("c_acctbal") > 0, "complete").otherwise("pending").alias("status"), (F.col("c_custkey") % 40).alias("expected"))
    return joins.activated(pointers, made)


@query(
    """WITH g AS (SELECT DISTINCT l_suppkey % 5 AS project_id, CAST(l_linenumber AS BIGINT) AS generation_id FROM lineitem), r AS (SELECT project_id, generation_id FROM g UNION SELECT o_custkey % 6, o_orderkey % 9 FROM orders)
    SELECT r.project_id, r.generation_id FROM r LEFT JOIN g ON g.project_id = r.project_id AND g.generation_id = r.generation_id WHERE g.project_id IS NULL"""
)
def consistency_orphans(t: Tables) -> DataFrame:
    known = t.lineitem.select((F.col("l_suppkey") % 5).alias("project_id"), F.col("l_linenumber").cast("long").alias("generation_id")).distinct()
    return joins.orphans([known, t.orders.select((F.col("o_custkey") % 6).alias("project_id"), (F.col("o_orderkey") % 9).alias("generation_id"))], known)


@query("SELECT event_id AS id, coalesce(CASE WHEN event_id % 2 = 0 THEN 'user' || user_id END, 'unknown') AS actor FROM events WHERE user_id % 10 = 3 ORDER BY ts DESC, event_id DESC LIMIT 100")
def operation_log(t: Tables) -> DataFrame:
    rows = t.events.select(
        F.col("event_id").alias("id"), F.col("ts").alias("at"), (F.col("user_id") % 10).alias("project_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("actor"), F.col("event_type").alias("op")
    )
    return joins.logged(joins.appended(rows.where("false"), rows), 3).select("id", "actor")


_DECISIONS = """d AS (SELECT l_orderkey AS id, ['approved', 'rejected', 'seen'][1 + l_linenumber % 3] AS status, l_shipdate AS w FROM lineitem),
    f AS (SELECT id, arg_min(status, row(w, status)) AS status, min(w) AS w FROM d WHERE status IN ('approved', 'rejected') GROUP BY id)"""


@query(f"WITH {_DECISIONS} SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN coalesce(f.status, 'pending') ELSE 'closed' END AS status, CASE WHEN o_orderstatus = 'O' THEN f.w END AS decided_at FROM orders LEFT JOIN f ON f.id = o_orderkey")
def proposal_decisions(t: Tables) -> DataFrame:
    status = F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit("seen")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    d = t.lineitem.select(F.col("l_orderkey").alias("id"), status.alias("status"), F.col("l_shipdate").alias("at"))
    return joins.decided(proposals(t), d).select("id", "status", "decided_at")


def proposals(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).alias("project_id"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("closed").alias("status"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("decided_at")
    )


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 20 = 4")
def pending_proposals(t: Tables) -> DataFrame:
    return joins.pending(proposals(t), 4).select("id")


@query(
    """WITH h AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS status, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS target, o_orderdate + INTERVAL 1000 DAY AS e FROM orders), a AS (SELECT l_orderkey AS id, l_suppkey % 3 AS agent FROM lineitem WHERE l_quantity > 40),
    b AS (SELECT h.id, min(agent) AS agent FROM h JOIN a ON a.id = h.id AND (target IS NULL OR target = agent) GROUP BY h.id)
    SELECT h.id, CASE WHEN status <> 'open' THEN status WHEN e <= TIMESTAMP '2001-01-01' THEN 'expired' WHEN agent IS NOT NULL THEN 'accepted' ELSE 'open' END AS status, CASE WHEN status = 'open' AND e > TIMESTAMP '2001-01-01' THEN agent END AS accepted_by FROM h LEFT JOIN b ON b.id = h.id"""
)
def handoff_states(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3).alias("target"),
        F.expr("o_orderdate + interval 1000 days").alias("expires_at"),
    )
    accepts = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 3).alias("agent"))
    return joins.handed_over(rows, accepts, F.lit("2001-01-01").cast("timestamp_ntz")).select("id", "status", "accepted_by")


@query(
    """WITH c AS (SELECT vec_id AS key, len(embedding) * 4 AS size FROM embeddings), q AS (SELECT event_id % 700 AS key FROM events)
    SELECT (SELECT count(*) FROM c) AS entries, CAST((SELECT sum(size) FROM c) AS BIGINT) AS bytes, round((SELECT count(*) FROM q WHERE key IN (SELECT key FROM c)) / (SELECT count(*) FROM q), 6) AS hit_rate, (SELECT avg(size) / 4 FROM c) AS avg_dimensions"""
)
def cache_statistics(t: Tables) -> DataFrame:
    cache = t.embeddings.select(F.col("vec_id").alias("key"), (F.size("embedding") * 4).cast("long").alias("size"))
    return joins.cache_stats(cache, t.events.select((F.col("event_id") % 700).alias("key")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN upper(c_name) ELSE c_name END AS content, CASE WHEN c_custkey % 6 = 0 THEN 1.0 ELSE c_acctbal END AS importance FROM customer WHERE c_custkey % 10 <> 7 AND c_nationkey <> 4")
def memory_changes(t: Tables) -> DataFrame:
    """Memories after patches, after deletions by id, and after one project's have gone."""
    m = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("content"), F.col("c_acctbal").alias("importance"), F.col("c_nationkey").alias("project_id"))
    patches = m.where("id % 3 = 0").select("id", F.upper("content").alias("content"), F.when(F.col("id") % 6 == 0, 1.0).alias("importance"))
    return symbols.hard_deleted(symbols.patched(m, patches), m.where("id % 10 = 7").select("id"), 4).select("id", "content", "importance")


@query("SELECT vec_id, CASE WHEN l.doc_id IS NULL THEN label ELSE 100 + l.quality END AS label FROM embeddings LEFT JOIN labels l ON l.doc_id = vec_id UNION ALL SELECT doc_id, 100 + quality FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def vector_upsert(t: Tables) -> DataFrame:
    changes = t.labels.select(F.col("doc_id").alias("vec_id"), (100 + F.col("quality")).alias("label"))
    return joins.upserted(t.embeddings.select("vec_id", "label"), changes, "vec_id")


@query("SELECT user_id FROM (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-25') AS n, epoch(TIMESTAMP '2024-01-31') - epoch(max(ts)) AS idle FROM events GROUP BY user_id) WHERE n >= 10 AND idle >= 21600")
def consolidation_due(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    state = t.events.groupBy("user_id").agg(F.count_if(ts >= F.lit("2024-01-25").cast("timestamp")).alias("new_events"), (F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_micros(F.max(ts)) / 1e6).alias("idle_seconds"))
    return events.consolidation_due(state, 10, 21_600).select("user_id")
