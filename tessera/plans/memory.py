"""Memory queries: customers' orders and users' events stand in for memories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import memory, vector
from tessera.plans.registry import Tables, query

NOW = "2024-03-20 00:00:00"
_MEM = """m AS (SELECT user_id AS id, count(*) FILTER (WHERE event_type = 'purchase') % 5 AS access_count, min(ts) AS created_at,
      CASE WHEN user_id % 3 > 0 THEN max(ts) - INTERVAL 1 DAY * (user_id % 20) END AS last_accessed, (user_id % 10) / 10.0::DOUBLE AS importance, user_id % 17 = 0 AS pinned,
      CASE user_id % 5 WHEN 0 THEN 'decision' WHEN 1 THEN 'pattern' WHEN 2 THEN 'critical' WHEN 3 THEN 'code' ELSE 'conversation' END AS type, user_id % 4 AS level FROM events GROUP BY user_id)"""
_DAYS = f"greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(coalesce(last_accessed, created_at))) / 86400000000.0)"
_DECAY = f"CASE WHEN pinned THEN importance ELSE greatest(0, least(1, importance * exp(-0.02 * {_DAYS}) + 0.6 * ln(1 + access_count) * exp(-0.04 * {_DAYS}))) END"


def memories(t: Tables) -> DataFrame:
    u = F.col("user_id")
    by_user = t.events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id").agg(
        (F.count_if(F.col("event_type") == "purchase") % 5).alias("access_count"), F.min("ts").alias("created_at"), F.max("ts").alias("last")
    )
    kind = F.element_at(F.array(*[F.lit(x) for x in ("decision", "pattern", "critical", "code", "conversation")]), (u % 5 + 1).cast("int"))
    return by_user.select(
        u.alias("id"), "access_count", "created_at", F.when(u % 3 > 0, F.expr("last - make_interval(0, 0, 0, cast(user_id % 20 as int))")).alias("last_accessed"),
        ((u % 10) / 10.0).alias("importance"), (u % 17 == 0).alias("pinned"), kind.alias("type"), (u % 4).alias("level"),
    )


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


@query(f"WITH {_MEM} SELECT id, round(importance, 6) AS importance, round({_DECAY}, 6) AS decayed FROM m WHERE {_DAYS} > 7 AND NOT pinned AND abs({_DECAY} - importance) >= 1e-6")
def decay_sweep(t: Tables) -> DataFrame:
    return memory.decayed(memories(t), now())


@query(f"WITH {_MEM} SELECT id FROM m WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) > 45 * 86400000000 AND NOT pinned AND {_DECAY} < 0.2 AND access_count < 2")
def prune_cold(t: Tables) -> DataFrame:
    return memory.cold(memories(t), now()).select("id")


@query(
    """WITH m AS (SELECT o_custkey AS id, count(*) % 9 AS access_count, min(o_orderdate) AS created_at, (o_custkey % 10) / 10.0::DOUBLE AS importance, o_custkey % 3 + 1 AS level,
      ['decision', 'pattern', 'critical', 'code', 'conversation'][o_custkey // 7 % 5 + 1] AS type, o_custkey % 13 = 0 AS gone FROM orders GROUP BY o_custkey)
    SELECT id, CAST(2 AS BIGINT) AS level, round(least(1, importance + 0.08), 6) AS importance FROM m WHERE level = 3 AND type IN ('conversation', 'decision', 'pattern') AND created_at < TIMESTAMP '2000-06-01' AND importance >= 0.7 AND access_count >= 3 AND NOT gone
    ORDER BY created_at, id LIMIT 120"""
)
def promote_session(t: Tables) -> DataFrame:
    c = F.col("o_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("decision", "pattern", "critical", "code", "conversation")]), (F.floor(c / 7) % 5 + 1).cast("int"))
    m = t.orders.groupBy("o_custkey").agg((F.count("*") % 9).alias("access_count"), F.min(F.col("o_orderdate").cast("timestamp")).alias("created_at"))
    m = m.select(
        c.alias("id"), "access_count", "created_at", ((c % 10) / 10.0).alias("importance"), (c % 3 + 1).alias("level"), kind.alias("type"),
        F.when(c % 13 == 0, F.col("created_at")).alias("deleted_at"),
    )
    return memory.promoted(m, F.lit("2000-06-02").cast("timestamp"))


@query(
    f"""WITH {_MEM}, e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM e ORDER BY vec_id LIMIT 1),
    c AS (SELECT vec_id, list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) AS c FROM e, q)
    SELECT id, round(0.65 * coalesce(c, 0.5) + 0.2 * {_DECAY} + 0.1 * greatest(0.1, least(1, ln(1 + access_count) / ln(20)))
      + 0.05 * CASE type WHEN 'decision' THEN 1.0 WHEN 'pattern' THEN 0.9 WHEN 'critical' THEN 0.85 WHEN 'code' THEN 0.8 ELSE 0.7 END, 6) AS score FROM m LEFT JOIN c ON vec_id = id ORDER BY score DESC, id LIMIT 25"""
)
def memory_rank(t: Tables) -> DataFrame:
    q = t.embeddings.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    sims = t.embeddings.crossJoin(F.broadcast(q)).select(F.col("vec_id").alias("id"), V.cosine(F.col("embedding"), F.col("q")).alias("c"))
    return memory.ranked(memories(t).join(sims, "id", "left"), F.col("c"), now(), 25)


_PAIRS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b,
      round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)"""


@query()
def duplicate_keep_rule(t: Tables) -> DataFrame:
    pairs = vector.similar_pairs(t.embeddings, "label", 0.3).withColumn("block", F.col("label").cast("long"))
    m = t.embeddings.select(F.col("vec_id").alias("id"), ((F.col("vec_id") % 10) / 10).alias("importance"), (F.col("vec_id") % 7).alias("access_count"))
    return memory.keep_rule(pairs, m)


def _contains(signals: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(lower(text), '" + x.replace("'", "''") + "')" for x in signals) + ")"


@query(
    f"""WITH {_PAIRS}, x AS (SELECT a, b, round(score * 2, 6) AS score, ['code', 'decision', 'pattern'][1 + a % 3] AS old_type, ['code', 'decision', 'pattern'][1 + b % 3] AS new_type,
      coalesce(d.text, '') || CASE b % 7 WHEN 0 THEN ' use x instead of y' WHEN 1 THEN ' Fixed now' WHEN 2 THEN ' based on it' WHEN 3 THEN ' This CONFIRMS it' ELSE '' END AS text FROM p JOIN documents d ON doc_id = b WHERE score >= 0.2),
    r AS (SELECT *, CASE WHEN new_type = old_type AND score >= 0.92 AND b > a THEN 1 WHEN {_contains(memory.CONTRADICTS)} AND (score >= 0.5 OR a % 10 = b % 10) THEN 2 WHEN {_contains(memory.RESOLVES)} AND old_type IN ('decision', 'pattern') THEN 3
      WHEN {_contains(memory.DERIVES)} THEN 4 WHEN ((new_type = 'code' AND old_type = 'decision') OR (new_type = 'pattern' AND old_type = 'code')) AND score >= 0.7 THEN 5 WHEN {_contains(memory.SUPPORTS)} THEN 6
      WHEN new_type = old_type AND score >= 0.8 AND new_type IN ('pattern', 'decision') THEN 7 WHEN score >= 0.75 THEN 8 END AS k FROM x)
    SELECT a, b, ['SUPERSEDES', 'CONTRADICTS', 'RESOLVES', 'DERIVED_FROM', 'DERIVED_FROM', 'SUPPORTS', 'SUPPORTS', 'RELATES_TO'][k] AS relation,
      round(CASE k WHEN 1 THEN least(0.95, score) WHEN 2 THEN 0.7 + score * 0.2 WHEN 3 THEN 0.65 + score * 0.25 WHEN 4 THEN 0.6 + score * 0.3 WHEN 5 THEN 0.55 + score * 0.3 WHEN 6 THEN 0.6 + score * 0.3 WHEN 7 THEN 0.5 + score * 0.3 ELSE score * 0.8 END, 4) AS confidence
    FROM r WHERE k IS NOT NULL"""
)
def relation_rules(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, (" use x instead of y", " Fixed now", " based on it", " This CONFIRMS it", "", "", ""))), (F.col("doc_id") % 7 + 1).cast("int"))
    texts = t.documents.select(F.col("doc_id").alias("b"), memory.signals(F.concat(F.coalesce("text", F.lit("")), said)).alias("says"))
    pairs = vector.similar_pairs(t.embeddings, "label", 0.2).join(texts, "b")
    kind = lambda c: F.element_at(F.array(*map(F.lit, ("code", "decision", "pattern"))), (F.col(c) % 3 + 1).cast("int"))
    rows = pairs.select(
        "a", "b", F.round(F.col("score") * 2, 6).alias("similarity"), kind("a").alias("old_type"), kind("b").alias("new_type"), "says",
        (F.col("b") > F.col("a")).alias("newer"), (F.col("a") % 10 == F.col("b") % 10).alias("shared_tags"),
    )
    return memory.relation(rows).select("a", "b", "relation", F.round("confidence", 4).alias("confidence"))


def _window_sql(threshold: float, most: int) -> str:
    """A recursion that goes through each project's memories in order and takes those that fit all taken."""
    cosine = "list_dot_product(c, o.v) / (sqrt(list_dot_product(c, c)) * sqrt(list_dot_product(o.v, o.v)))"
    return f"""WITH RECURSIVE o AS (SELECT label AS project, vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings),
    w AS (SELECT project, n, [id] AS ids, [v] AS vs FROM o WHERE n = 1 UNION ALL
      SELECT o.project, o.n, CASE WHEN ok THEN list_append(ids, o.id) ELSE ids END, CASE WHEN ok THEN list_append(vs, o.v) ELSE vs END
      FROM (SELECT w.*, o.id, o.v, o.n AS m, len(ids) < {most} AND len(list_filter(vs, lambda c: {cosine} < {threshold})) = 0 AS ok FROM w JOIN o ON o.project = w.project AND o.n = w.n + 1) x JOIN o ON o.project = x.project AND o.n = x.m),
    l AS (SELECT project, arg_max(ids, n) AS ids FROM w GROUP BY project)
    SELECT CAST(project AS BIGINT) AS project, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM l WHERE len(ids) > 1"""


@query(_window_sql(0.25, 8))
def consolidation_window(t: Tables) -> DataFrame:
    m = t.embeddings.select(F.col("label").cast("long").alias("project"), F.col("vec_id").alias("id"), "embedding", F.timestamp_seconds("vec_id").alias("created_at"))
    return memory.consolidation_window(m, 0.25)


@query()
def kmeans_clusters(t: Tables) -> DataFrame:
    found = memory.clusters(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"))
    texts = t.documents.select(F.col("doc_id").alias("id"), "text")
    labels = memory.cluster_labels(found.join(texts, "id", "left")).select(F.col("cluster").alias("_c"), "label")
    return found.join(labels, F.col("cluster") == F.col("_c"), "left").select("id", "cluster", "label")


@query("SELECT doc_id AS id, CASE WHEN quality IS NULL THEN 0.5 ELSE CAST(quality AS DOUBLE) * 0.8 + 0.1 END AS salience FROM documents LEFT JOIN labels USING (doc_id)")
def salience_scores(t: Tables) -> DataFrame:
    judged = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality").cast("double") * 0.8 + 0.1).alias("salience"))
    return memory.salience(t.documents.select(F.col("doc_id").alias("id")), judged)


@query(
    """WITH e AS (SELECT l_suppkey AS f, l_partkey AS d, l_returnflag AS k, l_quantity / 50 AS w FROM lineitem), x AS (SELECT CASE WHEN f > 0 AND f % 10 = 0 THEN f - 1 ELSE f END AS from_id, CASE WHEN d > 0 AND d % 10 = 0 THEN d - 1 ELSE d END AS to_id, k AS edge_type, w FROM e)
    SELECT from_id, to_id, edge_type, max(w) AS weight FROM x WHERE from_id <> to_id GROUP BY ALL"""
)
def merge_duplicates(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_suppkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.col("l_returnflag").alias("edge_type"), (F.col("l_quantity") / 50).alias("weight"))
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("remove_id")).distinct().where("remove_id > 0 and remove_id % 10 = 0")
    return memory.merge_map(edges, ids.withColumn("keep_id", F.col("remove_id") - 1))


@query(
    """WITH m AS (SELECT CASE WHEN c_custkey > 0 AND c_custkey % 10 = 0 THEN c_custkey - 1 ELSE c_custkey END AS id, greatest(0, c_acctbal) / 10000 AS importance, c_nationkey AS uses, c_custkey AS own FROM customer)
    SELECT id, round(max(importance), 6) AS importance, CAST(sum(uses) AS BIGINT) AS access_count FROM m GROUP BY id HAVING bool_or(own = id)"""
)
def merged_memories(t: Tables) -> DataFrame:
    m = t.customer.select(F.col("c_custkey").alias("id"), (F.greatest(F.lit(0.0), F.col("c_acctbal")) / 10000).alias("importance"), F.col("c_nationkey").cast("long").alias("access_count"))
    merges = m.where("id > 0 and id % 10 = 0").select(F.col("id").alias("remove_id"), (F.col("id") - 1).alias("keep_id"))
    return memory.merged(m, merges).select("id", F.round("importance", 6).alias("importance"), "access_count")
