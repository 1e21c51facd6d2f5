"""Queries on working records, paths and calls, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import filters, joins, ranking
from tessera.plans.ranking import FUSED_SQL, HITS_SQL, fused_hits, hits, lexical_hits, vector_hits
from tessera.plans.events import TTL_SQL
from tessera.plans.registry import Tables, query
from tessera.session import scratch_path
from tessera.streaming import operators as stream


@query(
    """WITH d AS (SELECT CASE WHEN source = 'src1' THEN 'src2' ELSE source END AS project_id, n_chars FROM documents) SELECT project_id, n_chars, count(*) AS n FROM d GROUP BY ALL HAVING count(*) > 1"""
)
def rename_conflicts(t: Tables) -> DataFrame:
    alias = t.spark.createDataFrame([("src1", "src2")], "retired string, target string")
    return joins.rename_conflicts(t.documents.select(F.col("source").alias("project_id"), "n_chars"), alias, "n_chars")


@query(
    "SELECT doc_id AS id FROM documents WHERE (n_chars % 100) / 100 > 0.3 AND (n_chars % 100) / 100 < 0.5 AND doc_id % 60 >= 14 AND length(text) >= 200 ORDER BY doc_id % 60 DESC, id LIMIT 50"
)
def compression_candidates(t: Tables) -> DataFrame:
    m = t.documents.select(F.col("doc_id").alias("id"), ((F.col("n_chars") % 100) / 100).alias("importance"), F.col("text").alias("content"))
    return filters.compression_candidates(m, F.col("id") % 60).select("id")


@query(
    "SELECT o_custkey AS task, o_orderkey AS id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"
)
def latest_per_task(t: Tables) -> DataFrame:
    return joins.latest(t.orders, "o_custkey", [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("id"))


@query("SELECT o_orderpriority AS kind, count(*) AS n, min(o_orderdate) AS oldest, CAST(sum(length(o_orderpriority)) AS BIGINT) AS bytes FROM orders GROUP BY 1")
def checkpoint_stats(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"), F.sum(F.octet_length("o_orderpriority")).cast("long").alias("bytes"))


@query("SELECT user_id % 10 AS operation, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def operation_success(t: Tables) -> DataFrame:
    return t.events.groupBy((F.col("user_id") % 10).alias("operation")).agg(F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.avg("value"), 6).alias("mean"))


_CALLS = ("bus.emit", "bus . on", "axios.get", "fetch", "map.get", "trpc.user.query", "store?.once", "gql", "http.post", "run", "axios.create", "a.b::off")


@query(
    f"""WITH c AS (SELECT page_id, page_id % {len(_CALLS)} AS k, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN '/api/x' WHEN 2 THEN '/apix' WHEN 3 THEN chr(39) || '/api' || chr(39) END AS literal FROM pages)
    SELECT page_id, CASE WHEN k = 0 THEN 'emit' WHEN k IN (1, 6, 11) THEN 'listen' WHEN k IN (2, 3, 5, 7, 8) THEN 'http_call' WHEN literal LIKE 'http%://%' OR literal IN ('/api/x', chr(39) || '/api' || chr(39)) THEN 'http_call' ELSE 'call' END AS kind FROM c"""
)
def call_sites(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _CALLS)), (F.col("page_id") % len(_CALLS) + 1).cast("int"))
    k = F.col("page_id") % 5
    literal = F.when(k == 0, F.col("url")).when(k == 1, "/api/x").when(k == 2, "/apix").when(k == 3, "'/api'")
    return t.pages.select("page_id", text.call_kind(name, literal).alias("kind"))


_FILES = ("a.test.ts", "x.md", "README", "a.ts", "db/migrations/1.txt", "x.bin")


@query(
    f"""SELECT page_id, CASE page_id % {len(_FILES)} WHEN 0 THEN 'code-test' WHEN 1 THEN 'documentation' WHEN 2 THEN 'documentation' WHEN 3 THEN 'code' WHEN 4 THEN 'documentation' END AS type FROM pages"""
)
def path_types(t: Tables) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _FILES)), (F.col("page_id") % len(_FILES) + 1).cast("int"))
    return t.pages.select("page_id", ranking.type_of_path(F.concat(F.lit("site"), F.col("page_id").cast("string"), F.lit("/"), name)).alias("type"))


@query(
    FUSED_SQL
    + """, r AS (SELECT fused.id, fused.score, rrf, fused.vector_score, keyword_score, vs.rank0 + 1 AS vr, ls.rank0 + 1 AS kr, row_number() OVER (ORDER BY rrf DESC, fused.id) AS cr FROM fused LEFT JOIN vs ON vs.id = fused.id LEFT JOIN ls ON ls.id = fused.id)
    SELECT id, vr AS vector_rank, kr AS keyword_rank, cr AS combined_rank, array_to_string(list_filter([CASE WHEN vr IS NOT NULL THEN printf('Vector: %.1f%% (rank #%d)', 100 * vector_score + 1e-9, vr) END, CASE WHEN kr IS NOT NULL THEN printf('Keyword: %.1f%% (rank #%d)', 100 * keyword_score + 1e-9, kr) END], lambda x: x IS NOT NULL), ' + ')
      || printf(' → RRF: %.4f → Final: %.1f%%', rrf + 1e-12, 100 * score + 1e-9) AS breakdown FROM r"""
)
def score_explanation(t: Tables) -> DataFrame:
    rank = lambda df, name: ranking.stream(df, "x").select("query_id", "id", (F.col("rank0") + 1).cast("long").alias(name))
    rows = fused_hits(t).join(rank(vector_hits(t), "vector_rank"), ["query_id", "id"], "left").join(rank(lexical_hits(t), "keyword_rank"), ["query_id", "id"], "left")
    rows = rows.withColumn("combined_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")).cast("long"))
    return ranking.explained(rows).select("id", "vector_rank", "keyword_rank", "combined_rank", "explanation.breakdown")


@query(
    HITS_SQL
.replace("WITH vs", "WITH RECURSIVE vs", 1)
    + """, w AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS pos, list_distinct(regexp_split_to_array(lower(coalesce(content, '')), '[\t\n\x0b\f\r ]+')) AS k FROM hits), p AS (SELECT * FROM w WHERE pos <= 50),
    j AS MATERIALIZED (SELECT a.pos AS a, b.pos AS b FROM p a JOIN p b ON b.pos < a.pos WHERE len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) > 0.5),
    s AS (SELECT 1::BIGINT AS pos, [1::BIGINT] AS kept UNION ALL SELECT s.pos + 1, CASE WHEN EXISTS (SELECT 1 FROM j WHERE j.a = s.pos + 1 AND list_contains(s.kept, j.b)) THEN s.kept ELSE list_append(s.kept, s.pos + 1) END FROM s WHERE s.pos < (SELECT max(pos) FROM p))
    SELECT id FROM p WHERE list_contains((SELECT arg_max(kept, pos) FROM s), pos)"""
)
def diversify(t: Tables) -> DataFrame:
    return ranking.diversified(hits(t), 0.5).select("id")


@query(HITS_SQL + " SELECT id, round(least(1, score * (1 + 0.2 * (id % 10) / 10)), 6) AS score FROM hits")
def centrality_boost(t: Tables) -> DataFrame:
    return ranking.with_centrality(hits(t), (F.col("id") % 10) / 10).select("id", F.round("score", 6).alias("score"))


@query("SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, kind) AS place FROM (SELECT source AS project, lang AS kind, count(*) AS n FROM documents GROUP BY ALL)")
def project_map(t: Tables) -> DataFrame:
    c = t.documents.groupBy(F.col("source").alias("project"), F.col("lang").alias("kind")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("project").orderBy(F.col("n").desc(), "kind")).cast("long"))


def _drained(t: Tables, make) -> DataFrame:
    """A stream over ``events``, run to its end into the shared folder and read back."""
    schema = t.events.schema
    folder = scratch_path(t.spark, "stream")
    out = make(stream.event_stream(t.spark, f"{t.folder}/events.parquet", schema))
    run = stream.parquet_sink(out, f"{folder}/out", f"{folder}/checkpoint")
    run.awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL) SELECT * FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def streaming_rollup(t: Tables) -> DataFrame:
    out = _drained(t, lambda ev: stream.rollup(ev, "1 day"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(TTL_SQL)
def streaming_ttl_dedup(t: Tables) -> DataFrame:
    return _drained(t, lambda ev: stream.ttl_dedup(ev.withColumn("user_id", F.col("user_id").cast("string")), "user_id", 3600, "40 days"))


@query(
    "SELECT a.user_id, a.event_id, b.event_id AS peer FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts <= a.ts AND b.ts >= a.ts - INTERVAL 600 SECOND AND a.event_id <> b.event_id"
)
def streaming_co_occurrence(t: Tables) -> DataFrame:
    return _drained(t, lambda ev: stream.co_occurrence(ev, 600, "40 days"))
