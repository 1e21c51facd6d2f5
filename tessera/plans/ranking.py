"""Rank fusion and reranking queries, over a vector and a keyword stream for one query each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import lexical, ranking, vector
from tessera.plans.lexical import COVERAGE_SQL
from tessera.plans.registry import Tables, query
from tessera.plans.vectors import _COS

NOW = "2024-02-01 00:00:00"
QUERIES = [
    "how does useState() work", "why did we choose this", "fix the broken build", "what is the RouterConfig", "plain words about nothing", "recent changes today", "the service handler", "snake_case_name",
    "best practice for naming", "por que decidimos isso", "ECONNREFUSED on start", "", "import of a module", "a very long query about the service handler and what it does with all of them",
]

VECTOR_SQL = f"""SELECT 0 AS query_id, vec_id AS id, score FROM (SELECT vec_id, {_COS.format(a='v', b='qv')} AS score
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1)) ORDER BY score DESC, id LIMIT 50"""
LEXICAL_SQL = f"SELECT 0 AS query_id, doc_id AS id, score FROM ({COVERAGE_SQL} LIMIT 50)"
FUSED_SQL = f"""WITH vs AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank0 FROM ({VECTOR_SQL})),
    ls AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank0 FROM ({LEXICAL_SQL})),
    f AS (SELECT 0 AS query_id, coalesce(vs.id, ls.id) AS id, coalesce(1.0::DOUBLE / (61 + vs.rank0), 0) + coalesce(2.5::DOUBLE / (61 + ls.rank0), 0) AS rrf, vs.score AS vector_score, ls.score AS keyword_score
      FROM vs FULL JOIN ls ON vs.id = ls.id),
    fused AS (SELECT query_id, id, round(rrf, 9) AS rrf, vector_score, keyword_score, round(0.7 * rrf / max(rrf) OVER () + 0.3 * coalesce(vector_score, 0), 6) AS score FROM f)"""
HITS_SQL = FUSED_SQL + f""",
    hits AS (SELECT fused.*, source AS file, text AS content, n_chars % 7 AS access_count, TIMESTAMP '{NOW}' - INTERVAL 1 MINUTE * (id * 37 % 20000) AS created_at FROM fused JOIN documents ON doc_id = id)"""


def vector_hits(t: Tables) -> DataFrame:
    asked = t.embeddings.orderBy("vec_id").limit(1).select(F.lit(0).cast("long").alias("query_id"), "embedding")
    return vector.knn(asked, t.embeddings, 50).select("query_id", F.col("vec_id").alias("id"), "score")


def lexical_hits(t: Tables) -> DataFrame:
    return lexical.term_coverage(t.documents, "erst tion ouble", 50).select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").alias("id"), "score")


def fused_hits(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(0, "erst() tion ouble")], "query_id long, query string")
    return ranking.fuse([ranking.stream(vector_hits(t), "vector"), ranking.stream(lexical_hits(t), "lexical")], asked)


def hits(t: Tables) -> DataFrame:
    """Fused hits with what the reranking operators read, from ``documents``."""
    docs = t.documents.select(
        F.col("doc_id").alias("id"), F.col("source").alias("file"), F.col("text").alias("content"), (F.col("n_chars") % 7).alias("access_count"),
        F.expr(f"TIMESTAMP '{NOW}' - make_interval(0, 0, 0, 0, 0, cast(doc_id * 37 % 20000 as int))").alias("created_at"),
    )
    return fused_hits(t).join(docs, "id")


def now() -> F.Column:
    return F.lit(NOW).cast("timestamp")


@query(FUSED_SQL + " SELECT * FROM fused")
def rrf_fusion(t: Tables) -> DataFrame:
    return fused_hits(t).select("query_id", "id", "rrf", "vector_score", "keyword_score", "score")


@query(f"SELECT id, round(sum(s), 6) AS score FROM (SELECT id, 0.7 * score AS s FROM ({VECTOR_SQL}) UNION ALL SELECT id, 0.3 * score FROM ({LEXICAL_SQL})) GROUP BY id")
def hybrid_weighted(t: Tables) -> DataFrame:
    return vector.weighted_hybrid([(vector_hits(t), 0.7), (lexical_hits(t), 0.3)])


@query(
    HITS_SQL
    + """, g AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS n FROM hits WHERE coalesce(vector_score, score) >= 0.1),
    r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank FROM g WHERE n <= 2) SELECT query_id, id, file, score, rank FROM r WHERE rank <= 20"""
)
def hybrid_search(t: Tables) -> DataFrame:
    """Two streams, fused, gated, at most two hits of a file, the best twenty."""
    return ranking.file_cap(ranking.gate(hits(t), 0.1), "file", 2, 20).select("query_id", "id", "file", "score", F.col("rank").cast("long").alias("rank"))


@query(
    HITS_SQL
    + f""", p AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM hits), m AS (SELECT max(access_count) FILTER (WHERE pos <= 50) AS most FROM p),
    s AS (SELECT id, pos, score, CASE WHEN pos <= 50 THEN round((0.4 * greatest(0, least(1, score)) + 0.15 * exp(-ln(2) * greatest(0, epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 86400000000.0 / 7)
      + CASE WHEN most > 0 THEN 0.15 * ln(access_count + 1) / ln(most + 1) ELSE 0 END) / (0.55 + CASE WHEN most > 0 THEN 0.15 ELSE 0 END), 6) ELSE score END AS new_score FROM p, m)
    SELECT id, new_score AS score, row_number() OVER (ORDER BY CASE WHEN pos <= 50 THEN 0 ELSE 1 END, CASE WHEN pos <= 50 THEN -new_score ELSE pos END, id) AS rank FROM s"""
)
def attention_rescore(t: Tables) -> DataFrame:
    return ranking.attention(hits(t), now()).select("id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    HITS_SQL
    + """, p AS (SELECT id, score, file, row_number() OVER (ORDER BY score DESC, id) AS pos, list_distinct(regexp_extract_all(lower(content), '[a-z0-9_]{2,}')) AS k FROM hits),
    j AS (SELECT a.id, a.file = b.file AS same, len(list_intersect(a.k, b.k)) AS i, len(a.k) AS n, len(b.k) AS m FROM p a JOIN p b ON b.pos < a.pos),
    fs AS (SELECT id, product((CASE WHEN n > 0 AND m > 0 AND i / (n + m - i) > 0.85 THEN 1 - 0.4 * (i / (n + m - i)) ELSE 1.0 END) * CASE WHEN same THEN 0.85 ELSE 1.0 END) AS f FROM j GROUP BY id)
    SELECT p.id, round(score * coalesce(f, 1.0), 6) AS score FROM p LEFT JOIN fs ON p.id = fs.id"""
)
def diversity_penalty(t: Tables) -> DataFrame:
    return ranking.diversity(hits(t)).select("id", "score")


@query(HITS_SQL + f" SELECT id, CASE WHEN epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at) BETWEEN 0 AND 3599999999 THEN round(greatest(0, score - 0.15), 6) ELSE score END AS score FROM hits")
def temporal_inhibition(t: Tables) -> DataFrame:
    return ranking.temporal_inhibition(hits(t), now(), F.lit("erst tion")).select("id", "score")


@query(
    "WITH q AS (SELECT unnest(" + repr(QUERIES) + r""") AS query)
    SELECT query, CASE WHEN trim(query) = '' THEN 'broad' WHEN regexp_matches(trim(query), '(?i)\b[\w./-]+\.[a-z]{2,5}\b') OR regexp_matches(trim(query), '\b[a-z]+[A-Z][A-Za-z0-9]+\b')
      OR regexp_matches(trim(query), '\b[A-Z][a-z]+[A-Z][A-Za-z0-9]+\b') OR regexp_matches(trim(query), '\b[a-z][a-z0-9]*_[a-z0-9_]+\b') OR regexp_matches(trim(query), '\b[A-Za-z_][\w]*\s*\(') THEN 'specific'
      WHEN len(list_intersect(string_split(lower(trim(query)), ' '), """ + repr(list(ranking.TECHNICAL)) + r""")) > 0 AND len(string_split(trim(query), ' ')) <= 8 THEN 'focused' ELSE 'broad' END AS class,
      regexp_matches(lower(query), 'recent|latest|today|now|current|just|new') AS temporal,
      regexp_matches(query, '\w+\(\)|(?i:\b(function|class|interface|enum|type|const|import|export)\b)') AS code_like FROM q"""
)
def query_class(t: Tables) -> DataFrame:
    q = t.spark.createDataFrame([(x,) for x in QUERIES], "query string")
    c = F.col("query")
    return q.select("query", ranking.query_class(c).alias("class"), ranking.is_temporal(c).alias("temporal"), ranking.is_code_query(c).alias("code_like"))


@query(
    "WITH q AS (SELECT unnest(" + repr(QUERIES) + r""") AS query), k AS (SELECT unnest(['code', 'decision', 'conversation', 'pattern']) AS type),
    i AS (SELECT query, CASE WHEN regexp_matches(query, '(?i)\bpattern\b|\bconvention\b|\bbest\s+practice') THEN 'pattern' WHEN regexp_matches(query, '(?i)\bwhy\s+(did|do|are|is|we|they|the)\b|\bpor\s+que\s+(decid|escolh|usa)|\bdecision\b') THEN 'decision'
      WHEN regexp_matches(query, '\bwhat\s+is\s+(the\s+)?[A-Z][A-Za-z0-9_]+\b') THEN 'symbol' WHEN regexp_matches(query, '(?i)\b(fix|debug)\s+(the|this|that)\b|\bbroken\b|\bECONN(REFUSED|RESET)\b') THEN 'debug' ELSE 'general' END AS intent FROM q)
    SELECT query, intent, type, round(0.5::DOUBLE * CASE intent || '/' || type WHEN 'decision/decision' THEN 2.0 WHEN 'decision/conversation' THEN 0.6 WHEN 'debug/conversation' THEN 1.8 WHEN 'debug/code' THEN 1.4 WHEN 'debug/decision' THEN 0.6 WHEN 'debug/pattern' THEN 0.7
      WHEN 'pattern/pattern' THEN 2.0 WHEN 'pattern/code' THEN 1.3 WHEN 'pattern/decision' THEN 0.8 WHEN 'symbol/code' THEN 2.0 WHEN 'symbol/pattern' THEN 1.2 ELSE 1.0 END, 6) AS score FROM i, k"""
)
def intent_boost(t: Tables) -> DataFrame:
    q = t.spark.createDataFrame([(x, k, 0.5) for x in QUERIES for k in ("code", "decision", "conversation", "pattern")], "query string, type string, score double")
    return ranking.intent_boost(q, F.col("query"), F.col("type")).select("query", ranking.intent(F.col("query")).alias("intent"), "type", "score")


@query(
    HITS_SQL
    + """, q AS (SELECT id % 5 AS query_id, score, row_number() OVER (PARTITION BY id % 5 ORDER BY score DESC, id) AS n FROM hits),
    a AS (SELECT query_id, max(score) - min(score) AS spread, avg(score) AS mean, max(score) AS top, coalesce(max(score) FILTER (WHERE n = 2), 0) AS second FROM q GROUP BY query_id)
    SELECT query_id, round(spread, 6) AS spread, round(mean, 6) AS mean, round(spread * mean, 6) AS confidence, top >= 0.8 AND round(top - second, 9) >= 0.2 AS definitive,
      NOT (top >= 0.8 AND round(top - second, 9) >= 0.2) AND top < 0.3 AS no_strong_match, NOT (top >= 0.8 AND round(top - second, 9) >= 0.2) AND top >= 0.3 AND spread * mean < 0.15 AS low_confidence FROM a"""
)
def score_spectrum(t: Tables) -> DataFrame:
    return ranking.spectrum(hits(t).withColumn("query_id", F.col("id") % 5))


@query()
def working_set(t: Tables) -> DataFrame:
    return ranking.working_set(hits(t).withColumn("tokens", F.ceil(F.length("content") / 4)), 4000)


@query(
    """WITH s AS (SELECT c_custkey AS id, greatest(0.0, least(1.0, c_acctbal / 10000)) AS importance, count(o_orderkey) AS n, count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS r, coalesce(bool_or(o_orderpriority LIKE '1%'), false) AS d
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
    x AS (SELECT *, CASE WHEN r / 3 < 0.5 THEN 0 WHEN r / 3 <= 1 THEN 0.05 * (r / 3 - 0.5) * 2 ELSE 0.05 * (1 + 0.5 * least(r / 3 - 1, 1)) END
      + CASE WHEN n / 3 < 0.5 THEN 0 WHEN n / 3 <= 1 THEN 0.03 * (n / 3 - 0.5) * 2 ELSE 0.03 * (1 + 0.5 * least(n / 3 - 1, 1)) END + CASE WHEN d THEN 0.08 ELSE 0 END AS delta FROM s)
    SELECT id, round(least(1, importance + least(delta, 0.1)) - importance, 6) AS delta, round(least(1, importance + least(delta, 0.1)), 6) AS new_importance FROM x WHERE delta > 0 AND least(1, importance + least(delta, 0.1)) > importance"""
)
def strengthen(t: Tables) -> DataFrame:
    use = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("r"), F.max(F.col("o_orderpriority").startswith("1")).alias("d"))
    stats = t.customer.select(F.col("c_custkey").alias("id"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c_acctbal") / 10000)).alias("importance")).join(use, "id", "left")
    return ranking.strengthened(
        stats.select("id", "importance", F.coalesce("r", F.lit(0)).alias("recent_access_count"), F.coalesce("n", F.lit(0)).alias("edge_count"), F.coalesce("d", F.lit(False)).alias("referenced_by_decision"))
    )


@query(
    HITS_SQL
    + """, c AS (SELECT id, vector_score, CASE id % 3 WHEN 0 THEN 'snake_case_name' WHEN 1 THEN 'the service handler' ELSE 'plain words' END AS q FROM hits)
    SELECT id FROM c WHERE vector_score IS NULL OR vector_score >= CASE q WHEN 'snake_case_name' THEN 0.55 WHEN 'the service handler' THEN 0.4 ELSE 0.25 END"""
)
def class_gated_hits(t: Tables) -> DataFrame:
    q = F.when(F.col("id") % 3 == 0, "snake_case_name").when(F.col("id") % 3 == 1, "the service handler").otherwise("plain words")
    return ranking.class_gate(hits(t), q).select("id")


@query(
    f"""WITH v AS (SELECT e.vec_id, e.label, {_COS.format(a='CAST(e.embedding AS DOUBLE[])', b='q.qv')} AS score FROM embeddings e, (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings ORDER BY vec_id LIMIT 1) AS q),
    f AS (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 100) SELECT vec_id, score FROM f WHERE label IN (1, 3, 5) ORDER BY score DESC, vec_id LIMIT 20"""
)
def overfetched_search(t: Tables) -> DataFrame:
    """The first 20 of some labels among as many more as a filtered search fetches."""
    asked = t.embeddings.orderBy("vec_id").limit(1).select(F.lit(0).cast("long").alias("query_id"), "embedding")
    found = vector.knn(asked, t.embeddings, ranking.overfetch(20, filtered=True)).join(t.embeddings.select("vec_id", "label"), "vec_id")
    return found.where(F.col("label").isin(1, 3, 5)).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(20)


_TASK = "erst the tion of ouble and is in that"


@query(
    f"""WITH k AS (SELECT list_distinct(regexp_extract_all('{_TASK}', '[a-z0-9_]{{2,}}')) AS b), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{2,}}')) AS a FROM documents)
    SELECT doc_id, round(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END, 6) AS alignment FROM d, k"""
)
def task_alignment(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(ranking.task_alignment(F.col("text"), F.lit(_TASK)), 6).alias("alignment"))
