"""Vector search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import neighbours, vector
from tessera.plans.registry import Tables, query

_COS = "round(greatest(0.0, least(1.0, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))), 6)"
_Q = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT v AS qv FROM e WHERE vec_id = (SELECT min(vec_id) FROM e))"


def first_vector(t: Tables) -> DataFrame:
    return t.embeddings.orderBy("vec_id").limit(1)


def _literal(t: Tables) -> F.Column:
    row = first_vector(t).first()
    return F.array(*[F.lit(float(x)) for x in row["embedding"]]) if row else F.array().cast("array<double>")


@query(f"{_Q} SELECT vec_id, {_COS.format(a='v', b='qv')} AS score FROM e, q ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_cosine(t: Tables) -> DataFrame:
    return vector.nearest(_literal(t), t.embeddings, 10)


@query(
    f"""{_Q}, h AS (SELECT vec_id, v, qv, list_sum(list_transform(list_zip(v, qv), lambda z: CAST((z[1] >= 0) <> (z[2] >= 0) AS INT))) AS distance FROM e, q),
    c AS (SELECT * FROM h ORDER BY distance, vec_id LIMIT 200)
    SELECT vec_id, CAST(distance AS BIGINT) AS distance, {_COS.format(a='v', b='qv')} AS score FROM c ORDER BY score DESC, vec_id LIMIT 10"""
)
def vector_two_phase_bq(t: Tables) -> DataFrame:
    q = first_vector(t).first()
    size = len(q["embedding"]) if q else 0
    return vector.two_phase(_literal(t), t.embeddings, 10, size).withColumn("distance", F.col("distance").cast("long"))


@query(
    f"""{_Q}, p AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b,
      round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score
      FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT * FROM p WHERE score >= 0.35"""
)
def knn_self_join_by_label(t: Tables) -> DataFrame:
    return vector.similar_pairs(t.embeddings, "label", 0.35)


@query(
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS.format(a='a.v', b='b.v')} AS score FROM e a, e b WHERE a.vec_id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, score, rank FROM r WHERE rank <= 5"""
)
def knn_join(t: Tables) -> DataFrame:
    asked = t.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn(asked, t.embeddings, 5)


@query(
    """SELECT d.lang, count(*) AS items, CAST(sum(length(d.text)) AS BIGINT) AS chars FROM documents d GROUP BY d.lang"""
)
def store_stats(t: Tables) -> DataFrame:
    return vector.store_stats(t.documents, "lang", "text")


@query(
    """WITH x AS (SELECT label, unnest(range(len(embedding))) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    SELECT label, d AS dim, round(avg(x), 6) AS mean FROM x GROUP BY label, d"""
)
def label_centroids(t: Tables) -> DataFrame:
    dims = t.embeddings.select("label", F.posexplode(V.as_double(F.col("embedding"))).alias("dim", "x"))
    return dims.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


@query(
    """WITH x AS (SELECT vec_id AS id, label, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    c AS (SELECT id, dim, x, n, (s - x) / (n - 1) AS c FROM (SELECT *, sum(x) OVER (PARTITION BY label, dim) AS s, count(*) OVER (PARTITION BY label, dim) AS n FROM x)),
    j AS (SELECT id, max(n) - 1 >= 5 AND sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) >= 0.1 AS evolved FROM c GROUP BY id)
    SELECT c.id, evolved, dim, round(CASE WHEN evolved THEN 0.7 * x + 0.3 * c ELSE x END, 6) AS x FROM c JOIN j ON c.id = j.id"""
)
def embedding_evolution(t: Tables) -> DataFrame:
    items = t.embeddings.select(F.col("vec_id").alias("id"), "label", "embedding")
    out = vector.evolved_in_groups(items, "label", min_cosine=0.1)
    return out.select("id", "evolved", F.posexplode("embedding").alias("dim", "x")).select("id", "evolved", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@query()
def vector_index_search(t: Tables) -> DataFrame:
    """Items near every fiftieth one by an index; tests measure its recall."""
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.Index(t.embeddings).search(asked, 10)


def altered(t: Tables) -> DataFrame:
    """The vectors, the vectors without every sixteenth component, and, of one label, the vectors again."""
    e = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label")
    thin = e.select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i % 16 == 0, 0.0).otherwise(x)).alias("embedding"), "label")
    return e.unionByName(thin).unionByName(e.where("label = 3").withColumn("vec_id", F.col("vec_id") + 20_000_000))


@query(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), x AS (SELECT vec_id AS id, v FROM e
      UNION ALL SELECT vec_id + 10000000, list_transform(v, lambda a, i: CASE WHEN (i - 1) % 16 = 0 THEN 0.0 ELSE a END) FROM e UNION ALL SELECT vec_id + 20000000, v FROM e WHERE label = 3),
    c AS (SELECT v, min(id) AS rep, count(*) AS n, sqrt(list_dot_product(v, v)) AS norm FROM x GROUP BY v), p AS (SELECT a.rep, sum(b.n) AS others FROM c a JOIN c b ON a.rep <> b.rep WHERE round(list_dot_product(a.v, b.v) / (a.norm * b.norm), 6) >= 0.95 GROUP BY a.rep)
    SELECT x.id, c.rep, CAST(c.n - 1 + coalesce(p.others, 0) AS BIGINT) AS links FROM x JOIN c ON c.v = x.v LEFT JOIN p ON p.rep = c.rep"""
)
def near_vector_links(t: Tables) -> DataFrame:
    """How many vectors each is near to at 0.95, by bands of hyperplane signatures."""
    return neighbours.near_pairs(altered(t), 0.95).links()


@query()
def vector_graph_search(t: Tables) -> DataFrame:
    """Items near every fiftieth one by a graph of neighbours; tests measure its recall and what it compares."""
    asked = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return neighbours.Graph(t.embeddings).search(asked, 10)


@query("SELECT vec_id, label FROM embeddings WHERE label = 3 AND vec_id IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def collection_get(t: Tables) -> DataFrame:
    wanted = t.lineitem.where("l_quantity = 50").select(F.col("l_partkey").alias("vec_id"))
    return vector.collected(t.embeddings, label=3).join(wanted, "vec_id", "left_semi").select("vec_id", "label")
