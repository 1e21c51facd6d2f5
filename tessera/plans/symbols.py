"""Queries on definitions, references, imports and working records; parts and orders stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import code, text
from tessera.operators import joins, ranking, symbols
from tessera.plans.ranking import HITS_SQL, hits
from tessera.plans.registry import Tables, query
from tessera.session import spread


def definitions(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), (F.col("p_size") > 20).alias("exported"), F.col("p_brand").alias("file_path"))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'a') AND p_size > 20 AND p_brand = (SELECT min(p_brand) FROM part) ORDER BY name, id LIMIT 50")
def definition_search(t: Tables) -> DataFrame:
    first = t.part.agg(F.min("p_brand")).first()[0]
    return symbols.definition_search(definitions(t), "A", exported=True, file=first).select("id", "name")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR ends_with(l_shipdate::VARCHAR || '#' || l_linestatus, '#F')")
def reference_search(t: Tables) -> DataFrame:
    refs = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("symbol_name"), F.concat(F.col("l_shipdate").cast("string"), F.lit("#"), F.when(F.col("l_linestatus") == "F", "R").otherwise("x")).alias("target_fqn"))
    return symbols.references_to(refs, "R").select("l_orderkey", "l_linenumber")


@query("SELECT l_suppkey AS src, l_partkey AS dst, l_returnflag AS kind FROM lineitem WHERE (l_suppkey = 3 OR l_partkey = 3) AND l_returnflag IN ('A', 'R') ORDER BY src, dst, kind LIMIT 200")
def typed_edges(t: Tables) -> DataFrame:
    return symbols.typed_edges(t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind")), 3, ["A", "R"])


@query(
    """WITH d AS (SELECT p_partkey AS id, p_size AS name, p_partkey % 1000 AS file FROM part), r AS (SELECT s_suppkey AS ref_id, s_suppkey % 50 + 1 AS name, s_suppkey % 1000 AS file FROM supplier),
    i AS (SELECT DISTINCT l_suppkey % 1000 AS src, l_partkey % 1000 AS dst FROM lineitem), c AS (SELECT dst AS file, count(*) / 40 AS rank FROM i GROUP BY dst)
    SELECT ref_id, id, row_number() OVER (PARTITION BY ref_id ORDER BY CASE WHEN r.file = d.file THEN 2 WHEN i.src IS NOT NULL THEN 1 ELSE 0 END DESC, coalesce(rank, 0) DESC, id) AS place
    FROM r JOIN d ON r.name = d.name LEFT JOIN i ON i.src = r.file AND i.dst = d.file LEFT JOIN c ON c.file = d.file"""
)
def go_to_definition(t: Tables) -> DataFrame:
    d = t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("name"), (F.col("p_partkey") % 1000).alias("file"))
    r = t.supplier.select(F.col("s_suppkey").alias("ref_id"), (F.col("s_suppkey") % 50 + 1).alias("name"), (F.col("s_suppkey") % 1000).alias("file"))
    i = t.lineitem.select((F.col("l_suppkey") % 1000).alias("src"), (F.col("l_partkey") % 1000).alias("dst")).distinct()
    c = i.groupBy(F.col("dst").alias("file")).agg((F.count("*") / 40).alias("rank"))
    return symbols.go_to_definition(d, r, i, c)


@query(
    """WITH d AS (SELECT p_partkey AS id, p_size + 100000 AS legacy FROM part), a AS (SELECT DISTINCT l_partkey + 3 AS asked FROM lineitem UNION SELECT 100000 + s_suppkey FROM supplier),
    n AS (SELECT legacy, min(id) AS alias, count(*) AS n FROM d GROUP BY legacy)
    SELECT asked, coalesce(d.id, CASE WHEN n = 1 THEN alias END) AS id, CASE WHEN d.id IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'legacy' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS state FROM a LEFT JOIN d ON d.id = asked LEFT JOIN n ON n.legacy = asked"""
)
def symbol_resolution(t: Tables) -> DataFrame:
    d = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") + 100000).cast("long").alias("legacy"))
    asked = t.lineitem.select((F.col("l_partkey") + 3).alias("asked")).union(t.supplier.select(F.col("s_suppkey") + 100000)).distinct()
    return symbols.resolved(asked, d)


_IMPORTS = """f AS (SELECT page_id, 'src/h' || page_id % 7 || '/p' || page_id AS base, CASE page_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.js' ELSE '/index.ts' END AS ext FROM pages)"""


@query(
    f"""WITH {_IMPORTS}, i AS (SELECT f.base || f.ext AS src, f.page_id + 7 AS a, f.page_id + 1 AS b, f.ext FROM f),
    s AS (SELECT src, CASE ext WHEN '/index.ts' THEN '../p' ELSE './p' END || a AS specifier, a AS want FROM i UNION ALL SELECT src, CASE ext WHEN '/index.ts' THEN '../../h' ELSE '../h' END || b % 7 || '/./p' || b, b FROM i
      UNION ALL SELECT src, '@/h' || b % 7 || '/p' || b, b FROM i UNION ALL SELECT src, '@site/pages/h' || a % 7 || '/p' || a, a FROM i UNION ALL SELECT src, 'react', -1 FROM i)
    SELECT src, specifier, f.base || f.ext AS dst FROM s LEFT JOIN f ON f.page_id = s.want"""
)
def import_targets(t: Tables) -> DataFrame:
    number = F.col("page_id").cast("string")
    name = lambda n: F.concat(F.lit("h"), (n % 7).cast("string"), F.lit("/p"), n.cast("string"))
    ext = F.when(F.col("page_id") % 3 == 0, ".ts").when(F.col("page_id") % 3 == 1, ".js").otherwise("/index.ts")
    rows = t.pages.select("page_id", F.concat(F.lit("src/"), name(F.col("page_id")), ext).alias("src"), (F.col("page_id") % 3 == 2).alias("deep"))
    up, a, b = lambda near, far: F.when(F.col("deep"), far).otherwise(near), F.col("page_id") + 7, F.col("page_id") + 1
    specifiers = F.array(
        F.concat(up("./p", "../p"), a.cast("string")), F.concat(up("../h", "../../h"), (b % 7).cast("string"), F.lit("/./p"), b.cast("string")),
        F.concat(F.lit("@/"), name(b)), F.concat(F.lit("@site/pages/"), name(a)), F.lit("react"),
    )
    imports = rows.select("src", F.explode(specifiers).alias("specifier"))
    return symbols.import_targets(imports, rows.select(F.col("src").alias("path")), {"@/": "src/"}, packages={"@site/pages": "src"})


@query(
    """WITH e AS (SELECT l_suppkey AS src, l_partkey + 50 AS dst FROM lineitem), o AS (SELECT src AS node, count(DISTINCT dst) AS fan_out FROM e GROUP BY src), i AS (SELECT dst AS node, count(DISTINCT src) AS fan_in FROM e GROUP BY dst)
    SELECT coalesce(o.node, i.node) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, CASE WHEN fan_in IS NULL THEN 'entry' WHEN fan_out IS NULL THEN 'leaf' ELSE 'middle' END AS layer, coalesce(fan_in, 0) * coalesce(fan_out, 0) AS hotspot FROM o FULL JOIN i ON o.node = i.node"""
)
def architecture_layers(t: Tables) -> DataFrame:
    return symbols.layers(t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 50).alias("dst")))


@query(
    """WITH g AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, min(url) AS a, max(url) AS b FROM pages GROUP BY 1), s AS (SELECT host, string_split(a, '/') AS x, string_split(b, '/') AS y FROM g),
    n AS (SELECT host, x, (SELECT coalesce(min(i), len(x)) FROM (SELECT unnest(range(len(x))) AS i) WHERE i >= len(y) OR x[i + 1] <> y[i + 1]) AS n FROM s)
    SELECT host, array_to_string(x[1 : least(n, len(x) - 1)], '/') AS prefix FROM n"""
)
def community_labels(t: Tables) -> DataFrame:
    return symbols.common_prefix(t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url"), "host", "url")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate + INTERVAL 2000 DAY > TIMESTAMP '2001-06-01' AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, id LIMIT 20 OFFSET 5")
def checkpoint_list(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.lit("p").alias("project_id"), F.col("o_orderdate").alias("created_at"), F.expr("o_orderdate + interval 2000 days").alias("expires_at"))
    return symbols.checkpoints(rows, F.lit("2001-06-01").cast("timestamp_ntz"), kind="F", offset=5).select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND (o_custkey % 5 = 0 OR o_custkey % 5 = 3)")
def handoff_visibility(t: Tables) -> DataFrame:
    target = F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 5)
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), target.alias("target"), F.col("o_orderdate").alias("created_at"))
    return symbols.open_handoffs(rows, 3).select("id")


@query("SELECT c_custkey AS id, CAST(count(o_orderkey) + c_custkey % 3 AS BIGINT) AS access_count, max(o_orderdate) AS last_accessed FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def access_counters(t: Tables) -> DataFrame:
    items = t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("access_count"), F.lit(None).cast("timestamp_ntz").alias("last_accessed"))
    return symbols.counted(items, t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("at")))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM customer")
def soft_delete(t: Tables) -> DataFrame:
    m = t.customer.select(F.col("c_custkey").alias("id"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"))
    return symbols.soft_deleted(m, t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("id")), F.lit("2024-01-01").cast("timestamp_ntz"))


@query("SELECT l_orderkey, l_linenumber, round(greatest(0, least(1, least(l_discount * 10 + 0.1, 0.8))), 6) AS weight FROM lineitem")
def edge_weight_clamp(t: Tables) -> DataFrame:
    e = symbols.raised(t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("weight")), 0.1, 0.8)
    return e.withColumn("weight", F.round("weight", 6))


@query(
    """WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT DISTINCT sha256(text) AS key FROM documents WHERE doc_id % 3 = 0)
    SELECT count(*) AS asked, count(c.key) AS hits, round(count(c.key) / count(*), 6) AS hit_rate FROM d LEFT JOIN c ON d.key = c.key"""
)
def embedding_cache(t: Tables) -> DataFrame:
    cache = t.documents.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("key"), F.array(F.lit(1.0)).alias("embedding")).dropDuplicates(["key"])
    got = symbols.cached(t.documents.select("doc_id", "text"), cache)
    return got.agg(F.count("*").alias("asked"), F.count("embedding").alias("hits"), F.round(F.count("embedding") / F.count("*"), 6).alias("hit_rate"))


@query(
    """WITH k AS (SELECT o_custkey AS key, list(DISTINCT o_orderpriority) AS files, max(o_orderdate) AS last_accessed FROM orders GROUP BY o_custkey)
    SELECT key FROM k WHERE NOT list_contains(files, '1-URGENT') AND last_accessed > TIMESTAMP '2001-01-01' ORDER BY last_accessed DESC, key LIMIT 10"""
)
def cache_invalidation(t: Tables) -> DataFrame:
    cache = t.orders.groupBy(F.col("o_custkey").alias("key")).agg(F.collect_set("o_orderpriority").alias("files"), F.max("o_orderdate").alias("last_accessed"))
    return joins.evicted(joins.alive(joins.invalidated(cache, ["URGENT"]), F.lit("2001-01-01").cast("timestamp_ntz")), 10).select("key")


@query(
    HITS_SQL
    + """, s AS (SELECT query_id, id AS src FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS n FROM hits) WHERE n <= 20), e AS (SELECT DISTINCT l_suppkey AS src, l_partkey % 1000 AS dst FROM lineitem),
    m AS (SELECT DISTINCT query_id, dst AS id FROM s JOIN e ON s.src = e.src) SELECT m.query_id, m.id, length(text) AS n FROM m JOIN documents ON doc_id = m.id WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.id = m.id)"""
)
def graph_hydration(t: Tables) -> DataFrame:
    edges = t.lineitem.select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 1000).alias("dst"))
    out = symbols.hydrated(hits(t), edges, t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content")))
    return out.select("query_id", "id", F.length("content").cast("long").alias("n"))


@query(HITS_SQL + " SELECT id, round(least(1, score * greatest(0.5, 1 - (id % 1000) / 365 * 0.1) * (1 + ln(1 + access_count) / 10 * 0.1)), 6) AS score FROM hits")
def recency_boost(t: Tables) -> DataFrame:
    from tessera.operators.vector import boosted

    return boosted(hits(t), F.col("id") % 1000, F.col("access_count")).select("id", F.round("score", 6).alias("score"))


@query(
    HITS_SQL
    + """, v AS (SELECT id % 7 AS j, min(id) AS id, row_number() OVER (ORDER BY min(id)) AS position FROM hits GROUP BY id % 7)
    SELECT h.id, row_number() OVER (ORDER BY v.position NULLS LAST, h.score DESC, h.id) AS rank FROM hits h LEFT JOIN v ON v.id = h.id"""
)
def verdict_permutation(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    h = hits(t)
    v = h.groupBy((F.col("id") % 7).alias("j")).agg(F.min("id").alias("id")).select(F.lit(0).cast("long").alias("query_id"), "id", F.row_number().over(Window.orderBy("id")).alias("position"))
    unknown = v.select("query_id", (F.col("id") + 10_000_000).alias("id"), "position")
    return ranking.permuted(h, v.unionByName(unknown)).select("id", F.col("rank").cast("long").alias("rank"))


@query(
    HITS_SQL
    + """ SELECT id, array_to_string(string_split(coalesce(content, ''), chr(10))[1:5], chr(10)) AS preview, round(score * CASE WHEN file = 'src1' THEN 1.5 ELSE 1.0 END, 6) AS score FROM hits"""
)
def preview_and_file_boost(t: Tables) -> DataFrame:
    return ranking.file_boost(hits(t), "file", {"src1": 1.5}).select("id", ranking.preview(F.col("content")).alias("preview"), F.round("score", 6).alias("score"))


@query(
    """WITH s AS (SELECT o_custkey % 50 AS agent, o_orderkey AS id, o_orderkey % 13 AS n FROM orders) SELECT id, round(CASE WHEN agent = 7 THEN 0.6 ELSE 0.0 END + 0.4 * least(n / 10, 1.0), 6) AS affinity FROM s"""
)
def agent_affinity(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("id"), F.round(ranking.affinity(F.col("o_custkey") % 50 == 7, F.col("o_orderkey") % 13), 6).alias("affinity"))


@query(
    """WITH p AS (SELECT p_partkey, regexp_extract_all(p_name || ' ' || p_type, '[A-Za-z]+') AS ws FROM part), c AS (SELECT p_partkey, list_transform(ws, lambda w: upper(w[1]) || lower(w[2:])) AS ws FROM p),
    u AS (SELECT p_partkey, unnest(list_prepend('services', list_transform(list_concat(ws, ['Deep', 'Index']), lambda w: lower(w)))) AS w, unnest(range(len(ws) + 3)) AS i FROM c),
    d AS (SELECT p_partkey, w, min(i) AS i FROM u WHERE length(w) >= 3 AND w NOT IN ('src', 'lib', 'test', 'tests', 'spec', 'index', 'main', 'ts', 'tsx', 'js', 'jsx', 'py', 'rs', 'go', 'java', 'dart') GROUP BY p_partkey, w)
    SELECT p_partkey, string_agg(w, ',' ORDER BY i) AS topics FROM d GROUP BY p_partkey"""
)
def prefetch_topics(t: Tables) -> DataFrame:
    ws = F.regexp_extract_all(F.concat_ws(" ", "p_name", "p_type"), F.lit("([A-Za-z]+)"), 1)
    camel = F.array_join(F.transform(ws, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20)))), "")
    path = F.concat(F.lit("src/services/"), camel, F.lit(".ts"))
    return t.part.select("p_partkey", F.array_join(text.topics(path, F.array(F.lit("DeepIndex"))), ",").alias("topics"))


@query("SELECT l_returnflag AS kind, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY ALL")
def references_per_kind(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@query(
    """WITH x AS (SELECT o_orderkey AS id, ['critical', 'conversation', 'code', 'pattern', 'decision', 'note'][1 + o_orderkey % 6] AS type, CASE WHEN o_orderkey % 7 = 0 THEN 'p' END AS project, CASE WHEN o_orderkey % 5 = 0 THEN 'u' END AS usr,
      CASE WHEN o_orderkey % 4 = 0 THEN 's' END AS session, ['orchestrator', 'architect', 'optimizer', 'none'][1 + o_custkey % 4] AS agent FROM orders)
    SELECT id, CAST(CASE WHEN agent = 'orchestrator' AND type IN ('decision', 'critical') THEN 0 WHEN agent = 'architect' AND type IN ('pattern', 'code', 'critical') THEN 1 WHEN agent = 'optimizer' AND type = 'critical' THEN 2
      WHEN project IS NOT NULL THEN 1 WHEN usr IS NOT NULL AND session IS NULL THEN 2 WHEN session IS NOT NULL THEN 3 WHEN type = 'critical' THEN 2 WHEN type IN ('code', 'pattern') THEN 1 WHEN type = 'decision' THEN 0 ELSE 3 END AS BIGINT) AS level FROM x"""
)
def level_assignment(t: Tables) -> DataFrame:
    from tessera.operators.memory import level

    k = F.col("o_orderkey")
    of = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    kind, agent = of(("critical", "conversation", "code", "pattern", "decision", "note"), k % 6), of(("orchestrator", "architect", "optimizer", "none"), F.col("o_custkey") % 4)
    return t.orders.select(k.alias("id"), level(kind, F.when(k % 5 == 0, "u"), F.when(k % 4 == 0, "s"), F.when(k % 7 == 0, "p"), agent).cast("long").alias("level"))


_FILES = """f AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'packages/h' || page_id % 9 || '/' WHEN 1 THEN 'src/' WHEN 2 THEN 'lib/x/' ELSE '' END || CASE WHEN page_id % 10 = 0 THEN 'main' || '.ts' ELSE 'p' || page_id || '.ts' END AS path FROM pages),
    e AS (SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.page_id = a.page_id * 3 % 100 OR b.page_id = a.page_id + 1)"""


def files(t: Tables) -> DataFrame:
    p = F.col("page_id")
    folder = F.when(p % 4 == 0, F.concat(F.lit("packages/h"), (p % 9).cast("string"), F.lit("/"))).when(p % 4 == 1, "src/").when(p % 4 == 2, "lib/x/").otherwise("")
    return t.pages.select("page_id", F.concat(folder, F.when(p % 10 == 0, "main.ts").otherwise(F.concat(F.lit("p"), p.cast("string"), F.lit(".ts")))).alias("path"))


def file_edges(t: Tables) -> DataFrame:
    to = F.explode(F.array_distinct(F.array(F.col("page_id") * 3 % 100, F.col("page_id") + 1))).alias("to")
    return files(t).select(F.col("path").alias("src"), to).join(files(t).select(F.col("page_id").alias("to"), F.col("path").alias("dst")), "to").select("src", "dst")


_PACKAGE = "CASE WHEN {0} LIKE 'packages/%' THEN split_part({0}, '/', 2) WHEN contains({0}, '/') THEN split_part({0}, '/', 1) ELSE '<root>' END"


@query(
    f"""WITH {_FILES}, s AS (SELECT {_PACKAGE.format("path")} AS name, count(*) AS files FROM f GROUP BY 1), b AS (SELECT DISTINCT {_PACKAGE.format("src")} AS x, {_PACKAGE.format("dst")} AS y FROM e),
    w AS (SELECT name, files, (SELECT count(*) FROM b WHERE y = name AND x <> y) AS fan_in, (SELECT count(*) FROM b WHERE x = name AND x <> y) AS fan_out FROM s) SELECT * FROM w ORDER BY files DESC, fan_in DESC, name LIMIT 15"""
)
def package_map(t: Tables) -> DataFrame:
    return symbols.packages(files(t).select("path"), file_edges(t))


@query(
    f"""WITH {_FILES}, i AS (SELECT dst AS file, count(DISTINCT src) AS n FROM e GROUP BY dst), o AS (SELECT src AS file, count(DISTINCT dst) AS n FROM e GROUP BY src),
    w AS (SELECT coalesce(i.file, o.file) AS file, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM i FULL JOIN o ON i.file = o.file), s AS (SELECT *, regexp_matches(file, '(^|/)main\\.ts$') AS starts FROM w)
    SELECT * FROM s WHERE starts OR (fan_in >= 1 AND fan_out <= greatest(2, fan_in)) ORDER BY starts DESC, fan_in DESC, file LIMIT 20"""
)
def entry_points(t: Tables) -> DataFrame:
    return symbols.entry_points(file_edges(t))


@query(
    """WITH r AS (SELECT 1 AS source, event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'ANY' ELSE upper(event_type) END AS method, '/u/' || user_id % 8 AS path, 'f' || event_id AS file, event_type AS handler FROM events WHERE event_id % 5 <> 0
      UNION ALL SELECT CASE WHEN page_id % 2 = 0 THEN 2 ELSE 3 END, page_id, CASE WHEN page_id % 4 = 0 THEN 'ANY' ELSE 'GET' END, '/p/' || page_id % 60, url, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'get ' END || '/p/' || page_id % 60 FROM pages),
    f AS (SELECT method, path, min(row(source, id, file, handler)) AS f FROM r GROUP BY method, path) SELECT method, path, f[3] AS file, f[4] AS handler FROM f ORDER BY f[1], f[2], method, path LIMIT 50"""
)
def route_map(t: Tables) -> DataFrame:
    e, p = F.col("event_id"), F.col("page_id")
    calls = t.events.select(
        e.alias("id"), F.concat(F.lit("f"), e.cast("string")).alias("file"), F.when(e % 5 != 0, F.concat(F.lit("/u/"), (F.col("user_id") % 8).cast("string"))).alias("route"),
        F.when(e % 3 != 0, F.col("event_type")).alias("method"), F.col("event_type").alias("handler"),
    )
    defs = t.pages.select(p.alias("id"), F.col("url").alias("file"), F.concat(F.when(p % 4 == 0, "").otherwise("get "), F.lit("/p/"), (p % 60).cast("string")).alias("name"), F.when(p % 2 == 0, "route").otherwise("function").alias("kind"))
    return symbols.routes(calls, defs)


@query(
    """WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem), t AS (SELECT a % 5 AS community, a % 5 = b % 5 AS inner_ FROM e UNION ALL SELECT b % 5, false FROM e WHERE a % 5 <> b % 5)
    SELECT community, count(*) FILTER (WHERE inner_) AS inside, count(*) AS touching, round(count(*) FILTER (WHERE inner_) / count(*), 6) AS cohesion FROM t GROUP BY community"""
)
def community_cohesion(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), "l_suppkey", "l_partkey").distinct()
    groups = e.select(F.col("src").alias("node"), (F.col("l_suppkey") % 5).alias("community")).unionByName(e.select(F.col("dst").alias("node"), (F.col("l_partkey") % 5).alias("community"))).distinct()
    return symbols.cohesion(e.select("src", "dst"), groups)


@query(
    f"""WITH {_FILES}, r AS (SELECT dst AS path, count(*) / 10 AS rank FROM e GROUP BY dst), n AS (SELECT *, row_number() OVER (ORDER BY rank DESC, path) AS place FROM r)
    SELECT 0 AS place, 'Project: ' || substr(trim(regexp_replace(text, '[\\t\\n\\x0b\\f\\r ]+', ' ', 'g')), 1, 200) AS content FROM documents WHERE doc_id = (SELECT min(doc_id) FROM documents)
    UNION ALL SELECT place, 'Central file: ' || path || ' (' || printf('%.3f', rank) || ')' FROM n WHERE place <= 9"""
)
def bootstrap_seeds(t: Tables) -> DataFrame:
    first = t.documents.orderBy("doc_id").limit(1).select("text")
    ranks = file_edges(t).groupBy(F.col("dst").alias("path")).agg((F.count("*") / 10).alias("rank"))
    return symbols.seeds(ranks, first).withColumn("place", F.col("place").cast("long"))


@query(
    """WITH k AS (SELECT doc_id, lang, source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents), c AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g) AS place FROM k GROUP BY g)
    SELECT place, 0 AS nth, g || ' (' || least(n, 3) || '/' || n || ' rows)' AS line FROM c WHERE place <= 4 UNION ALL SELECT place, nth, '  {"doc_id":' || doc_id || ',"lang":"' || lang || '"}' FROM k JOIN c USING (g) WHERE place <= 4 AND nth <= 3"""
)
def result_tree(t: Tables) -> DataFrame:
    out = symbols.tree(t.documents.select("doc_id", "lang", "source"), F.col("source"), ["doc_id", "lang"], [F.col("doc_id")], 4, 3)
    return out.select(F.col("place").cast("long").alias("place"), F.col("nth").cast("long").alias("nth"), "line")


_CODE = (
    "import a from './m%d'\nclass P%d {\n  run(x) {\n    axios.get('/api/%d')\n  }\n}\n",
    "// load(%d)\nexport function f%d(x) {\n  return helper(x, 'b%d')\n}\n",
    "const fs = require('f%d')\n\nfunction g%d() {}\nfs.open('p%d')\n",
)


def varied(t: Tables) -> DataFrame:
    """A source text for each part, of one of three shapes by its size."""
    k = F.col("p_partkey").cast("long")
    shapes = [F.format_string(c, k, k, k) for c in _CODE]
    return spread(t.part.select("p_partkey", "p_size")).select("p_partkey", F.element_at(F.array(*shapes), F.col("p_size") % 3 + 1).alias("source"))


@query(
    """WITH r AS (SELECT p_partkey, p_size % 3 AS shape, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT p_partkey, unnest(['import', 'declaration', 'declaration', 'call']) AS kind, unnest(['./m' || k, 'P' || k, 'P' || k || '.run', 'axios.get']) AS name, unnest([1, 2, 3, 4]::BIGINT[]) AS line, unnest([NULL, NULL, NULL, '/api/' || k]) AS literal FROM r WHERE shape = 0
    UNION ALL SELECT p_partkey, unnest(['declaration', 'call']), unnest(['f' || k, 'helper']), unnest([2, 3]::BIGINT[]), NULL FROM r WHERE shape = 1
    UNION ALL SELECT p_partkey, unnest(['declaration', 'import', 'declaration', 'call']), unnest(['fs', 'f' || k, 'g' || k, 'fs.open']), unnest([1, 1, 3, 4]::BIGINT[]), unnest([NULL, NULL, NULL, 'p' || k]) FROM r WHERE shape = 2"""
)
def source_structure(t: Tables) -> DataFrame:
    return varied(t).select("p_partkey", F.explode(text.structure_column("source")).alias("x")).select("p_partkey", "x.*")


_FLOW = "const size = %d\nfunction outer(name) {\n%s  send(name, size)\n}\nbus.emit('e%d', size)\n"


@query(
    """WITH r AS (SELECT p_partkey, p_size % 4 AS n, p_partkey % 3 = 0 AS shadow FROM part), x AS (SELECT *, n + shadow::INT AS more FROM r)
    SELECT p_partkey, 'call' AS kind, 'wrap' AS target, '' AS qualifier, CAST(3 + shadow::INT + i AS BIGINT) AS line, NULL::BIGINT AS param_index, NULL AS argument, NULL::BIGINT AS defined FROM x, range(4) AS t(i) WHERE i < n
    UNION ALL SELECT p_partkey, 'data_flow', 'wrap', '', 3 + shadow::INT + i, 0, 'name', 2 FROM x, range(4) AS t(i) WHERE i < n
    UNION ALL SELECT p_partkey, 'call', 'send', '', 3 + more, NULL, NULL, NULL FROM x UNION ALL SELECT p_partkey, 'data_flow', 'send', '', 3 + more, 0, 'name', 2 FROM x
    UNION ALL SELECT p_partkey, 'data_flow', 'send', '', 3 + more, 1, 'size', CASE WHEN shadow THEN 3 ELSE 1 END FROM x
    UNION ALL SELECT p_partkey, 'emit', 'e' || p_partkey, 'bus', 5 + more, NULL, NULL, NULL FROM x UNION ALL SELECT p_partkey, 'data_flow', 'emit', 'bus', 5 + more, 1, 'size', 1 FROM x"""
)
def data_flow_edges(t: Tables) -> DataFrame:
    """Calls and data flow of sources with up to three more calls and, in a third of them, a name that is defined again."""
    k = F.col("p_partkey").cast("long")
    inner = F.concat(F.when(F.col("p_partkey") % 3 == 0, "  let size = 5 // wrap(size)\n").otherwise(""), F.repeat(F.lit("  wrap(name)\n"), (F.col("p_size") % 4).cast("int")))
    return code.edges(spread(t.part.select("p_partkey", "p_size")).select("p_partkey", F.format_string(_FLOW, k, inner, k).alias("source")), "p_partkey", F.col("source"))
