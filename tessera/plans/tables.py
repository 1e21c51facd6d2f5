"""Scan, filter, join and upsert queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import filters, joins, symbols
from tessera.plans.registry import Tables, query


@query(
    """WITH r AS (SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS root, page_id % 7 AS project_id FROM pages),
    c AS (SELECT page_id, project_id, length(root) AS n FROM pages JOIN r ON url = root OR starts_with(url, root || '/')),
    b AS (SELECT page_id, n, min(project_id) AS project_id, count(DISTINCT project_id) AS k, row_number() OVER (PARTITION BY page_id ORDER BY n DESC) AS rn FROM c GROUP BY page_id, n)
    SELECT page_id, project_id FROM b WHERE rn = 1 AND k = 1"""
)
def longest_prefix_attribution(t: Tables) -> DataFrame:
    roots = t.pages.select(F.regexp_replace("url", "/[^/]*$", "").alias("root"), (F.col("page_id") % 7).alias("project_id"))
    return joins.longest_prefix(t.pages, "url", "page_id", roots)


@query(
    """WITH e AS (SELECT * FROM events WHERE event_type = 'error'), v AS (SELECT * FROM events WHERE event_type = 'view'),
    b AS (SELECT e.event_id, max(v.ts) AS ts FROM e JOIN v ON v.user_id = e.user_id AND v.ts <= e.ts GROUP BY e.event_id), a AS (SELECT e.event_id, min(v.ts) AS ts FROM e JOIN v ON v.user_id = e.user_id AND v.ts > e.ts GROUP BY e.event_id)
    SELECT e.event_id, e.user_id, epoch_us(coalesce(b.ts, a.ts)) AS anchor FROM e LEFT JOIN b ON e.event_id = b.event_id LEFT JOIN a ON e.event_id = a.event_id"""
)
def asof_anchor(t: Tables) -> DataFrame:
    ev = t.events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    errors = ev.where("event_type = 'error'").select("event_id", "user_id", "us")
    views = ev.where("event_type = 'view'").select("user_id", "us", F.col("us").alias("v"))
    return joins.as_of(errors, views, "user_id", "us", "v").select("event_id", "user_id", "anchor")


@query(
    """WITH p AS (SELECT a.user_id, a.event_id, b.event_id AS peer, row_number() OVER (PARTITION BY a.event_id ORDER BY b.ts DESC, b.event_id DESC) AS n FROM events a JOIN events b
      ON a.user_id = b.user_id AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id < a.event_id)) AND b.ts >= a.ts - INTERVAL 10 MINUTE)
    SELECT user_id, event_id, peer, n FROM p WHERE n <= 5"""
)
def co_occurrence_10min(t: Tables) -> DataFrame:
    ev = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return joins.co_occurring(ev, "user_id", "event_id", "ts", 600, 5).withColumn("n", F.col("n").cast("long"))


@query(
    """WITH a AS (SELECT doc_id AS id, lang, n_chars AS s, n_chars + 20 AS e FROM documents WHERE source < 'src5'), b AS (SELECT doc_id AS id, lang, n_chars + 11 AS s, n_chars + 16 AS e FROM documents WHERE source >= 'src5')
    SELECT a.lang, a.id AS a_id, b.id AS b_id FROM a JOIN b ON a.lang = b.lang AND a.s <= b.e + 3 AND b.s - 3 <= a.e"""
)
def range_overlap(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    a = t.documents.where("source < 'src5'").select(F.col("doc_id").alias("id"), "lang", n.alias("line_start"), (n + 20).alias("line_end"))
    b = t.documents.where("source >= 'src5'").select(F.col("doc_id").alias("id"), "lang", (n + 11).alias("line_start"), (n + 16).alias("line_end"))
    return joins.overlapping(a, b, "lang", 3)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def superseded_anti(t: Tables) -> DataFrame:
    gone = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(gone, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def live_targets_semi(t: Tables) -> DataFrame:
    dear = t.orders.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(dear, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT source AS project, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) GROUP BY source")
def orphan_projects(t: Tables) -> DataFrame:
    return t.documents.join(t.labels.select("doc_id"), "doc_id", "left_anti").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def active_generation_join(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


@query(
    """WITH g AS (SELECT l_suppkey % 5 AS project_id, l_linenumber AS generation_id, l_orderkey FROM lineitem), a AS (SELECT project_id, max(generation_id) AS generation_id FROM g GROUP BY project_id)
    SELECT g.project_id, g.generation_id, count(*) AS n FROM g JOIN a ON g.project_id = a.project_id AND g.generation_id = a.generation_id GROUP BY ALL"""
)
def active_generation_scan(t: Tables) -> DataFrame:
    g = _generations(t)
    return joins.active_only(g, _active(g)).groupBy("project_id", "generation_id").agg(F.count("*").alias("n"))


def _generations(t: Tables) -> DataFrame:
    return t.lineitem.select((F.col("l_suppkey") % 5).alias("project_id"), F.col("l_linenumber").alias("generation_id"), "l_orderkey")


def _active(g: DataFrame) -> DataFrame:
    return g.groupBy("project_id").agg(F.max("generation_id").alias("generation_id"))


@query(
    """WITH g AS (SELECT l_suppkey % 5 AS project_id, l_linenumber AS generation_id FROM lineitem), a AS (SELECT project_id, max(generation_id) AS m FROM g GROUP BY project_id)
    SELECT project_id, generation_id, count(*) AS n FROM g JOIN a USING (project_id) WHERE generation_id NOT IN (m, m - 1) GROUP BY ALL"""
)
def generation_cleanup(t: Tables) -> DataFrame:
    g = _generations(t)
    a = _active(g)
    kept = a.select("project_id", (F.col("generation_id") - 1).alias("generation_id"))
    return joins.generation_cleanup(g, a, kept).groupBy("project_id", "generation_id").agg(F.count("*").alias("n"))


@query(
    """WITH o AS (SELECT doc_id, n_chars AS mtime, n_chars AS size FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS mtime, n_chars AS size FROM documents WHERE doc_id % 4 <> 0)
    SELECT coalesce(o.doc_id, n.doc_id) AS path, CASE WHEN o.doc_id IS NULL THEN 'new' WHEN n.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS state FROM o FULL JOIN n ON o.doc_id = n.doc_id
    WHERE o.doc_id IS NULL OR n.doc_id IS NULL OR n.mtime > o.mtime OR n.size <> o.size"""
)
def manifest_diff(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"))
    old = d.where("path % 3 <> 0").withColumn("mtime", F.col("size"))
    new = d.where("path % 4 <> 0").withColumn("mtime", F.col("size") + F.when(F.col("path") % 5 == 0, 1).otherwise(0))
    return joins.manifest_diff(old, new)


@query("SELECT event_id, user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_wins(t: Tables) -> DataFrame:
    return joins.latest(t.events, "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("event_id", "user_id", "event_type", "value")


@query(
    """SELECT l_suppkey % 40 AS from_id, l_partkey % 40 AS to_id, l_returnflag AS edge_type, max(l_quantity) AS weight, max(CASE WHEN l_tax > 0.02 THEN {'s': l_orderkey * 10 + l_linenumber, 'e': l_linestatus} END).e AS evidence
    FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY ALL"""
)
def edge_upsert_merge(t: Tables) -> DataFrame:
    e = t.lineitem.select(
        (F.col("l_suppkey") % 40).alias("from_id"), (F.col("l_partkey") % 40).alias("to_id"), F.col("l_returnflag").alias("edge_type"), F.col("l_quantity").alias("weight"),
        F.when(F.col("l_tax") > 0.02, F.col("l_linestatus")).alias("evidence"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return joins.merged_edges(e)


@query(
    """WITH a AS (SELECT 'src' || i AS retired, 'src' || (i // 2) AS target FROM range(10, 20) r(i)), d AS (SELECT doc_id, coalesce(target, source) AS project_id FROM documents LEFT JOIN a ON source = retired)
    SELECT project_id, count(*) AS n FROM d GROUP BY project_id"""
)
def project_rename(t: Tables) -> DataFrame:
    a = t.spark.range(10, 20).select(F.concat(F.lit("src"), F.col("id").cast("string")).alias("retired"), F.concat(F.lit("src"), F.floor(F.col("id") / 2).cast("string")).alias("target"))
    return joins.renamed_projects(t.documents.select("doc_id", F.col("source").alias("project_id")), a).groupBy("project_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND source = 'src3'")
def conjunctive_filter(t: Tables) -> DataFrame:
    return t.documents.where(filters.conjunction(lang=["en", "de"], source="src3", least={"n_chars": 500})).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'erst') OR contains(lower(text), 'ouble')")
def token_filter(t: Tables) -> DataFrame:
    return t.documents.where(filters.any_token(F.col("text"), "erst, ouble!")).select("doc_id")


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) > 50")
def json_path_filter(t: Tables) -> DataFrame:
    return t.events.where(F.get_json_object("props", "$.k").cast("int") > 50).select("event_id")


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^[^/]*/+([^/]*/)*[^/]*\\.html$|^https?://.*$') AND NOT regexp_matches(url, '7')")
def glob_filter(t: Tables) -> DataFrame:
    return t.pages.where(filters.globbed(F.col("url"), ["**"], ["**7**"])).select("page_id")


_PATHS = ("pkg/.env.local", "secrets.json", "certs/a.PEM", "k.p12", "id_rsa", "src/x.ts", "store.keystore", "a/secrets.yaml", "sig.asc", "a/node_modules/x.js", "x.d.ts", "lib/a.test.ts", "a/b.min.js", "docs/y.md", "dist/z", ".env", "src/env.ts")


def paths(t: Tables) -> DataFrame:
    """A path for each page: kinds of names in turn, below the page's host but for those that have to stand first."""
    name = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("page_id") % len(_PATHS) + 1).cast("int"))
    return t.pages.select("page_id", F.when(F.col("page_id") % 2 == 0, name).otherwise(F.concat(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("/"), name)).alias("path"))


_PATHS_SQL = f"p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '' ELSE regexp_extract(url, '^https?://([^/]+)', 1) || '/' END || {list(_PATHS)!r}[page_id % {len(_PATHS)} + 1] AS path FROM pages)"


@query(f"WITH {_PATHS_SQL} SELECT page_id, regexp_matches(lower(path), '\\.env|\\.(key|pem|p12|pfx|keystore|asc)$|^secrets?\\.|^id_rsa') AS secret FROM p")
def secret_path_filter(t: Tables) -> DataFrame:
    return paths(t).select("page_id", filters.is_secret_path(F.col("path")).alias("secret"))


@query(
    f"""WITH {_PATHS_SQL} SELECT page_id, regexp_matches(path, '(^|/)(node_modules|\\.git|dist|build|coverage|generated|__tests__|tests|benchmarks|fixtures)/')
      OR regexp_matches(path, '(^|/)(\\.env(\\.[^/]*)?|[^/]*\\.(generated|min)\\.[^/]*|[^/]*\\.d\\.ts|[^/]*\\.(test|spec)\\.(ts|tsx|js|jsx)|[^/]*\\.wasm[^/]*|[^/]*\\.map|lock\\.yaml|pnpm-lock\\.yaml|package-lock\\.json|bun\\.lockb|yarn\\.lock)$') AS ignored FROM p"""
)
def capture_policy(t: Tables) -> DataFrame:
    return paths(t).select("page_id", filters.is_ignored(F.col("path")).alias("ignored"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' OR user_id % 3 = 1")
def tag_containment(t: Tables) -> DataFrame:
    return filters.tagged(tagged_events(t), ["click", "u1"]).select("id")


def tagged_events(t: Tables) -> DataFrame:
    tags = F.array("event_type", F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    return t.events.select(F.col("event_id").alias("id"), tags.alias("tags"), F.col("ts").alias("created_at"), F.col("user_id").alias("session_id"))


@query("SELECT event_id AS id FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-10' AND event_id <> 7 AND user_id IN (1, 2, 3, 4, 5) ORDER BY ts DESC, event_id LIMIT 25")
def recent_by_tag(t: Tables) -> DataFrame:
    return filters.recent_by_tag(tagged_events(t), "click", F.lit("2024-01-10").cast("timestamp_ntz"), 25, exclude=7, session_id=[1, 2, 3, 4, 5])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 77")
def point_lookup(t: Tables) -> DataFrame:
    return filters.by_id(t.orders, "o_orderkey", 77).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT * FROM (SELECT 'imports' AS scan, l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey = 3 UNION ALL SELECT 'importers', l_suppkey, l_partkey FROM lineitem WHERE l_partkey = 3)")
def import_scans(t: Tables) -> DataFrame:
    e = t.lineitem.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return symbols.imports_of(e, 3).select(F.lit("imports").alias("scan"), "src", "dst").unionByName(symbols.importers_of(e, 3).select(F.lit("importers").alias("scan"), "src", "dst"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS \"props.k\", event_type FROM events")
def field_projection(t: Tables) -> DataFrame:
    return filters.projected(t.events, ["event_id", "props.k", "event_type", "nothing", "event_type.x.y"]).select("event_id", "`props.k`", "event_type")


@query("SELECT doc_id, n_chars, count(*) OVER () AS total FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 15")
def limited_with_total(t: Tables) -> DataFrame:
    return filters.page(t.documents.where("lang = 'fr'").select("doc_id", "n_chars"), [F.col("n_chars").desc(), F.col("doc_id")], 15)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 45")
def union_distinct(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")).union(t.lineitem.where("l_quantity > 45").select("l_orderkey")).distinct()


@query("SELECT id, max(s) AS score FROM (SELECT l_orderkey AS id, l_quantity AS s FROM lineitem UNION ALL SELECT o_orderkey, o_totalprice / 10000 FROM orders) GROUP BY id")
def merge_keep_max(t: Tables) -> DataFrame:
    a = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("score"))
    return a.unionByName(t.orders.select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 10000).alias("score"))).groupBy("id").agg(F.max("score").alias("score"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def batch_lookup(t: Tables) -> DataFrame:
    ids = t.lineitem.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.join(ids, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n AS line_no, line FROM l WHERE n BETWEEN 2 AND 4")
def ranged_read(t: Tables) -> DataFrame:
    return filters.line_range(t.documents, "doc_id", "text", 2, 4)


_FILES = "(SELECT doc_id, source || '/' || lang || CASE WHEN doc_id % 7 = 0 THEN '/__tests__/' WHEN doc_id % 7 = 1 THEN '/Spec/' ELSE '/src/' END || 'f' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.test.ts' ELSE '.ts' END AS path FROM documents)"


def source_paths(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    folder = F.when(n % 7 == 0, "/__tests__/").when(n % 7 == 1, "/Spec/").otherwise("/src/")
    return t.documents.select("doc_id", F.concat("source", F.lit("/"), "lang", folder, F.lit("f"), n.cast("string"), F.when(n % 5 == 0, ".test.ts").otherwise(".ts")).alias("path"))


@query(f"SELECT doc_id, path FROM {_FILES} WHERE regexp_matches(path, '(?i)(?:^|/)(?:__tests__|tests?|spec)/|[.](?:test|spec)[.][a-z]+$')")
def test_files(t: Tables) -> DataFrame:
    return source_paths(t).where(filters.is_test_file(F.col("path")))


@query(f"SELECT doc_id, path, 1::BIGINT AS downgraded FROM {_FILES} WHERE path LIKE '%/en/%' OR path LIKE '%/de/%'")
def checked_globs(t: Tables) -> DataFrame:
    """Paths by patterns that were checked first: one is in both lists and counts as included."""
    include, exclude, both = filters.checked_patterns(["**/en/**", "**/de/**"], ["**/de/**", "**/fr/**"])
    rows = source_paths(t)
    return rows.where(filters.globbed(F.col("path"), include, exclude)).withColumn("downgraded", F.lit(len(both)).cast("long"))
