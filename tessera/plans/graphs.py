"""Graph queries over all lines, which make edges between suppliers and parts, and over links between parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph
from tessera.plans.registry import Tables, query
from tessera.session import cut

#: Suppliers have ids from 0 on and parts below zero; odd lines lead from suppliers to parts, even ones back.
_LINES = "CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey ELSE -1 - l_partkey END AS src, CASE WHEN l_linenumber % 2 = 1 THEN -1 - l_partkey ELSE l_suppkey END AS dst"
_BIP = f"e AS (SELECT {_LINES} FROM lineitem)"
_TRADE = f"e AS (SELECT DISTINCT {_LINES} FROM lineitem)"
_W = f"e AS (SELECT {_LINES}, max(l_quantity) / 51 AS weight FROM lineitem GROUP BY 1, 2)"
_SUPPLY = "e AS (SELECT DISTINCT l_suppkey AS src, -1 - l_partkey AS dst FROM lineitem)"
#: Suppliers and parts of a day, and of a month, are nodes of their own, so that there are many components.
_DAY = "date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE))"
_DAILY = f"e AS (SELECT DISTINCT l_suppkey * 16384 + {_DAY} AS src, -1 - (l_partkey * 16384 + {_DAY}) AS dst FROM lineitem)"
_TERM = "((year(l_shipdate) - 1992) * 12 + month(l_shipdate))"
_TERMS = f"e AS (SELECT DISTINCT CASE WHEN l_linenumber % 2 = 1 THEN s ELSE p END AS src, CASE WHEN l_linenumber % 2 = 1 THEN p ELSE s END AS dst FROM (SELECT l_linenumber, l_suppkey * 128 + {_TERM} AS s, -1 - (l_partkey * 128 + {_TERM}) AS p FROM lineitem))"
_LINKS = """n AS (SELECT max(p_partkey) AS n FROM part), e AS (SELECT DISTINCT src, dst, kind FROM (SELECT p_partkey AS src, 1 + (p_partkey * 37 + p_size * 101) % n AS dst, ['call', 'data_flow', 'http_call'][1 + p_size % 3] AS kind FROM part, n
      UNION ALL SELECT p_partkey, 1 + (p_partkey * 11 + 7) % n, 'call' FROM part, n WHERE p_size % 2 = 0))"""


def trade(t: Tables) -> DataFrame:
    odd = F.col("l_linenumber") % 2 == 1
    supplier, part = F.col("l_suppkey"), -1 - F.col("l_partkey")
    return t.lineitem.select(F.when(odd, supplier).otherwise(part).alias("src"), F.when(odd, part).otherwise(supplier).alias("dst"), (F.col("l_quantity") / 51).alias("weight"))


def supply(t: Tables) -> DataFrame:
    """Every line's supplier and part: real ids, suppliers from 0 on and parts below zero."""
    lines = t.lineitem.select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    return cut(lines.repartition(graph.tasks(lines), "src", "dst").distinct())


def daily(t: Tables) -> DataFrame:
    """:func:`supply` of each day for itself, an edge for each line."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return t.lineitem.select((F.col("l_suppkey") * 16384 + day).alias("src"), (-1 - (F.col("l_partkey") * 16384 + day)).alias("dst"))


def monthly(t: Tables) -> DataFrame:
    """:func:`trade` of every month for itself."""
    term = (F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")
    odd, s, p = F.col("l_linenumber") % 2 == 1, F.col("l_suppkey") * 128 + term, -1 - (F.col("l_partkey") * 128 + term)
    return t.lineitem.select(F.when(odd, s).otherwise(p).alias("src"), F.when(odd, p).otherwise(s).alias("dst"))


def part_links(t: Tables) -> DataFrame:
    """``src, dst, kind``: one link from each part, and a second from those of even size."""
    n = F.lit(t.part.agg(F.max("p_partkey")).first()[0] or 1)
    kind = F.element_at(F.array(*map(F.lit, ("call", "data_flow", "http_call"))), F.col("p_size") % 3 + 1)
    one = t.part.select(F.col("p_partkey").alias("src"), (1 + (F.col("p_partkey") * 37 + F.col("p_size") * 101) % n).alias("dst"), kind.alias("kind"))
    two = t.part.where("p_size % 2 = 0").select(F.col("p_partkey").alias("src"), (1 + (F.col("p_partkey") * 11 + 7) % n).alias("dst"), F.lit("call").alias("kind"))
    return one.unionByName(two).distinct()


def _pagerank_sql(rounds: int = 20) -> str:
    steps = "".join(
        f""", r{i + 1} AS (SELECT n.node, 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(g.s, 0) AS rank FROM n LEFT JOIN
        (SELECT w.dst, sum(w.share * r{i}.rank) AS s FROM w JOIN r{i} ON w.src = r{i}.node GROUP BY w.dst) g ON g.dst = n.node)"""
        for i in range(rounds)
    )
    return f"""WITH {_BIP}, n AS (SELECT DISTINCT node FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)), c AS (SELECT src, dst, count(*) AS k FROM e WHERE src <> dst GROUP BY src, dst),
    w AS MATERIALIZED (SELECT src, dst, k / sum(k) OVER (PARTITION BY src) AS share FROM c), r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n){steps}
    SELECT node, round(rank / (SELECT max(rank) FROM r{rounds}), 6) AS rank FROM r{rounds}"""


@query(_pagerank_sql())
def pagerank(t: Tables) -> DataFrame:
    return graph.pagerank(trade(t), tolerance=0.0).select("node", F.round("rank", 6).alias("rank"))


def _components_sql(rounds: int = 12) -> str:
    """Smallest labels that spread for more rounds than any path in the tables' graph takes."""
    steps = "".join(f", l{i + 1} AS MATERIALIZED (SELECT l.node, least(l.label, min(m.label)) AS label FROM l{i} l JOIN b ON b.src = l.node JOIN l{i} m ON m.node = b.dst GROUP BY l.node, l.label)" for i in range(rounds))
    return f"""WITH {_DAILY}, b AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS label FROM b){steps}
    SELECT node, label AS {{name}} FROM l{rounds}"""


@query(_components_sql().format(name="component"))
def connected_components(t: Tables) -> DataFrame:
    return graph.components(daily(t))


@query(
    f"""WITH RECURSIVE {_TERMS}, r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)
    SELECT x.src AS node, min(least(x.src, x.dst)) AS component FROM r x JOIN r y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src"""
)
def cycles_scc(t: Tables) -> DataFrame:
    return graph.strongly_connected(monthly(t))


@query(
    f"""WITH RECURSIVE {_TRADE}, r AS (SELECT DISTINCT src AS node, 0 AS hop FROM e WHERE src BETWEEN 0 AND 3 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON r.node = e.src WHERE r.hop < 3 AND e.src <> e.dst)
    SELECT node, CAST(min(hop) AS BIGINT) AS hop FROM r GROUP BY node"""
)
def min_hop(t: Tables) -> DataFrame:
    e = trade(t)
    return graph.hops(e, e.where("src between 0 and 3").select(F.col("src").alias("node")), 3).withColumn("hop", F.col("hop").cast("long"))


@query(
    f"""WITH RECURSIVE {_TRADE}, d AS (SELECT dst AS node, count(*) AS k FROM e GROUP BY dst), c AS (SELECT node, k / (SELECT max(k) FROM d) AS rank FROM d),
    r AS (SELECT DISTINCT dst AS node, 0 AS hop FROM e WHERE dst BETWEEN 0 AND 3 UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON r.node = e.dst WHERE r.hop < 2 AND e.src <> e.dst), m AS (SELECT node, min(hop) AS hop FROM r GROUP BY node)
    SELECT m.node, CAST(hop AS BIGINT) AS depth, round(0.6 * coalesce(rank, 0) + 0.4 / hop, 4) AS risk FROM m LEFT JOIN c ON m.node = c.node WHERE hop > 0 ORDER BY risk DESC, node LIMIT 100"""
)
def impact_bfs(t: Tables) -> DataFrame:
    e = trade(t).select("src", "dst").distinct()
    degree = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"))
    rank = degree.crossJoin(degree.agg(F.max("k").alias("m"))).select("node", (F.col("k") / F.col("m")).alias("rank"))  # the maximum is one row
    return graph.impact(e, e.where("dst between 0 and 3").select(F.col("dst").alias("node")), rank)


def weighted(t: Tables) -> DataFrame:
    lines = trade(t)
    return lines.repartition(graph.tasks(lines), "src", "dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


@query(
    f"""WITH RECURSIVE {_W}, p AS (SELECT [src, dst] AS path, CAST(weight AS DOUBLE) AS weight FROM e WHERE src = (SELECT min(l_suppkey) FROM lineitem) AND src <> dst
      UNION ALL SELECT list_append(p.path, e.dst), p.weight * e.weight FROM p JOIN e ON p.path[len(p.path)] = e.src WHERE len(p.path) < 4 AND NOT list_contains(p.path, e.dst))
    SELECT array_to_string(path, '>') AS path, round(weight, 6) AS weight FROM p ORDER BY weight DESC, path LIMIT 10"""
)
def weighted_paths(t: Tables) -> DataFrame:
    first = t.lineitem.agg(F.min("l_suppkey")).first()[0]
    return graph.weighted_paths(weighted(t), F.col("src") == F.lit(first))


_WALK = f"""{_LINKS}, o AS (SELECT * FROM e WHERE kind IN ('call', 'data_flow')), v AS (SELECT 1::BIGINT AS node, 0 AS hop UNION SELECT o.dst, v.hop + 1 FROM v JOIN o ON o.src = v.node WHERE v.hop < 4 AND o.src <> o.dst),
    m AS (SELECT node, min(hop) AS hop FROM v GROUP BY node), w AS (SELECT DISTINCT o.src, o.dst FROM o JOIN m ON m.node = o.src WHERE m.hop < 4)"""


@query(f"WITH RECURSIVE {_WALK} SELECT node, CAST(hop AS BIGINT) AS hop FROM m")
def trace_nodes(t: Tables) -> DataFrame:
    e = part_links(t)
    seeds = t.spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.traced(e, seeds, "data_flow", depth=4)[0].select("node", F.col("hop").cast("long").alias("hop"))


@query(
    f"""WITH RECURSIVE {_WALK}, c AS (SELECT [src, dst] AS path, src = dst AS cycle FROM w WHERE src = 1 UNION ALL SELECT list_append(c.path, w.dst), list_contains(c.path, w.dst) FROM c JOIN w ON w.src = c.path[len(c.path)] WHERE NOT c.cycle)
    SELECT array_to_string(path, ' → ') || CASE WHEN cycle THEN '↺' ELSE '' END AS chain FROM c WHERE cycle OR path[len(path)] NOT IN (SELECT src FROM w) ORDER BY chain LIMIT 50"""
)
def trace_chains(t: Tables) -> DataFrame:
    seeds = t.spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.chains(graph.traced(part_links(t), seeds, "data_flow", depth=4)[1], seeds)


@query()
def louvain(t: Tables) -> DataFrame:
    return graph.communities(supply(t))


@query(_components_sql().format(name="community"))
def label_propagation(t: Tables) -> DataFrame:
    """Labels that start at components stay there, so that the components are the answer."""
    return graph.fallback_communities(daily(t))


@query(
    f"""WITH {_SUPPLY}, b AS MATERIALIZED (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT DISTINCT src AS node, src % 16 AS label FROM b),
    l1 AS (SELECT node, label FROM (SELECT b.src AS node, l0.label, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, l0.label) AS n FROM b JOIN l0 ON l0.node = b.dst GROUP BY b.src, l0.label) WHERE n = 1),
    l2 AS (SELECT node, label FROM (SELECT b.src AS node, l1.label, row_number() OVER (PARTITION BY b.src ORDER BY count(*) DESC, l1.label) AS n FROM b JOIN l1 ON l1.node = b.dst GROUP BY b.src, l1.label) WHERE n = 1)
    SELECT node, label AS community FROM l2"""
)
def label_sweeps(t: Tables) -> DataFrame:
    e = supply(t)
    return graph.label_propagation(e, graph.nodes(e).withColumn("label", F.col("node") % 16), rounds=2)


@query(
    f"""WITH {_SUPPLY}, g AS (SELECT src, dst, src % 4 AS ca, dst % 4 AS cb FROM e WHERE src <> dst), d AS (SELECT c, count(*) AS k FROM (SELECT ca AS c FROM g UNION ALL SELECT cb FROM g) GROUP BY c),
    x AS (SELECT (SELECT count(*) FROM g) AS m, (SELECT count(*) FROM g WHERE ca = cb) AS i, (SELECT sum(k * k) FROM d) AS k2)
    SELECT round((2 * i - k2 / (2 * m)) / (2 * m), 6) AS modularity, round(2 * i / (4 * m) - k2 / (16 * m * m), 6) AS modularity_half FROM x"""
)
def modularity(t: Tables) -> DataFrame:
    e = supply(t)
    return graph.modularity(e, graph.nodes(e).withColumn("community", F.col("node") % 4))


def _related_sql(edges: str, seed: str) -> str:
    return f"""WITH {edges}, b AS (SELECT src, dst, max(weight) AS weight FROM (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e) WHERE weight >= 0.3 AND src <> dst GROUP BY ALL),
    k AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS n FROM b) WHERE n <= 20),
    h1 AS (SELECT dst AS node, max(weight) AS weight FROM k WHERE src = {seed} GROUP BY dst), s1 AS (SELECT node FROM h1 UNION SELECT {seed}),
    h2 AS (SELECT k.dst AS node, max(k.weight) AS weight FROM k JOIN h1 ON h1.node = k.src WHERE k.dst NOT IN (SELECT node FROM s1) GROUP BY k.dst)
    SELECT node, hop, round(weight, 6) AS weight FROM (SELECT node, 1::BIGINT AS hop, weight FROM h1 UNION ALL SELECT node, 2, weight FROM h2) ORDER BY hop, weight DESC, node LIMIT 20"""


@query(_related_sql(_W, "1"))
def related_memories(t: Tables) -> DataFrame:
    seeds = t.spark.range(1, 2).select(F.col("id").alias("node"))
    return graph.related(weighted(t), seeds).select("node", F.col("hop").cast("long").alias("hop"), F.round("weight", 6).alias("weight"))


_KINDS = "t AS (SELECT l_suppkey AS src, -1 - l_partkey AS dst, CASE l_returnflag WHEN 'A' THEN 'DERIVED_FROM' WHEN 'N' THEN 'RELATES_TO' ELSE 'CONTRADICTS' END AS kind, l_discount * 10 AS weight, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)"


def memory_edges(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "DERIVED_FROM").when(F.col("l_returnflag") == "N", "RELATES_TO").otherwise("CONTRADICTS")
    return t.lineitem.select(
        F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), kind.alias("kind"), (F.col("l_discount") * 10).alias("weight"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq")
    )


@query(_related_sql(f"{_KINDS}, e AS (SELECT src, dst, weight FROM t WHERE kind IN ('DERIVED_FROM', 'CAUSES', 'SUPPORTS'))", "2"))
def decision_chain(t: Tables) -> DataFrame:
    seeds = t.spark.range(2, 3).select(F.col("id").alias("node"))
    return graph.decision_chain(memory_edges(t), seeds, depth=2).select("node", F.col("hop").cast("long").alias("hop"), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {_KINDS} SELECT s_name || ' / ' || p_name AS pair, round(weight, 6) AS weight FROM (SELECT * FROM t WHERE kind = 'CONTRADICTS' ORDER BY weight DESC, seq DESC LIMIT 20) t
    JOIN supplier ON s_suppkey = src JOIN part ON p_partkey = -1 - dst"""
)
def contradictions(t: Tables) -> DataFrame:
    texts = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("content")).unionByName(t.part.select((-1 - F.col("p_partkey")).alias("id"), F.col("p_name").alias("content")))
    found = graph.contradictions(memory_edges(t), texts, [F.col("seq").desc()])
    return found.select(F.concat_ws(" / ", "first", "second").alias("pair"), F.round("weight", 6).alias("weight"))


@query(
    f"""WITH {_KINDS}, b AS (SELECT other, arrow, kind, weight FROM (SELECT dst AS other, '→' AS arrow, kind, weight FROM t WHERE src = 3 UNION ALL SELECT src, '←', kind, weight FROM t WHERE dst = 3) WHERE weight >= 0.3),
    f AS (SELECT other, arrow, kind, weight FROM (SELECT *, row_number() OVER (PARTITION BY other ORDER BY weight DESC, arrow, kind) AS n FROM b) WHERE n = 1 ORDER BY weight DESC, other LIMIT 10)
    SELECT 'Related memories:' || chr(10) || string_agg('  ' || arrow || ' [' || lower(replace(kind, '_', ' ')) || '] (part) ' || p_name, chr(10) ORDER BY weight DESC, other) AS summary FROM f JOIN part ON p_partkey = -1 - other"""
)
def neighbourhood_summary(t: Tables) -> DataFrame:
    texts = t.part.select((-1 - F.col("p_partkey")).alias("id"), F.lit("part").alias("type"), F.col("p_name").alias("content"))
    return graph.neighbourhood_summary(memory_edges(t), 3, texts)


_PATH = f"""{_TRADE}, k AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst FROM e UNION SELECT dst, src FROM e) WHERE src <> dst),
    z AS (SELECT (SELECT min(src) FROM e WHERE src > 0) AS a, (SELECT max(src) FROM e) AS b)"""


@query(
    f"""WITH RECURSIVE {_PATH}, r AS (SELECT a AS node, 0 AS hop FROM z UNION SELECT k.dst, r.hop + 1 FROM r JOIN k ON k.src = r.node WHERE r.hop < 5), l AS MATERIALIZED (SELECT node, min(hop) AS hop FROM r GROUP BY node),
    p AS MATERIALIZED (SELECT k.dst AS node, min(k.src) AS parent FROM k JOIN l x ON x.node = k.src JOIN l y ON y.node = k.dst AND y.hop = x.hop + 1 GROUP BY k.dst),
    w AS (SELECT node, hop FROM l JOIN z ON l.node = z.b UNION ALL SELECT p.parent, w.hop - 1 FROM w JOIN p ON p.node = w.node WHERE w.hop > 0)
    SELECT hop AS step, node FROM w"""
)
def shortest_path(t: Tables) -> DataFrame:
    e = trade(t).select("src", "dst")
    a, b = e.agg(F.min(F.when(F.col("src") > 0, F.col("src"))), F.max("src")).first()
    path = [] if a is None else graph.shortest_path(e, a, b) or []
    return t.spark.createDataFrame(list(enumerate(path)), "step int, node long")
