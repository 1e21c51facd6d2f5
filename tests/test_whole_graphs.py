"""Graph queries over all of lineitem, against plain Python."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F
from tessera import queries as core
from tessera.operators import graph


def lineitem(spark, folder, rows):
    """A ``lineitem`` of ``(order, line, part, supplier)`` in ``folder``."""
    table = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long")
    table.selectExpr("*", "timestamp_ntz'1998-05-01' l_shipdate", "CAST(l_orderkey % 50 + 1 AS double) l_quantity").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


DAY = (date(1998, 5, 1) - date(1992, 1, 1)).days


def daily(s, p, day=DAY):
    """A supplier and a part of one day."""
    return s * 16384 + day, -1 - (p * 16384 + day)


def united(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_all_lines(spark, tmp_path):
    rows = [(i, i % 7 + 1, i % 23 + 100 * (i % 4) + 1, i % 11 + 100 * (i % 4)) for i in range(300)] + [(400, 1, 900, 901), (401, 3, 900, 902)]
    got = core.queries()["connected_components"](spark, lineitem(spark, tmp_path, rows)).collect()
    want = united(daily(s, p) for _, _, p, s in rows)
    assert {r.node: r.component for r in got} == want and len(got) == len(want) and len(set(want.values())) == 5


def test_components_of_the_table(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey", "l_shipdate").collect()
    got = core.queries()["connected_components"](spark, sf).collect()
    want = united(daily(s, p, (at.date() - date(1992, 1, 1)).days) for s, p, at in lines)
    assert {r.node: r.component for r in got} == want and len(set(want.values())) > 1000


@pytest.mark.parametrize("name, column", [("connected_components", "component"), ("cycles_scc", "component"), ("label_propagation", "community")])
def test_no_label_covers_all(spark, sf, name, column):
    sizes = [r["count"] for r in core.queries()[name](spark, sf).groupBy(column).count().collect()]
    assert len(sizes) > 20 and len(set(sizes)) > 2


def test_communities_of_all_lines(spark, tmp_path):
    rows = [(i, i % 7 + 1, i * 5 % 23 + 100 * (i % 3) + 1, i * 7 % 11 + 100 * (i % 3)) for i in range(1, 97)]
    folder, parts = lineitem(spark, tmp_path, rows), united((s, -1 - p) for _, _, p, s in rows)
    assert {r.node: r.community for r in core.queries()["label_propagation"](spark, folder).collect()} == united(daily(s, p) for _, _, p, s in rows)
    group = {r.node: r.community for r in core.queries()["louvain"](spark, folder).collect()}
    assert set(group) == set(parts) and all(parts[c] == parts[x] for x, c in group.items())


def tables_of(monkeypatch):
    """Rows of each table that a graph operator stores from here on."""
    rows, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "cut", counted)
    return rows


def test_components_store_finished_ones_once(spark, monkeypatch):
    pairs = [(2 * i, 2 * i + 1) for i in range(500)] + [(2000 + i, 2001 + i) for i in range(64)]
    rows = tables_of(monkeypatch)
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "src long, dst long")).collect()} == united(pairs)
    assert sum(rows) < 4 * 1065


def test_settled_labels_are_not_stored_again(spark, monkeypatch):
    pairs = [(2 * i, 2 * i + 1) for i in range(50)] + [(200 + i, 201 + i) for i in range(9)] + [(7, 7)]
    edges, rows = spark.createDataFrame(pairs, "src long, dst long"), tables_of(monkeypatch)
    parts = {r.node: r.component for r in graph.components(edges).collect()}
    alone = len(rows)
    assert {r.node: r.community for r in graph.fallback_communities(edges).collect()} == parts == united(pairs)
    assert len(rows) == 2 * alone
    start = spark.createDataFrame(list(parts.items()), "node long, label long")
    assert {r.node: r.community for r in graph.label_propagation(edges, start).collect()} == parts


def test_components_of_any_shape(spark):
    rng = random.Random(3)
    shapes = [[(i, rng.randrange(i)) for i in range(1, 80)], [(99, i) for i in range(50)], [(rng.randrange(90), rng.randrange(90)) for _ in range(60)], [(i, (i + 1) % 40) for i in range(40)], [(5, 5), (7, 5), (9, 9)]]
    pairs = [(1000 * i + a, 1000 * i + b) for i, s in enumerate(shapes) for a, b in s]
    got = graph.components(spark.createDataFrame([*pairs, *pairs[:9], (9000, None), (None, None)], "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {**united(pairs), 9000: 9000} and len(got) == len({r.node for r in got})
    words = [(f"n{a}", f"n{b}") for a, b in pairs]
    assert {r.node: r.component for r in graph.components(spark.createDataFrame(words, "src string, dst string")).collect()} == united(words)


def test_a_path_takes_any_neighbour(spark, tmp_path):
    """The one way from supplier 1 to supplier 99 is by the last of its 40 parts; all others end there."""
    rows = [(i, 1, i, 1) for i in range(2, 42)] + [(50, 1, 1, 99), (51, 3, 1, 1)]
    got = core.queries()["shortest_path"](spark, lineitem(spark, tmp_path, rows)).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, -2), (2, 99)]
    hub = spark.createDataFrame([(0, i) for i in range(1, 101)] + [(100, 200)], "src long, dst long")
    assert graph.shortest_path(hub, 0, 200) == [0, 100, 200] and graph.shortest_path(hub, 200, 0) == [200, 100, 0]


WIDE = {
    "label_sweeps": lambda e: graph.label_propagation(e, rounds=2),
    "shortest_path": lambda e: graph.shortest_path(e, 1, 39),
    "related_memories": lambda e: graph.related(e, e.where("src = 1").select(F.col("src").alias("node"))),
    "modularity": lambda e: graph.modularity(e, graph.nodes(e).withColumn("community", F.col("node") % 3)),
}


@pytest.mark.parametrize("name", WIDE)
def test_wide_steps_take_tasks_by_their_edges(spark, monkeypatch, name):
    """Four times the edges make more tasks, and the same results."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(a, b, rng.random()) for a in range(40) for b in rng.sample(range(40), 10)], "src long, dst long, weight double")
    run, plans, cut = WIDE[name], [], graph.cut
    results = lambda x: x if isinstance(x, list) else sorted(map(tuple, x.collect()))
    whole = results(run(edges))

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", seen)
    monkeypatch.setattr(graph, "TASK_ROWS", 40, raising=False)
    assert results(run(edges)) == whole
    assert any(int(n) > 8 for p in plans for n in re.findall(r"RepartitionByExpression \[[^\]]*\], (\d+)", p))


def q_of(pairs, group):
    """Textbook modularity."""
    m, degree, inside = len(pairs), {}, sum(group[a] == group[b] for a, b in pairs)
    for a, b in pairs:
        for x in (group[a], group[b]):
            degree[x] = degree.get(x, 0) + 1
    return inside / m - sum(k * k for k in degree.values()) / (4 * m * m)


def test_communities_find_cliques(spark):
    """A ring of cliques falls into its cliques, each connected, whatever the number of partitions."""
    cliques = [range(10 * i, 10 * i + 6) for i in range(8)]
    pairs = [(a, b) for c in cliques for a in c for b in c if a < b] + [(10 * i, 10 * ((i + 1) % 8) + 1) for i in range(8)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    group = {r.node: r.community for r in graph.communities(edges).collect()}
    want = {x: c[0] for c in cliques for x in c}
    assert q_of(pairs, group) >= 0.95 * q_of(pairs, want)
    assert group == {r.node: r.community for r in graph.communities(edges.repartition(7)).collect()}
    inner = united((a, b) for a, b in pairs if group[a] == group[b])
    assert {x: inner.get(x, x) for x in group} == group


def test_label_sweeps(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]
    got = {r.node: r.community for r in graph.label_propagation(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    label = {x: x for x in near}
    for _ in range(4):
        votes = {x: [label[y] for y in near[x]] for x in near}
        label = {x: min(set(v), key=lambda c: (-v.count(c), c)) for x, v in votes.items()}
    assert got == label


def test_strong_components(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 1), (5, 8)]
    got = {r.node: r.component for r in graph.strongly_connected(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def test_trace_directions_and_tests(spark):
    rows = [("a", "b", "call"), ("b", "c", "data_flow"), ("c", "a", "call"), ("x", "a", "call"), ("b", "t", "call"), ("b", "h", "http_call")]
    edges, seeds = spark.createDataFrame(rows, "src string, dst string, kind string"), spark.createDataFrame([("a",)], "node string")

    def names(**how):
        return {r.node: r.hop for r in graph.traced(edges, seeds, **how)[0].collect()}

    assert names() == {"a": 0, "b": 1, "t": 2}
    assert names(mode="data_flow") == {"a": 0, "b": 1, "c": 2, "t": 2}
    assert names(direction="inbound") == {"a": 0, "c": 1, "x": 1}
    assert names(direction="both", depth=1) == {"a": 0, "b": 1, "c": 1, "x": 1}
    assert names(tests=spark.createDataFrame([("t",), ("a",)], "node string")) == {"a": 0, "b": 1}
    assert names(most=2) == {"a": 0, "b": 1}
    walked = graph.traced(edges, seeds, "data_flow", tests=spark.createDataFrame([("t",)], "node string"))[1]
    assert [r.chain for r in graph.chains(walked, seeds).collect()] == ["a → b → c → a↺"]


def test_rounds_of_moves_shuffle_edges_once(spark, monkeypatch):
    """Edges lie in buckets, so that of the two joins and the groups of a round one alone deals rows of edges."""
    plans, cut = [], graph.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", seen)
    pairs = [(10 * i + a, 10 * i + b) for i in range(6) for a in range(5) for b in range(a)] + [(10 * i, 10 * i + 11) for i in range(5)]
    group = {r.node: r.community for r in graph.communities(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert group == {10 * i + a: 10 * i for i in range(6) for a in range(5)} | {10 * i + 11: 10 * (i + 1) for i in range(5)}
    rounds = [p for p in plans if "Bucketed: true" in p and "links" in p]
    assert rounds
    for p in rounds:
        edge = [x for x in p.splitlines() if "Exchange" in x and re.search(r"hashpartitioning\((src|dst)#\d+L?, \d+\), REPARTITION_BY_NUM", x)]
        assert len(edge) == 1
    assert not spark.catalog.listTables()


def test_ranks_are_joined_where_edges_lie(spark, monkeypatch):
    """A round of PageRank deals sums by target alone: edges lie in buckets by source."""
    plans, cut = [], graph.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(graph, "cut", seen)
    got = {r.node: r["rank"] for r in graph.pagerank(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 2), (3, 3), (4, 2)], "src long, dst long")).collect()}
    assert set(got) == {1, 2, 3, 4} and max(got.values()) == 1.0 and got[4] == min(got.values())
    rounds = [p for p in plans if "Bucketed: true" in p]
    assert rounds and not any(re.search(r"hashpartitioning\(src#", p) for p in rounds)
