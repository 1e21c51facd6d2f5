"""Operators that SQL cannot express, against plain Python, and awkward rows."""

import random
from collections import Counter, defaultdict
from datetime import UTC, datetime
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.functions import text
from tessera.functions import vectors as V
from tessera.operators import aggregates, events, filters, graph, joins, lexical, memory, ranking, symbols, vector


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), min_size=1, max_size=6).map(lambda x: sorted(set(x))), min_size=2, max_size=4))
def test_min_span(positions):
    assert lexical.min_span(positions) == min(max(c) - min(c) for c in product(*positions))


def test_proximity_parts():
    assert lexical.min_span([[3]]) == 0 and lexical.min_span([]) == float("inf")
    assert lexical.adjacent_pairs([[0, 50], [5, 100]], ["ab", "cd"], 30) == 1
    assert lexical.proximity_boost("alpha beta", "Alpha", False, ["alpha", "beta"]) == pytest.approx(0.15 + 1 / (1 + 6 / 10) + 0.125)
    assert lexical.sanitized("the (and) of") == ["the", "and"] and lexical.sanitized("ab") == []
    assert lexical.phrase_query("a b", ["a b", 'c "d"']) == '"a b" OR "c d"'


def test_proximity_rerank_runs(spark):
    rows = [(1, "red fox", i, s, t, None, False) for i, s, t in [(1, 0.9, "nothing"), (2, 0.895, "red fox"), (3, 0.885, "red fox"), (4, 0.5, None)]]
    hits = spark.createDataFrame(rows, "query_id long, query string, id long, score double, content string, title string, is_code boolean")
    got = [r.id for r in lexical.proximity_rerank(hits).orderBy("rank").collect()]
    assert got == [2, 1, 3, 4]  # 3 is more than 0.01 from the head of its run


def test_knn_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.9, 0.1]), (6, [1.0, 0.0]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, embedding array<float>")
    rows = [(r.vec_id, r.score) for r in vector.knn(asked, corpus, 3).orderBy("rank").collect()]
    assert rows == [(1, 1.0), (6, 1.0), (5, pytest.approx(0.993884))]
    assert vector.knn(asked, corpus.where("false"), 3).count() == 0 and vector.knn(asked.where("false"), corpus, 3).count() == 0
    c = corpus.select("vec_id", V.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0))).alias("c"))
    assert {r.vec_id: r.c for r in c.collect()}[2] == 0.0


def test_similar_pairs_in_tiles(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, i % 2 if i else None, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(120)]
    items = spark.createDataFrame(rows, "vec_id long, g long, embedding array<float>")
    want = set()
    for i, g, u in rows:
        for j, h, v in rows:
            nu, nv = sum(x * x for x in u) ** 0.5, sum(x * x for x in v) ** 0.5
            if i < j and g == h and g is not None and nu and nv and sum(x * y for x, y in zip(u, v, strict=True)) / nu / nv >= 0.99:
                want.add((g, i, j))
    for tile in (4096, 16):
        monkeypatch.setattr(vector, "TILE", tile)
        got = [(r.g, r.a, r.b) for r in vector.similar_pairs(items, "g", 0.99).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def digraph(rng, n, m):
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def reach(edges, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, d in edges:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


def test_strongly_connected(spark):
    rng = random.Random(5)
    edges = []
    for g in range(12):
        edges += [(100 * g + a, 100 * g + b) for a, b in digraph(rng, 8, rng.randrange(4, 14))]
    got = defaultdict(set)
    for r in graph.strongly_connected(spark.createDataFrame(edges, "src long, dst long")).collect():
        got[r.component].add(r.node)
    nodes = {x for e in edges for x in e}
    r = {n: reach([e for e in edges if e[0] // 100 == n // 100], n) for n in nodes}
    want = {min(c): c for n in nodes if n in r[n] for c in [frozenset(m for m in r[n] if n in r[m])]}
    assert {k: frozenset(v) for k, v in got.items()} == want


def test_components_and_empty_graphs(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert graph.components(none).count() == graph.strongly_connected(none).count() == graph.pagerank(none).count() == 0
    chain = spark.range(60).selectExpr("id + 1 src", "id dst")
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_pagerank_parallel_edges(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 4), (3, 1)], "src long, dst long")
    rank = {r.node: r.rank for r in graph.pagerank(e).collect()}
    assert max(rank.values()) == 1.0 and rank[2] > rank[3] > rank[4] > 0


def test_shortest_path(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (4, 3), (1, 5), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10)], "src long, dst long")
    assert graph.shortest_path(e, 1, 4) == [1, 2, 3, 4] and graph.shortest_path(e, 1, 1) == [1]
    assert graph.shortest_path(e, 1, 10) is None and graph.shortest_path(e, 1, 77) is None


def test_louvain_two_cliques(spark):
    edges = [(a + o, b + o) for o in (0, 10) for a in range(5) for b in range(a)] + [(0, 10)]
    found = {r.node: r.community for r in graph.communities(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[n] for n in range(5)} == {0} and {found[n] for n in range(10, 15)} == {10}
    assert graph.communities(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_modularity_of_one_group(spark):
    e = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    row = graph.modularity(e, graph.nodes(e).withColumn("community", F.lit(1))).first()
    assert (row.modularity, row.modularity_half) == (0.0, 0.25)


def test_ttl_dedup(spark):
    rows = [(k, i, 1_700_000_000 + s) for i, (k, s) in enumerate([("a", 0), ("a", 30), ("a", 60), ("a", 119), ("a", 120), ("b", 10), ("b", 10), (None, 5)])]
    df = spark.createDataFrame(rows, "k string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.event_id for r in events.ttl_dedup(df, "k", 60).collect()) == [0, 2, 4, 5]


def test_percentiles_match_sorting(spark):
    rng = random.Random(2)
    data = [(g, rng.choice([None, *range(20)])) for g in "ab" for _ in range(101)] + [("c", 7), ("d", None)]
    got = {r.g: r for r in aggregates.percentiles(spark.createDataFrame(data, "g string, v long"), ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for g in "abc":
        vs = sorted(v for k, v in data if k == g and v is not None)
        assert (got[g].n, got[g].p50, got[g].p95) == (len(vs), vs[int(len(vs) * 0.5)], vs[min(len(vs) - 1, int(len(vs) * 0.95))])
    assert "d" not in got


def test_longest_prefix_ties(spark):
    roots = spark.createDataFrame([("/a", 1), ("/a/b", 2), ("/a/b", 3), ("/c", 4), ("/c", 4)], "root string, project_id long")
    rows = spark.createDataFrame([(1, "/a/x"), (2, "/a/b/y"), (3, "/c"), (4, "/cc"), (5, None)], "id long, path string")
    assert {r.id: r.project_id for r in joins.longest_prefix(rows, "path", "id", roots).collect()} == {1: 1, 3: 4}


def test_overlapping_and_manifest(spark):
    rng = random.Random(1)
    make = lambda n: [(i, "f", s := rng.randrange(500), s + rng.randrange(200)) for i in range(n)]
    a, b = make(60), make(60)
    cols = "id long, file string, line_start long, line_end long"
    got = Counter((r.a_id, r.b_id) for r in joins.overlapping(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), "file", 3).collect())
    assert got == Counter((x[0], y[0]) for x in a for y in b if x[2] <= y[3] + 3 and y[2] - 3 <= x[3])
    old, new = spark.createDataFrame([("a", 1, 1), ("b", 1, 1), ("c", 1, 1)], "path string, mtime long, size long"), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], "path string, mtime long, size long")
    assert {(r.path, r.state) for r in joins.manifest_diff(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "new")}


def test_keep_rule(spark):
    pairs = spark.createDataFrame([(1, 1, 2, 0.99), (1, 2, 3, 0.98), (1, 3, 4, 0.97)], "block long, a long, b long, score double")
    m = spark.createDataFrame([(1, 0.5, 1), (2, 0.5, 2), (3, 0.9, 0), (4, 0.1, 9)], "id long, importance double, access_count long")
    assert [(r.keep_id, r.remove_id) for r in memory.keep_rule(pairs, m).orderBy("remove_id").collect()] == [(2, 1), (3, 2), (3, 4)]


def test_definitions_are_ranked_once_a_file_and_name(spark):
    """References of one file share their candidates; before, each candidate was sorted once for each reference."""
    from tessera.operators import symbols

    rng = random.Random(6)
    defs = [(i, rng.randrange(4), rng.randrange(6)) for i in range(60)]
    refs = [(i, rng.randrange(5), rng.choice([0, 1, 2, None])) for i in range(80)]
    imports = [(rng.randrange(3), rng.randrange(6)) for _ in range(6)]
    rank = {f: rng.randrange(3) / 2 for f in range(5)}
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    out = symbols.go_to_definition(make(defs, "id long, name long, file long"), make(refs, "ref_id long, name long, file long"), make(imports, "src long, dst long"), make(list(rank.items()), "file long, rank double"))
    want = set()
    for r, name, file in refs:
        mine = [(-(2 if f == file else 1 if (file, f) in imports else 0), -rank.get(f, 0.0), i) for i, n, f in defs if n == name]
        want |= {(r, x[-1], n + 1) for n, x in enumerate(sorted(mine))}
    got = [tuple(x) for x in out.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "windowspecdefinition(ref_id" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_queries_meet_items_in_bounded_pieces(monkeypatch, spark):
    """All queries met a batch at once, and an executor's memory grew with them; ties at the edge still go to the smaller id."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 3)))
    x[0] = 1.0
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    asked = frame.where("vec_id % 5 = 0").withColumnRenamed("vec_id", "query_id")
    norm = np.linalg.norm(x, axis=1)
    unit = x / np.where(norm > 0, norm, 1)[:, None]
    score = np.round(np.clip(unit @ unit.T, 0, 1), 6)
    want = {(i, j, n + 1) for i in range(0, 300, 5) for n, j in enumerate(sorted(range(300), key=lambda j: (-score[i, j], j))[:4])}
    monkeypatch.setattr(vector, "MET", 7)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in vector.knn(asked, frame, 4).collect()} == want
    found = vector.Index(frame, lists=4).search(asked, 4, probes=4)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in found.collect() if norm[r.query_id]} == {w for w in want if norm[w[0]]}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_decay_edges(spark):
    now = F.lit("2024-02-01").cast("timestamp")
    rows = [(1, None, None, None, False), (2, 2.0, 3, "2024-03-01", False), (3, 0.7, 0, "2023-01-01", True), (4, float("nan"), -5, "2024-01-31", None)]
    m = spark.createDataFrame(rows, "id long, importance double, access_count long, c string, pinned boolean").withColumn("created_at", F.col("c").cast("timestamp")).withColumn("last_accessed", F.lit(None).cast("timestamp"))
    assert [round(r[0], 6) for r in m.orderBy("id").select(memory.decay(now)).collect()] == [0.0, 1.0, 0.7, 0.0]


def test_working_set(spark):
    hits = spark.createDataFrame([(1, 1, "a", 0.9, 50), (1, 2, "a", 0.8, 10), (1, 3, "b", 0.7, 60), (1, 4, "c", 0.6, 40)], "query_id long, id long, file string, score double, tokens long")
    assert [(r.id, r["pass"], r.used) for r in ranking.working_set(hits, 100).orderBy("used").collect()] == [(1, 1, 50), (4, 1, 90), (2, 2, 100)]


def test_globs():
    cases = {"src/**/*.ts": ("src/a/b.ts", "src/b.ts"), "*.{js,ts}": ("a.ts", "a.js"), "a?c": ("abc",), "**": ("x/y",)}
    import re

    for glob, paths in cases.items():
        assert all(re.match(filters.glob_regex(glob), p) for p in paths)
    assert not re.match(filters.glob_regex("*.ts"), "a/b.ts") and not re.match(filters.glob_regex("src/*.ts"), "src/a/b.ts")
    assert filters.checked_patterns(["a"], ["a", "b"]) == (["a"], ["b"], ["a"])
    for bad in ((["x"] * 33, []), (["a"], [""])):
        with pytest.raises(ValueError):
            filters.checked_patterns(*bad)


def test_next_run():
    at = lambda *a: datetime(*a, tzinfo=UTC)
    assert text.next_run("*/15 9-17 * * 1-5", at(2024, 1, 5, 17, 50)) == at(2024, 1, 8, 9, 0)
    assert text.next_run("0 0 1 * *", at(2024, 1, 1)) == at(2024, 2, 1)
    assert text.next_run("0 0 * * 7", at(2024, 1, 1)) == at(2024, 1, 7)
    with pytest.raises(ValueError):
        text.next_run("0 0 31 2 *", at(2024, 1, 1))


def test_chunkers():
    md = "intro\n# A\none\n```\n# no heading\n```\n## B\ntwo\n# C"
    assert [(a, b, c) for a, b, c, _ in text.markdown_sections(md)] == [(1, 1, ""), (2, 6, "A"), (7, 8, "A > B"), (9, 9, "C")]
    code = "import x\n\nfunction a() {\n}\n\nclass B {\n}\n"
    assert [(a, b, n) for a, b, n, _ in text.code_chunks(code)] == [(1, 2, "imports"), (3, 5, "a"), (6, 8, "B")]
    assert text.chunk_of("a.json", '{"a":1,"b":2,"c":3,"d":4,"e":{"f":5}}')[4][3] == '{"e": {"f": 5}}'
    assert [c[2] for c in text.chunk_of("a.yaml", "a: 1\n  x: 2\nb: 3")] == ["a", "b"]
    assert text.json_paths('{"a": [1, {"b": "c"}], "d": {}}') == [("a[0]", "1"), ("a[1].b", "c"), ("d", "{}")] and text.json_paths("{") == []
    assert text.html_to_markdown("<h1>T</h1><p>a <b>b</b></p><ul><li>x<li><a href='/y'>y</a></ul><script>z</script>") == "# T\n\na **b**\n\n- x\n- [y](/y)".replace("\n\n- x", "\n- x")
    assert text.html_to_markdown(None) == "" and text.chunk_of("x", None) == [(1, 1, "", "")]


def test_import_targets_and_common_prefix(spark):
    rows = spark.createDataFrame([(1, "a/b/c.ts"), (1, "a/b/d/e.ts"), (2, "x.ts"), (3, "p/q/r"), (3, "s/q/r")], "g long, path string")
    assert {r.g: r.prefix for r in symbols.common_prefix(rows, "g", "path").collect()} == {1: "a/b", 2: "", 3: ""}


def test_empty_inputs(spark):
    hits = spark.createDataFrame([], "query_id long, id long, score double, content string, file string, created_at timestamp, access_count long, vector_score double")
    assert ranking.fuse([ranking.stream(hits, "vector"), ranking.stream(hits, "lexical")]).count() == 0
    for out in (ranking.diversity(hits), ranking.spectrum(hits), ranking.attention(hits, F.current_timestamp()), ranking.file_cap(hits, "file", 2, 5)):
        assert out.count() == 0
    assert lexical.prefix_search(spark.createDataFrame([(1, None)], "doc_id long, text string"), "abc", 5).count() == 0
    assert lexical.term_coverage(spark.createDataFrame([(1, None)], "doc_id long, text string"), "", 5).count() == 0
