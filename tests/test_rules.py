"""Rules on single rows, with answers worked out by hand; and greedy operators against plain walks in order."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera import queries as core
from tessera.functions import text
from tessera.operators import events, filters, joins, lexical, memory, ranking, symbols, vector

PAIR = "similarity double, new_type string, old_type string, new_text string, newer boolean, shared_tags boolean"


@pytest.mark.parametrize(
    "row, want",
    [
        ((0.95, "code", "code", "no longer so", True, False), ("SUPERSEDES", 0.95)),
        ((0.93, "code", "code", "plain", True, False), ("SUPERSEDES", 0.93)),
        ((0.95, "code", "code", "plain", False, False), ("RELATES_TO", 0.76)),
        ((0.5, "code", "pattern", "use B instead of A", True, False), ("CONTRADICTS", 0.8)),
        ((0.4, "code", "pattern", "AVOID this", True, False), None),
        ((0.4, "code", "pattern", "AVOID this", True, True), ("CONTRADICTS", 0.78)),
        ((0.4, "code", "decision", "it was fixed", True, False), ("RESOLVES", 0.75)),
        ((0.4, "code", "code", "it was fixed", True, False), None),
        ((0.4, "code", "code", "based on the old one", True, False), ("DERIVED_FROM", 0.72)),
        ((0.7, "code", "decision", "plain", True, False), ("DERIVED_FROM", 0.76)),
        ((0.7, "pattern", "code", "plain", True, False), ("DERIVED_FROM", 0.76)),
        ((0.7, "decision", "code", "plain", True, False), None),
        ((0.5, "code", "code", "this confirms it", True, False), ("SUPPORTS", 0.75)),
        ((0.8, "pattern", "pattern", "plain", True, False), ("SUPPORTS", 0.74)),
        ((0.8, "code", "code", "not what it was, but fine", True, False), ("RELATES_TO", 0.64)),
        ((0.74, "code", "code", "plain", True, False), None),
    ],
)
def test_relations(spark, row, want):
    got = memory.relation(spark.createDataFrame([row], PAIR)).collect()
    assert [(r.relation, round(r.confidence, 6)) for r in got] == ([] if want is None else [want])


def test_levels(spark):
    cases = [
        ("decision", None, None, None, "orchestrator", 0), ("code", None, "s", None, "orchestrator", 3), ("code", "u", "s", None, "architect", 1), ("critical", None, None, "p", "optimizer", 2),
        ("critical", "u", "s", "p", None, 1), ("decision", "u", None, None, None, 2), ("decision", "u", "s", None, None, 3), ("critical", None, None, None, None, 2), ("conversation", None, None, None, None, 3),
        ("pattern", None, None, None, None, 1), ("decision", None, None, None, None, 0), ("other", "", "", "", None, 3),
    ]
    df = spark.createDataFrame(cases, "kind string, u string, s string, p string, a string, want int")
    assert df.where(memory.level(*[F.col(c) for c in ("kind", "u", "s", "p", "a")]) != F.col("want")).count() == 0


def test_promotion(spark):
    now = F.lit("2024-03-10").cast("timestamp")
    base = {"id": 1, "level": 3, "type": "decision", "created_at": "2024-03-01", "importance": 0.95, "access_count": 3, "deleted_at": None}
    changes = [{}, {"level": 1}, {"type": "code"}, {"created_at": "2024-03-09 12:00:00"}, {"importance": 0.69}, {"access_count": 2}, {"deleted_at": "2024-03-02"}]
    rows = [tuple((base | c | {"id": n}).values()) for n, c in enumerate(changes)]
    df = spark.createDataFrame(rows, "id long, level int, type string, created_at string, importance double, access_count long, deleted_at string")
    got = memory.promoted(df.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "deleted_at")}), now).collect()
    assert [(r.id, r.level, r.importance) for r in got] == [(0, 2, 1.0)]


def test_calls(spark):
    cases = [
        ("bus.emit", None, "emit"), ("emit", None, "emit"), ("a.once", None, "listen"), ("x?.off", None, "listen"), ("map.get", "/users", "call"), ("map.get", "/api", "http_call"), ("f", "https://x", "http_call"), ("f", "/apix", "call"),
        ("axios.get", None, "http_call"), ("axios . get", None, "http_call"), ("axios.create", None, "call"), ("gql", None, "http_call"), ("trpc.user.query", None, "http_call"), ("trpc.user.get", None, "call"), ("publish", None, "call"), (None, None, "call"), ("", "'/api/x'", "http_call"),
    ]
    df = spark.createDataFrame(cases, "name string, literal string, want string")
    assert [tuple(r) for r in df.withColumn("got", text.call_kind(F.col("name"), F.col("literal"))).where("got <> want").collect()] == []


def test_categories(spark):
    cases = [
        ("post-tool-use", {"tool_name": "read_file", "file_path": "src/a.ts"}, "files-read"), ("post-tool-use", {"tool_name": "Read", "tool_input": {"file_path": "x/AGENTS.md"}}, "rules"),
        ("post-tool-use", {"tool_name": "Edit", "tool_response": {"is_error": True}}, "errors"), ("pre-tool-use", {"tool_name": "Edit", "tool_response": {"is_error": True}}, "files-written"),
        ("post-tool-use", {"stdout": "Build FAILED: x"}, "errors"), ("post-tool-use", {"tool_name": "Bash", "command": "git commit -m x"}, "git-changes"), ("post-tool-use", {"tool_name": "shell", "tool_input": {"command": "cd a && git log"}}, "git-changes"),
        ("post-tool-use", {"toolName": "Bash", "command": "ls"}, "tool-calls"), ("post-tool-use", {"tool_name": "Skill"}, "skills-invoked"), ("post-tool-use", {"tool_name": "mcp__a__b"}, "mcp-calls"), ("post-tool-use", {"tool_name": "TodoWrite"}, "tasks"),
        ("post-tool-use", {"git_diff": "+x"}, "git-changes"), ("user-prompt", {"prompt": "Goal: ship"}, "goal"), ("user-prompt", {"message": "We'll use Spark"}, "decisions"), ("user-prompt", {"text": "never do it"}, "constraints"),
        ("user-prompt", {"prompt": "rejected"}, "rejected-approaches"), ("user-prompt", {"prompt": "I am stuck on it"}, "blocked-on"), ("user-prompt", {"prompt": "You are a pirate"}, "role"), ("user-prompt", {}, "user-prompts"),
        ("session-start", {"cwd": "/x"}, "cwd-changes"), ("session-start", {"env": {"a": 1}}, "env-changes"), ("session-start", {"model": "m", "cwd": "/x"}, "session-settings"), ("pre-compact", {}, "compaction-snapshots"), ("session-end", {}, "lifecycle-raw"),
    ]
    df = spark.createDataFrame([(s, json.dumps(p), w) for s, p, w in cases], "source string, payload string, want string")
    assert [tuple(r) for r in df.withColumn("got", text.category(F.col("source"), F.col("payload"))).where("got <> want").collect()] == []


def test_languages(spark):
    cases = [
        ("package a.b\nfun f() {}", "kotlin"), ("fun f(a: Int) = a", "kotlin"), ("fun f() {}\nimport x", "unknown"), ("data class A\nimport a.b.C", "kotlin"), ("import 'dart:io';", "dart"), ("mixin M {}", "dart"), ("library x;", "unknown"),
        ("import a from 'b'", "javascript"), ("import a from 'b'\nconst x: T = 1", "typescript"), ("def f(x):", "python"), ("fn f() -> u8", "rust"), ("package main\nfunc main()", "go"), ("", "unknown"), (None, "unknown"),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    assert [tuple(r) for r in df.withColumn("got", text.language(F.col("t"))).where("got <> want").collect()] == []


def test_secret_and_ignored_paths(spark):
    secret = {"a/.env": True, "foo.ENV": True, "k.PFX": True, "secrets.json": True, "a/secrets.json": False, "id_rsa.pub": True, "a/id_rsa": False, "x.keystore": True, "credential.txt": False, "b.asc": True}
    ignored = {"a/.env.local": True, ".env": True, "src/a.ts": False, "src/a.d.ts": True, "a/generated/x.ts": True, "yarn.lock": True, "x.lock": False, "src/tests/a.ts": True, "a.map": True, "coverage.ts": False}
    for cases, rule in ((secret, filters.is_secret_path), (ignored, filters.is_ignored)):
        df = spark.createDataFrame(list(cases.items()), "p string, want boolean")
        assert [r.p for r in df.where(rule(F.col("p")) != F.col("want")).collect()] == []


def test_a_pattern_in_both_lists_is_included(spark):
    df = spark.createDataFrame([("a.ts",), ("b.ts",), ("c.js",)], "p string")
    assert [r.p for r in df.where(filters.globbed(F.col("p"), ["*.ts"], ["*.ts", "b*"])).collect()] == ["a.ts"]


def walk(pairs, rank):
    gone, out = set(), set()
    for a, b in sorted(pairs):
        if a not in gone and b not in gone:
            (ia, ca), (ib, cb) = rank[a], rank[b]
            keep, drop = (a, b) if (ia > ib if ia != ib else ca >= cb) else (b, a)
            gone.add(drop)
            out.add((keep, drop))
    return out


def test_keep_rule_is_one_walk_in_order(spark):
    rng = random.Random(9)
    rank = {i: (rng.randrange(3) / 10, rng.randrange(3)) for i in range(40)}
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)}
    m = spark.createDataFrame([(i, *r) for i, r in rank.items()], "id long, importance double, access_count long")
    df = spark.createDataFrame([(b, *p, 0.9) for b in (1, 2) for p in pairs if b == 1 or sum(p) % 2], "block long, a long, b long, score double")
    got = {(r.block, r.keep_id, r.remove_id) for r in memory.keep_rule(df, m).collect()}
    assert got == {(1, *x) for x in walk(pairs, rank)} | {(2, *x) for x in walk([p for p in pairs if sum(p) % 2], rank)}


def test_no_text_goes_with_pairs(spark, sf):
    """What a text says is told once a document, not once a pair."""
    from tessera import queries

    plan = queries.queries()["relation_rules"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]  # all that stands over the pairs, up to their making
    assert "Join" in above and "contains(" not in above.lower()


def test_keep_rule_settles_many_pairs_of_a_memory_in_a_round(spark):
    """A memory that outlives all of its many others took a round for each."""
    rng = random.Random(2)
    rank = {i: (0.9 if i == 1 else rng.randrange(10) / 10, rng.randrange(7)) for i in range(1, 61)}
    pairs = {(1, b) for b in range(2, 61)} | {(a, b) for a in range(30, 61) for b in range(a + 1, 61) if (a + b) % 3}
    m = spark.createDataFrame([(i, *r) for i, r in rank.items()], "id long, importance double, access_count long")
    df = spark.createDataFrame([(1, *p, 0.9) for p in pairs], "block long, a long, b long, score double")
    spark.sparkContext.setJobGroup("keep-rule", "")
    got = {(r.keep_id, r.remove_id) for r in memory.keep_rule(df, m).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("keep-rule"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == walk(pairs, rank)
    assert 0 < jobs < 150


def test_consolidation_windows(spark):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][n % 3], n, [float(x) for x in rng.normal(size=3)] if n % 7 else None, n // 2) for n in range(60)]
    want, unit = {}, lambda v: np.array(v) / np.linalg.norm(v)
    for p in ("a", "b", None):
        members = sorted((r for r in rows if r[0] == p and r[2]), key=lambda r: (-r[3], r[1]))
        chosen = [members[0]]
        for r in members[1:]:
            if len(chosen) < 5 and all(unit(c[2]) @ unit(r[2]) >= 0.3 for c in chosen):
                chosen.append(r)
        want[p] = [r[1] for r in chosen] if len(chosen) > 1 else []
    df = spark.createDataFrame(rows, "project string, id long, embedding array<double>, s long").withColumn("created_at", F.timestamp_seconds("s"))
    found = memory.consolidation_window(df, 0.3, 5)
    got = {}
    for r in found.orderBy("place").collect():
        got.setdefault(r.project, []).append(r.id)
    assert got == {p: ids for p, ids in want.items() if ids}
    most = max(map(len, want.values()))
    assert found.count() and memory.largest_window(found).count() == most


def test_diversified(spark):
    hits = [(1, n, 1 - n / 100, t) for n, t in enumerate(["a b c d e f g", "a b c d e f g", "a b c d e f g h", "x y z", "x y", "a b c d e f g h"])]
    df = spark.createDataFrame(hits, "query_id long, id long, score double, content string")
    assert [r.id for r in ranking.diversified(df).orderBy("id").collect()] == [0, 3, 4]


def test_explanations(spark):
    df = spark.createDataFrame([(0.7, 0.016393, 0.85, 0.5, 1, 3, 1), (0.2, 0.03125, None, 0.5, None, 2, 2)], "score double, rrf double, vector_score double, keyword_score double, vector_rank int, keyword_rank int, combined_rank int")
    got = [r.explanation for r in ranking.explained(df).collect()]
    assert got[0].breakdown == "Vector: 85.0% (rank #1) + Keyword: 50.0% (rank #3) → RRF: 0.0164 → Final: 70.0%" and got[0].combined_rank == 1
    assert got[1].breakdown == "Keyword: 50.0% (rank #2) → RRF: 0.0313 → Final: 20.0%" and got[1].vector_rank is None


def test_task_alignment(spark):
    df = spark.createDataFrame([("fix the parser", "parser fix", [1.0, 0.0], [0.0, 1.0])], "c string, t string, v array<double>, w array<double>")
    row = df.select(ranking.task_alignment(F.col("c"), F.col("t")).alias("a"), ranking.task_alignment(F.col("c"), F.col("t"), F.col("v"), F.col("w")).alias("b")).first()
    assert (round(row.a, 6), row.b) == (round(2 / 3, 6), 0.5)


def test_snapshot_bounds(spark):
    rows = [(1, n, f"2024-01-01 00:00:{n:02d}", "ab"[n % 2] if n < 8 else "c", "é<" * 200 if n == 7 else None) for n in range(9)]
    df = spark.createDataFrame(rows, "session long, id long, at string, category string, token string").withColumn("ts", F.col("at").cast("timestamp"))
    whole = events.snapshot(df).first()
    assert whole.sections == 3 and whole.snapshot.index("<a ") < whole.snapshot.index("<b ") < whole.snapshot.index("<c ") and "é&lt;" in whole.snapshot and "…" in whole.snapshot
    size = len(whole.snapshot.encode())
    assert events.snapshot(df, max_bytes=size).first().sections == 3 and events.snapshot(df, max_bytes=size - 1).first().sections == 2 and events.snapshot(df, max_bytes=10).first().sections == 1
    assert events.snapshot(df, per_section=2).first().snapshot.count("      - ") == 5


def test_chunk_bounds():
    assert text.line_pieces("a" * 8 + "; " + "b" * 9, 10) == ["aaaaaaaa;", " bbbbbbbbb"] and text.line_pieces("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    long = [(1, 260, "L", "\n".join("" if i == 150 else f"line {i}" for i in range(260)))]
    assert [(a, b, n) for a, b, n, _ in text.bounded_chunks(long)] == [(1, 150, "L (part 1)"), (151, 260, "L (part 2)")]
    small = [(1, 9, "", "\n".join("abcdefghi")), (10, 11, "", "x\ny"), (12, 20, "", "\n".join("123456789"))]
    assert [(a, b) for a, b, _, _ in text.bounded_chunks(small)] == [(1, 11), (12, 20)]
    assert text.headed("a.ts", "f", "x") == "// File: a.ts\n// Section: f\nx" and text.headed("a.ts", "f", "1\n2\n3\n4\n5").count("// f\n") == 2
    code = "import a\n\n/** doc */\nclass A {\n  run(x) {\n    if (x) {}\n  }\n  // next\n  stop() {}\n}\nfunction f() {}\n"
    assert [(a, n) for a, _, n, _ in text.code_chunks(code)] == [(1, "imports"), (3, "A"), (5, "A.run"), (8, "A.stop"), (11, "f")]
    assert all(len(c[3]) <= text.MOST_CHARS for c in text.finished_chunks("a.ts", code + "x" * 20_000))


def test_intent_search(spark):
    body = "\n".join(["alpha beta"] * 50 + ["gamma gamma the"] * 50)
    df = spark.createDataFrame([(1, body + "x" * 5000), (2, "alpha"), (3, body.ljust(4999))], "id long, text string")
    got = [(r.id, r.line_start, r.score) for r in lexical.intent_search(df, "the gamma").collect()]
    assert got == [(1, 51, 1.0)]


def test_names_of_symbols(spark):
    df = spark.createDataFrame([("a.ts#f",), ("a.ts#A.f~method~" + "0" * 64,), ("a.ts",), ("a#b#c",)], "n string")
    parts = [r.p for r in df.select(text.fqn_parts(F.col("n")).alias("p")).collect()]
    assert (parts[0].file, parts[0].qualified, parts[0].kind) == ("a.ts", "f", None) and (parts[1].qualified, parts[1].kind) == ("A.f", "method") and parts[2:] == [None, None]


def test_hash_of_bytes(spark):
    df = spark.createDataFrame([("",), ("a",), ("é ß",), (None,)], "t string")

    def fnv(t):
        h = 0x811C9DC5
        for b in (t or "").encode():
            h = (h ^ b) * 0x01000193 % (1 << 32)
        return h

    assert [r.h for r in df.select(text.fnv1a(F.col("t")).alias("h")).collect()] == [fnv(t) for t in ("", "a", "é ß", None)]


def test_projection(spark):
    df = spark.createDataFrame([(1, [{"b": 1, "c": {"d": "x"}}], '{"k": {"v": 2}}')], "a int, s array<struct<b: int, c: struct<d: string>>>, j string")
    row = filters.projected(df, ["a", "s.c.d", "j.k.v", "s.nothing", "no"])
    assert row.columns == ["a", "s.c.d", "j.k.v"] and tuple(row.first()) == (1, ["x"], "2")


def test_buffers_and_sessions(spark):
    entries = spark.createDataFrame([(1, 1, "red blue", "x", 0.9, 0), (1, 2, "", "red green", 0.5, 0), (1, 3, "red blue", "x", 0.2, -100), (1, 4, "none here", "red blue", 0.4, 0)], "session long, id long, query string, content string, baseline double, at long")
    asked = spark.createDataFrame([(1, 7, "red blue", 10)], "session long, query_id long, query string, at long")
    assert {(r.id, r.score) for r in events.buffer_hits(entries, asked, ttl_seconds=60).collect()} == {(1, 1.0)}
    assert {r.id for r in events.buffer_hits(entries, asked, least=0.3, ttl_seconds=60).collect()} == {1, 2}
    log = spark.createDataFrame([(1, 5, 0), (1, 6, 50), (1, 5, 99), (1, 8, 199), (2, 1, 7)], "session long, id long, at long")
    got = {(r.session, r.run): (r.created_at, r.expires_at, r.accesses, [tuple(x) for x in r.recent]) for r in events.sessions(log, 100, 1).collect()}
    assert got == {(1, 1): (0, 199, 3, [(5, 2)]), (1, 2): (199, 299, 1, [(8, 1)]), (2, 1): (7, 107, 1, [(1, 1)])}


def test_records_change(spark):
    p = spark.createDataFrame([(1, 9, "pending", 1, None), (2, 9, "approved", 2, 5)], "id long, project_id long, status string, created_at long, decided_at long")
    d = spark.createDataFrame([(1, "seen", 1), (1, "rejected", 4), (1, "approved", 3), (2, "rejected", 9)], "id long, status string, at long")
    assert {(r.id, r.status, r.decided_at) for r in joins.decided(p, d).collect()} == {(1, "approved", 3), (2, "approved", 5)}
    h = spark.createDataFrame([(1, "open", None, 10), (2, "open", 5, 10), (3, "open", 5, 1), (4, "done", None, 1)], "id long, status string, target long, expires_at long")
    a = spark.createDataFrame([(1, 7), (1, 6), (2, 6), (3, 5)], "id long, agent long")
    assert {(r.id, r.status, r.accepted_by) for r in joins.handed_over(h, a, F.lit(2)).collect()} == {(1, "accepted", 6), (2, "open", None), (3, "expired", None), (4, "done", None)}
    m = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", None)], "id long, content string, project_id long")
    assert [r.content for r in symbols.patched(m, spark.createDataFrame([(1, "z"), (2, None)], "id long, content string")).orderBy("id").collect()] == ["z", "b", "c"]
    assert {r.id for r in symbols.hard_deleted(m, project=2).collect()} == {1, 3}


def test_index_recall(spark, sf):
    """Of the ten nearest by exact search, the index finds nine at least."""
    items = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/embeddings.parquet")
    asked = items.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.vec_id) for r in vector.knn(asked, items, 10).collect()}
    found = {(r.query_id, r.vec_id) for r in vector.Index(items).search(asked, 10).collect()}
    assert len(exact & found) >= 0.9 * len(exact) > 0


def test_queries_in_blocks(spark, sf, monkeypatch):
    items = spark.read.parquet(f"{sf}/embeddings.parquet")
    asked = items.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, vector.knn(asked, items, 3).collect()))
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    assert sorted(map(tuple, vector.knn(asked, items, 3).collect())) == whole


def test_knn_join_asks_for_every_vector(spark, sf):
    """The five nearest of all vectors by plain products, and not of every fiftieth alone."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    want = {(rows[i].vec_id, rows[int(j)].vec_id, n + 1) for i in range(len(rows)) for n, j in enumerate(np.lexsort((np.arange(len(rows)), -s[i]))[:5])}
    got = core.queries()["knn_join"](spark, sf).collect()
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want and len(got) == 5 * len(rows)


def test_tiles_of_queries_and_items(spark, monkeypatch):
    """Copies, zero, opposite, null and short vectors, null and equal ids: tiles find what all queries at once find, and no task holds more than two."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 8))
    x[20:50], x[50:55], x[55:60] = x[0], 0, -x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0] * 8), (200, None), (201, [1.0]), (7, [0.5] * 8)]
    items = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = items.withColumnRenamed("vec_id", "query_id")
    whole = sorted(map(tuple, vector.knn(asked, items, 4).collect()))
    monkeypatch.setattr(vector, "MAX_QUERIES", 7)
    monkeypatch.setattr(vector, "HELD", 8 * 20)
    found = vector.knn(asked, items, 4)
    assert sorted(map(tuple, found.collect())) == whole and len(whole) == 4 * 92
    assert vector._tiled_knn(asked, items, 4, "query_id", "vec_id", "embedding", 6).rdd.getNumPartitions() == 35  # 5 tiles of items with 7 of queries
    s = np.round(np.clip((u := x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]) @ u.T, 0, 1), 6)
    for chunk in (3, 11, 4096):
        a, b, score = vector._tile_best(u, u, 4, 6, chunk)
        assert [(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True)] == [(i, int(j)) for i in range(90) for j in np.lexsort((np.arange(90), -s[i]))[:4]]
        assert np.array_equal(score, s[a, b])


def test_wild_terms(spark):
    df = spark.createDataFrame([(1, "snake_case"), (2, "snakeXcase"), (3, "snake case here")], "doc_id long, text string")
    assert {r.doc_id for r in lexical.term_coverage(df, "snake_case", 9).collect()} == {1, 2, 3}
    assert {r.doc_id for r in lexical.term_coverage(df, "snake_case", 9, wild=False).collect()} == {1}
