"""Near pairs and the graph of neighbours against all pairs."""

import numpy as np
import pyarrow as pa
import pytest
from tessera.operators import neighbours, vector

SCHEMA = "vec_id long, embedding array<double>, block int"


def planted(seed, n=600, dims=32):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims))
    for i in range(n // 3, n, 3):  # copies from just below to just above the threshold, some exact and some in a chain
        x[i] = x[i - n // 3] + rng.standard_normal(dims) * rng.uniform(0, 0.4)
    x[n - 5 :] = x[7]
    return x


def rows(x, blocks=2):
    return [(i, [float(v) for v in r], i % blocks) for i, r in enumerate(x)]


def brute(x, threshold, blocks=None):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    return {(i, j) for i, j in zip(*np.nonzero(s >= threshold), strict=True) if i < j and (blocks is None or i % blocks == j % blocks)}


@pytest.mark.parametrize("heavy", [1 << 12, 20])
def test_pairs_at_a_high_threshold(spark, heavy):
    x = planted(1)
    frame = spark.createDataFrame([*rows(x), (None, [1.0] * 32, 0), (9000, None, 0), (9001, [0.0] * 32, 0), (9002, [1.0], 0), (9003, [float("nan")] * 32, 0)], SCHEMA)
    made = neighbours.near_pairs(frame, 0.95, heavy=heavy)
    want = brute(x, 0.95)
    rep = {r.id: r.rep for r in made.members.collect()}
    assert len(rep) == 600 and all(rep[i] == 7 for i in range(595, 600))
    got = {(r.a, r.b) for r in made.pairs.collect()}
    classes = {tuple(sorted((rep[i], rep[j]))) for i, j in want if rep[i] != rep[j]}
    assert got <= classes and len(got) >= 0.99 * len(classes) and len(classes) > 50
    if got == classes:
        links = {r.id: r.links for r in made.links().collect()}
        assert links == {i: sum(i in p for p in want) for i in range(600)}
    bands = neighbours.bands_for(0.95, 595)
    assert made.sent == bands.count * 595  # one row a band and different vector, and none for pairs


def test_pairs_of_a_block(spark):
    x = planted(2, 300)
    made = neighbours.near_pairs(spark.createDataFrame(rows(x, 3), SCHEMA), 0.9, block="block", miss=1e-6)
    rep = {r.id: r.rep for r in made.members.collect()}
    assert {(r.a, r.b) for r in made.pairs.collect()} == {tuple(sorted((rep[i], rep[j]))) for i, j in brute(x, 0.9, 3) if rep[i] != rep[j]}
    assert neighbours.near_pairs(spark.createDataFrame([], SCHEMA), 0.9).links().collect() == []


def test_bands_fit_the_threshold():
    for t in (0.8, 0.9, 0.95, 0.99):
        b = neighbours.bands_for(t, 10_000)
        share = (1 - np.arccos(t) / np.pi) ** b.bits
        assert (1 - share) ** b.count <= neighbours.MISS
    assert neighbours.bands_for(0.99, 10_000).count < neighbours.bands_for(0.9, 10_000).count


def recall(spark, n, dims=16, **more):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((12, dims))
    x = centres[rng.integers(0, 12, n)] * 0.7 + rng.standard_normal((n, dims))
    frame = spark.createDataFrame(rows(x), SCHEMA)
    asked = frame.where("vec_id % 50 = 0").selectExpr("vec_id as query_id", "embedding")
    graph = neighbours.Graph(frame, **more)
    got = {(r.query_id, r.vec_id) for r in graph.search(asked, 10).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(q, int(i)) for q in range(0, n, 50) for i in np.argsort(-(u[q] @ u.T), kind="stable")[:10]}
    compared = [r.compared for r in graph.compared.collect()]
    assert len(compared) == len(range(0, n, 50))
    return len(got & want) / len(want), sum(compared) / len(compared)


def test_the_graph_finds_the_nearest_and_compares_few(spark):
    small, few = recall(spark, 1000)
    large, more = recall(spark, 4000)
    assert small >= 0.9 and large >= 0.9
    assert more < 2 * few and more < 4000 / 3  # four times the vectors


def test_a_graph_of_few_or_odd_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, None, 0), (4, [1.0], 0), (1, [1.0, 0.0], 0)], SCHEMA)
    asked = frame.where("vec_id = 1").limit(1).selectExpr("vec_id as query_id", "embedding")
    got = [(r.query_id, r.vec_id, r["rank"]) for r in neighbours.Graph(frame).search(asked, 5).orderBy("rank").collect()]
    assert got == [(1, 1, 1), (1, 2, 2)]
    exact = vector.knn(asked, frame.where("vec_id < 3"), 5)
    assert exact.count() >= 2


def test_shards_are_made_and_searched_in_few_tables(spark, monkeypatch):
    """Every vector is in one shard, copies are ranked by their ids, and neither making the graph nor a search stores a table a round."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 12))
    x[900:950], x[950:953], x[953] = x[3], 0, -0.0
    tables, stored = [], neighbours.stored

    def counted(df, label, *more):
        tables.append(label)
        return stored(df, label, *more)

    monkeypatch.setattr(neighbours, "stored", counted)
    monkeypatch.setattr(neighbours, "SHARD", 250, raising=False)
    frame = spark.createDataFrame(rows(x), SCHEMA)
    graph = neighbours.Graph(frame)
    got = {}
    for r in graph.search(frame.where("vec_id < 900 and vec_id % 9 = 3").selectExpr("vec_id as query_id", "embedding"), 10).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert len(tables) < 10
    held = [(r.shard, i) for r in graph.graph.collect() for i in r.ids]
    assert sorted(i for _, i in held) == list(range(1200)) and len({s for s, _ in held}) == graph.shards == 5
    u = x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    s = np.round(np.clip(u @ u.T, 0, 1), 6)
    want = {q: [int(i) for i in np.lexsort((np.arange(1200), -s[q]))[:10]] for q in range(3, 900, 9)}
    assert got[3] == {n + 1: (i, 1.0) for n, i in enumerate([3, *range(900, 909)])}
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    assert sum(len({i for i, _ in got[q].values()} & set(want[q])) for q in want) >= 0.95 * 10 * len(want)
    assert {r.query_id for r in graph.compared.collect()} == set(want)


def test_a_cell_gets_a_vector_once_and_returns_its_best_once():
    """Groups that share members: the best of all of them, each once, and none below what a vector has."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 8)).astype(np.float32)
    groups = [rng.choice(40, 12, replace=False).tolist() for _ in range(30)]
    low = [None] * 39 + [0.9999]
    fields = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float32())), ("low", pa.float64()), ("ids", pa.list_(pa.int64()))])
    rows = [{"id": i, "v": v.tolist(), "low": low[i]} for i, v in enumerate(x)] + [{"ids": g} for g in groups]
    sent = [pa.RecordBatch.from_pylist(rows[at : at + 7], fields) for at in range(0, len(rows), 7)]
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = {i: {j for g in groups if i in g for j in g} - {i} for i in range(39)}
    want = sorted((i, j) for i, js in near.items() for j in sorted(js, key=lambda j: (-(u[i] @ u[j]), j))[:5])
    for held in (100, 1 << 21):
        got = [(r["src"], r["dst"]) for b in neighbours._cell_best(iter(sent), 8, 5, held) for r in b.to_pylist()]
        assert sorted(got) == want
