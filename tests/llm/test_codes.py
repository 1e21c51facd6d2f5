"""Product codes against a full scan in plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from tessera.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int"


def brute(rows, parts=8, entries=16, rounds=6):
    """``rows`` of whole numbers by id: codes, errors and the books, every distance computed."""
    ids = sorted(rows)
    n = len(rows[ids[0]]) // parts
    cut = {i: [rows[i][p * n : (p + 1) * n] for p in range(parts)] for i in ids}
    books = [[list(cut[i][p]) for i in ids[:entries]] for p in range(parts)]

    def assigned():
        out = {}
        for i in ids:
            out[i] = [min((sum((a - b) ** 2 for a, b in zip(cut[i][p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)]
        return out

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in ids if now[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    now = assigned()
    sha = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in now[i]), sum(d for d, _ in now[i])) for i in ids}, sha


def rows_of(seed, n=120, dims=24, grid=False):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    draw = (lambda c: [rng.choice([-0.5, 0.0, 0.25]) for _ in c]) if grid else (lambda c: [v + rng.gauss(0, 0.1) for v in c])
    return [(i, draw(rng.choice(centres)), rng.choice([1, 2, None]), 0) for i in range(n)]


@pytest.mark.parametrize("seed, grid", [(1, False), (2, True)])
def test_codes_are_those_of_a_full_scan(spark, seed, grid):
    rows = rows_of(seed, grid=grid)
    bad = [(900, None, 1, 0), (901, [float("nan")] * 24, 1, 0), (902, [float("inf"), *[0.0] * 23], 1, 0), (903, [None, *[0.0] * 23], 1, 0), (904, [], 1, 0), (905, [0.5] * 8, 1, 0)]
    got = {r.vec_id: r for r in codes.op13_codes(spark.createDataFrame(rows + bad, SCHEMA)).collect()}
    whole = {i: [int(np.floor(np.float64(np.float32(v)) * 4096)) for v in x] for i, x, _, _ in rows}
    want, sha = brute(whole)
    assert {i: (r.code, r.error) for i, r in got.items()} == want and {r.codebooks_sha256 for r in got.values()} == {sha}
    total = Counter()
    for i, _, label, _ in rows:
        total[label] += want[i][1]
    assert {i: r.label_error for i, r in got.items()} == {i: total[label] for i, _, label, _ in rows}


def test_bounds_spare_distances(spark):
    made = codes.encode(spark.createDataFrame(rows_of(3, n=400, dims=32), SCHEMA))
    full = 400 * 8 * 16
    assert made.scanned[0] >= full and max(made.scanned[3:]) < full / 2


def test_few_rows_repeated_ids_and_none(spark):
    few = spark.createDataFrame([(5, [0.5] * 8, 1, 0), (5, [0.25] * 8, 1, 0), (None, [0.5] * 8, None, 0), (5, [0.5] * 8, 1, 0)], SCHEMA)
    got = sorted(((r.vec_id, r.error, r.label_error) for r in codes.op13_codes(few).collect()), key=str)
    assert got == [(5, 0, 0)] * 3 + [(None, 0, 0)]
    assert codes.op13_codes(spark.createDataFrame([(1, None, 1, 0)], SCHEMA)).collect() == []
    assert codes.op13_codes(spark.createDataFrame([], SCHEMA)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_large_components(spark):
    rows = [(i, [float(3e38 if (i + j) % 3 == 0 else -7.0 * i) for j in range(16)], 1, 0) for i in range(30)]
    got = {r.vec_id: (r.code, r.error) for r in codes.op13_codes(spark.createDataFrame(rows, SCHEMA)).collect()}
    most = codes.limit_of(16)
    want, _ = brute({i: [max(-most, min(most, int(np.floor(v * 4096)))) for v in x] for i, x, _, _ in rows})
    assert got == want


def test_settle_with_ties():
    rng = np.random.default_rng(5)
    x, entries = rng.integers(-3, 4, (500, 4)), rng.integers(-3, 4, (16, 4))
    groups = codes.grouped(entries)
    code, upper, lower = np.zeros(500, np.int64), np.full(500, np.inf, np.float32), np.full((500, len(groups)), -np.inf, np.float32)
    for _ in range(5):
        code, upper, lower, _ = codes.settle(x, entries, groups, code, upper, lower, moved if _ else np.zeros(16, np.float32))
        full = ((x[:, None] - entries) ** 2).sum(axis=2)
        assert (code == full.argmin(axis=1)).all()
        new = np.clip(entries + rng.integers(-1, 2, entries.shape), -3, 3)
        moved, entries = codes.drift(entries, new), new
