"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import repeats

DOCS = "doc_id long, text string"


def brute(rows, depth=100):
    """Removed bytes, spans and what is left, by id and text; rows with both equal are one document."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - depth + 1):
            window = data[p : p + depth]
            if window in seen:
                gone[p : p + depth] = True
            seen.add(window)
        left = bytes(np.frombuffer(data, np.uint8)[~gone]) if len(data) else b""
        spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
        out[i, text] = (len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(25, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 40)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 20)
            parts.insert(rng.randrange(len(parts)), p[a : len(p) - rng.randrange(0, 20)])
        rows.append((i, "\n".join(parts)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (None, rows[3][1]), (62, rows[5][1][7:]), (63, rows[5][1].replace(" ", "  ", 1))]
    rows += [(64, None), (65, ""), (66, "a" * 99), (67, "a" * 450), (68, "ab" * 300 + passages[0] + "ab" * 100), (69, "=" * 130 + passages[1] + "=" * 130)]
    return rows


def by_row(frame, rows):
    texts = dict(rows)
    return {(r.doc_id, texts[r.doc_id]): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_of_windows_that_begin_earlier_too(spark, seed):
    rows = made(seed)
    want = brute(rows)
    assert by_row(repeats.op12_repeats(spark.createDataFrame(rows, DOCS)), rows) == want
    assert sum(v[1] for v in want.values()) > 3000 and max(v[2] for v in want.values()) > 1


def test_heavy_buckets_are_refined_first(spark):
    rng = random.Random(4)
    shared = "license text " + "".join(rng.choice("abcdefgh ") for _ in range(140))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randrange(5, 40))) + shared[rng.randrange(0, 30) :] + "".join(rng.choice("xyz ") for _ in range(60))) for i in range(80)]
    want = brute(rows)
    spark_rows = spark.createDataFrame(rows, DOCS)
    for heavy in (1 << 12, 10, 1):
        runs = {r.doc_id: r for r in repeats.removed(spark_rows, heavy).collect()}
        for (i, text), (_, gone, spans, _) in want.items():
            places = {b for r in (runs[i].runs if i in runs else []) for w in range(r.lo, r.lo + r.n) for b in range(w, w + 100)}
            assert len(places) == gone
    assert sum(v[1] for v in want.values()) > 4000


def test_repeated_rows_and_equal_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (1, text), (1, text + " more"), (2, text), (None, text), (None, None)]
    got = sorted(tuple(r) for r in repeats.op12_repeats(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_removed").na.fill(-1).collect())
    k = {r.text: r.k for r in spark.createDataFrame([(text,), (text + " more",)], "text string").withColumn("k", F.xxhash64("text")).collect()}
    first = text if k[text] < k[text + " more"] else text + " more"
    n = len(text)
    assert got == sorted([(1, 0 if first == text else n), (1, 0 if first == text else n), (1, n if first == text else 0), (2, n), (-1, n), (-1, 0)])


def test_columns_pass_and_an_empty_table(spark):
    frame = spark.createDataFrame([(1, "x" * 300, 5, "y")], "doc_id long, text string, runs int, _own string")
    row = repeats.deduplicated(frame).collect()[0]
    assert (row.runs, row["_own"], row.n_removed, bytes(row.kept)) == (5, "y", 299, b"x") and row.n_spans == 1
    assert repeats.op12_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_texts_in_pieces():
    rng = np.random.default_rng(3)
    data = bytes(rng.integers(97, 123, 3000, dtype=np.uint8))
    data += data[500:900] + data
    whole = repeats.blocks(data, 0)
    assert int(whole[3].sum() + whole[6].sum()) == len(data) - 99
    pieces = [repeats.blocks(data, at, 1000) for at in range(0, len(data) - 99, 1000)]
    assert sum(int(p[3].sum() + p[6].sum()) for p in pieces) == len(data) - 99
    keyed = {}
    for b, _, lo, n, off, *_ in pieces:
        for x, at, m, o in zip(b.tolist(), lo.tolist(), n.tolist(), off.tolist()):
            for w in range(at, at + m):
                assert keyed.setdefault(data[w : w + 100], (x, o - (w - at))) == (x, o - (w - at))  # equal windows, equal places


def test_bucket_pointers():
    rng = random.Random(6)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(100, 300))).encode() for _ in range(30)]
    strings += [s[10:180] for s in strings if len(s) > 200] + [b"a" * 250, b"a" * 120]
    seen = set()
    for s, again in zip(strings, repeats.repeated(strings), strict=True):
        assert len(again) == len(s) - 99
        for p, a in enumerate(again.tolist()):
            assert a == (s[p : p + 100] in seen)
            seen.add(s[p : p + 100])


def test_a_bucket_of_one_window_in_any_number_of_batches():
    import pyarrow as pa

    names = ["g", "one", "doc_id", "k", "lo", "bytes"]
    rows = [(1, True, i, 0, 0, b"q" * 100) for i in range(50)] + [(2, False, i, 0, 0, bytes([65 + i]) * 20 + b"z" * 100) for i in range(3)] + [(3, True, i, 0, 7, b"r" * 100) for i in range(9)]
    batches = [pa.record_batch([list(c) for c in zip(*rows[i : i + 7])], names=names) for i in range(0, len(rows), 7)]
    got = [tuple(r.values()) for b in repeats._refined(iter(batches), 300) for r in b.to_pylist()]
    assert sorted(got) == sorted([(i, 0, 0, 1) for i in range(1, 50)] + [(i, 0, 20, 1) for i in range(1, 3)] + [(i, 0, 7, 1) for i in range(1, 9)])
