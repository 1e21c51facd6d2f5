"""Token files against the library's own tokenizer, and what searches in them read."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import tokens
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)
SPECIAL = "<|endoftext|>"


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [2]


def test_special_strings(spark):
    texts = [f"hello {SPECIAL} world", SPECIAL, f"{SPECIAL}{SPECIAL} a", f"x{SPECIAL}\n\ny", "<|endoftext|", None, ""]
    rows = tokens.op2_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), FILE).collect()
    want = {i: (len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in enumerate(texts)}
    assert {r.doc_id: (r.n_tokens, r.ids_crc32) for r in rows} == want and want[0] == (5, 1604150396)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "Bc", "1", "'s", " ", "  ", "\n", "\t", "é", "!", ",", ".", SPECIAL, "\x01", "　"]), max_size=20).map("".join), min_size=1, max_size=5))
def test_ids_as_the_library_gives_them(texts):
    assert tokens.encoder(FILE, 2).encode(texts).to_pylist() == [ids(t) for t in texts]


def test_plain_strings():
    assert 50256 not in tokens.encoder(FILE, 2, True).encode([f"a {SPECIAL} b"]).to_pylist()[0]


def test_slices_are_bounded_in_rows_and_bytes(spark):
    texts = ["x" * n for n in (5, 90, 200, 1, 1, 1, 0)] + [None, "y" * 60]
    got = [b.column("text").to_pylist() for b in tokens.batched(pa.record_batch([pa.array(texts)], ["text"]), 3, 100)]
    assert sum(got, []) == texts and [len(b) for b in got] == [2, 1, 3, 3]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["one", "two,", "three.\n"]) for _ in range(20))) for i in range(7000)] + [(9000, "long words here " * 120_000)]
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokens.op2_tokens(spark.createDataFrame(rows, "doc_id long, text string"), FILE).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows for x in [ids(t)]}


def scanned(df):
    """Rows that the scan of a collected query put out."""
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    return sum(int(x.metrics().apply("numOutputRows").value()) for x in leaves(node))


def leaves(node):
    kids = node.finalPhysicalPlan().children() if "AdaptiveSparkPlan" in node.getClass().getName() else node.children()
    found = [x for i in range(kids.size()) for x in leaves(kids.apply(i))]
    return found or [node]


def test_searches_skip_row_groups(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    docs = spark.range(20_000).select((2 * F.col("id")).alias("doc_id"), F.lit("some text").alias("text")).coalesce(1)
    tokens.write_tokens(docs, path, FILE)
    everything = tokens.read_tokens(spark, path)
    assert scanned(everything.select("doc_id")) == 20_000
    assert tokens.lookup(spark, path, [20_000]).count() == 1
    assert 0 < scanned(tokens.lookup(spark, path, [20_000]).select("doc_id")) <= 1000  # by the ranges of the row groups
    absent = list(range(20_001, 20_101, 2))
    assert sum(scanned(tokens.lookup(spark, path, [k]).select("doc_id")) for k in absent[:20]) <= 3000  # by the Bloom filters, but for chance
