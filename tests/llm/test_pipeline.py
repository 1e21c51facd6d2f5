"""The pipeline's stages against plain Python, on a table with awkward rows; and that nothing stays in the shared folder."""

import random
import zlib
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tessera.llm import common, quality
from tokenizers import Tokenizer

from .test_corpus_ops import contaminated, water_fill, words
from .test_near_copies import kept

SCHEMA = "doc_id long, text string, source string, k string, own string, sig long, _ID string, n long, root string, taken int"


def text(rng, n, pool=4000):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="module")
def made():
    rng = random.Random(7)
    rows = [(None, text(rng, 60)), (None, None), (1, None), (2, ""), (3, "too short"), (4, "again and again " * 60)]
    for i in range(10, 40):
        base = text(rng, 80).split()
        rows.append((i, " ".join(base)))
        if i % 3 == 0:
            base[rng.randrange(80)] = "changed"
            rows.append((i + 100, " ".join(base)))
    bench = [(i, text(rng, 12)) for i in range(3)] + [(8, None), (9, "")]
    rows += [(200 + i, f"{text(rng, 30)} {t} {text(rng, 30)}") for i, t in bench[:3]]
    rows += [rows[8], rows[8], (10, text(rng, 50))]
    return [(i, t, ["a", None, "b"][n % 3], "x", "y", 1, "z", 2, "r", 3) for n, (i, t) in enumerate(rows)], bench


@pytest.fixture(scope="module")
def folder(spark, made, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(made[0], SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(made[1], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def passes(t):
    m = dict(zip(quality.MEASURES, quality.measure(t), strict=True))
    w = m["n_words"]
    return not (
        w < 20 or 100 * m["n_repeat_words"] > 30 * w or 10 * m["n_symbols"] > w or 2 * m["n_dup_lines"] > m["n_lines"] or not 2 * w <= m["word_chars"] <= 20 * w
        or 2 * m["n_upper"] > m["n_letters"] or 10 * m["n_bangs"] > 3 * w or 2 * m["n_stutters"] > w
    )


def test_stages(spark, made, folder):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), None
    found = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, folder), "test")
        found.append([tuple(r) for r in docs.collect()])
        assert name == "token files" or docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    rules, near, clean, mix, files = found
    assert Counter(rules) == Counter(r for r in made[0] if passes(r[1]))
    named = [r[:2] for r in set(rules) if r[0] is not None]
    order = sorted(range(len(named)), key=lambda n: (named[n][0], named[n][1]))
    groups = kept([(n, named[i][1]) for n, i in enumerate(order)])
    near_named = [r[:2] for r in near if r[0] is not None]
    assert {t for _, t in near_named} <= {named[i][1] for i in order} and len(near_named) == len(groups)
    assert [r[1] for r in near if r[0] is None] == [r[1] for r in set(rules) if r[0] is None]
    assert Counter(clean) == Counter(r for r in near if contaminated(r[1], made[1])[2] == 0)
    assert {r[0] for r in near} - {r[0] for r in clean} == {200, 201, 202}
    sizes = {}
    for r in clean:
        sizes[r[2]] = sizes.get(r[2], 0) + len(words(r[1]))
    goal = water_fill(sizes)
    taken = Counter()
    for r in mix:
        taken[r[2]] += len(words(r[1]))
    assert max(Counter(mix).values()) <= 2 and all(abs(taken[s] - goal[s]) <= 160 for s in goal)
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for r in mix:
        ids = plain.encode(r[1], add_special_tokens=False).ids + [2]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r[0], r[2], r[3]) for r in files) == want


def test_whole_run_leaves_nothing(spark, folder):
    common.release(spark)
    rows = corpus_pipeline.run(spark, folder).collect()
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert rows and Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, rows))
    shared = Path(common.scratch_path(spark, "x").removeprefix("file://")).parent
    assert len(list(shared.glob("tessera-*"))) <= 4  # what the two results read from
    common.release(spark)
    assert not list(shared.glob("tessera-*"))


def test_empty_tables(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
