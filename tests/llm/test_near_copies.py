"""Near copies against a comparison of all pairs."""

import random
from itertools import combinations

import corpus_pipeline
import pytest
from tessera.llm import near_copies, simhash

DOCS = "doc_id long, text string"


def bag(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in text.split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def kept(rows):
    """Ids of the first row of each group of linked rows, all with words."""
    root, bags = list(range(len(rows))), [bag(t) for _, t in rows]
    for i, j in combinations(range(len(rows)), 2):
        if 5 * len(bags[i] & bags[j]) >= 4 * len(bags[i] | bags[j]):
            root = [root[i] if r == root[j] else r for r in root]
    first = {}
    for (k, _), r in zip(rows, root, strict=True):
        first[r] = min(first.get(r, k), k)
    return sorted(first.values())


def made(seed, shared):
    rng = random.Random(seed)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(5, 120))]
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join([*shared, *w])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, shared", [(1, []), (2, [f"Common{i}" for i in range(30)])])
@pytest.mark.parametrize("sample", [1, 20_000])
def test_same_groups_as_all_pairs(spark, monkeypatch, seed, shared, sample):
    monkeypatch.setattr(near_copies, "SAMPLE", sample)
    rows = made(seed, shared)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == kept(rows) and len(got) < len(rows)


def test_pairs_beyond_the_simhash_radius(spark, sf):
    """Similar texts of the tables whose fingerprints differ in more than two bits: one of each pair goes."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf.replace('0.001', '0.1')}/documents.parquet").where("doc_id in (2, 547, 989, 7711, 4, 2540)").collect()]
    prints = {i: simhash.fingerprint(t) for i, t in docs}
    assert all((prints[a] ^ prints[b]).bit_count() > simhash.RADIUS for a, b in [(2, 547), (989, 7711), (4, 2540)])
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(docs, DOCS), "").collect()}
    assert got == {2, 989, 4}


def test_rows_without_words_and_repeated_rows(spark):
    rows = [(5, None), (3, " \t"), (9, ""), (1, "one"), (1, "one"), (2, "ONE"), (None, "one"), (None, "alone"), (7, "a b c"), (7, "x y z")]
    got = near_copies.one_of_each(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "alone"), (1, "one"), (3, " \t"), (7, "a b c"), (7, "x y z")]
    assert near_copies.one_of_each(spark.createDataFrame([], DOCS)).count() == 0


def test_unrelated_texts_that_share_a_passage_form_no_group(spark, monkeypatch):
    """What is compared text by text are near copies alone: with groups of unrelated texts it grows with the square of the table."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    stored, seen = near_copies.stored, {}

    def counted(df, label, *more):
        out = stored(df, label, *more)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(near_copies, "stored", counted)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(12)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(10_000)}" for _ in range(60))])) for i in range(200)]
    rows.append((200, rows[7][1] + " more"))
    got = sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert got == list(range(200)) and seen["near-members"] == 2
