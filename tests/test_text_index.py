"""The stored index against scans of the texts, and corrections against all distances."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from tessera import session
from tessera.operators import lexical
from tessera.operators.text_index import TextIndex

SCHEMA = "doc_id long, text string, lang string"


def made(seed, n=400, start=-40):
    rng = random.Random(seed)
    words = ["the", "Then", "other", "erst", "Erste", "nation", "x_1", "a", "ÜBER", "over", "re_ti", "rexti", "50%", "50 of", "\U0001f600\U0001f601\U0001f602", "line\nbreak"]
    rows = []
    for i in range(start, start + n):
        rare = f"needle{i}" if i % 37 == 0 else ""
        rows.append((i, " ".join([*(rng.choice(words) for _ in range(rng.randrange(0, 8))), rare]), rng.choice(["en", "fr"])))
    return rows + [(start + n + 5, None, "en"), (start + n + 6, "", None), (None, "the", "en")]


def path(spark):
    return f"{session.shared_folder(spark)}/index-{uuid.uuid4().hex}"


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame(made(1), SCHEMA)
    index = TextIndex(spark, path(spark), ("lang",), shift=4)
    index.upsert(docs)
    return index, docs.where("doc_id is not null")


@pytest.mark.parametrize("text", ["the erst", "zzz", "OVER the"])
def test_ranked_search_is_the_scan(indexed, text):
    index, docs = indexed
    for limit in (7, 1000):
        assert rows(index.search(text, limit)) == rows(lexical.prefix_search(docs, text, limit))
        assert rows(index.search(text, limit, lang="fr")) == rows(lexical.prefix_search(docs.where("lang = 'fr'"), text, limit))


def test_blocks_that_cannot_enter_are_not_read(indexed):
    index, docs = indexed
    assert rows(index.search("needle", 2)) == [(-37, 0.2), (0, 0.2)]
    assert 0 < index.read.blocks < index.read.total / 2


@pytest.mark.parametrize("text", ["(the) erst tion: Erst", "re_ti 50%", "über \U0001f600\U0001f601\U0001f602", "a_b_c erst", "zzzz"])
def test_search_for_parts_of_words_is_the_scan(indexed, text):
    index, docs = indexed
    for wild in (True, False):
        assert rows(index.coverage(text, 1000, wild)) == rows(lexical.term_coverage(docs, text, 1000, wild=wild))
    assert rows(index.coverage(text, 9, lang="en")) == rows(lexical.term_coverage(docs.where("lang = 'en'"), text, 9))


def test_few_texts_are_read(indexed):
    index, docs = indexed
    found = index.coverage("needle37", 10)
    assert rows(found) == [(37, 1.0)] and index.read.texts <= 4
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(doc_id" in plan or "EqualTo(doc_id" in plan or "doc_id IN" in plan
    index.coverage("a_b", 10).collect()
    assert index.read.texts == docs.count()


def test_batches_equal_a_rebuild(spark):
    first, second = made(1, 200), [(i, (t or "") + " the needle", "de") for i, t, _ in made(2, 90, 100) if i is not None and i % 3]
    index = TextIndex(spark, path(spark), ("lang",), shift=4)
    index.upsert(spark.createDataFrame(first, SCHEMA))
    index.upsert(spark.createDataFrame(second, SCHEMA))
    index.delete(spark.createDataFrame([(i,) for i in range(0, 150, 5)] + [(None,), (9999,)], "doc_id long"))
    index.upsert(spark.createDataFrame([(10, "erst again", "fr"), (5000, "the erst", "fr")], SCHEMA))
    now = {i: (t, x) for i, t, x in first if i is not None} | {i: (t, x) for i, t, x in second}
    now = {i: v for i, v in now.items() if i not in range(0, 150, 5)} | {10: ("erst again", "fr"), 5000: ("the erst", "fr")}
    whole = TextIndex(spark, path(spark), ("lang",), shift=4)
    whole.upsert(spark.createDataFrame([(i, t, x) for i, (t, x) in now.items()], SCHEMA))

    def same():
        assert sorted(rows(index.documents()), key=str) == sorted(rows(whole.documents()), key=str)
        assert sorted(rows(index.vocabulary())) == sorted(rows(whole.vocabulary()))
        assert rows(index.search("the erst", 12, lang="de")) == rows(whole.search("the erst", 12, lang="de"))
        assert rows(index.coverage("tion over", 12)) == rows(whole.coverage("tion over", 12))

    same()
    assert [s["docs"] for s in index.segments()][1:] == [len(second), 31, 2]
    before = len(index.segments())
    assert not index.merge(least=4) and index.merge(least=3)
    assert len(index.segments()) < before
    same()
    while index.merge(least=1):
        pass
    same()
    assert len(index.segments()) == 1
    assert index.segments()[0]["docs"] == len(now)


def test_two_writers_and_an_empty_index(spark):
    place = path(spark)
    one, other = TextIndex(spark, place), TextIndex(spark, place)
    assert rows(one.search("the", 5)) == [] and rows(one.coverage("the", 5)) == []
    one.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert one.segments() == []
    docs = spark.createDataFrame([(1, "the text")], "doc_id long, text string")
    number, segments = other._manifest()
    one.upsert(docs)
    with pytest.raises(RuntimeError, match="another writer"):
        other._commit(number, segments)
    assert rows(other.search("the", 5)) == [(1, 0.2)]
    other.upsert(spark.createDataFrame([], "doc_id long, text string"))
    assert rows(one.search("text", 5)) == [(1, 0.2)]


def test_an_index_is_written_once(spark):
    made_ = []

    def make():
        made_.append(session.scratch_path(spark, "once"))
        return made_[-1]

    assert session.once(spark, "x", make) == session.once(spark, "x", make) == made_[0] and len(made_) == 1


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_corrections_are_those_of_all_distances(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))

    def edited(w, k):
        for _ in range(k):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcd") + w[i:], w[:i] + rng.choice("abcd") + w[i + 1 :]])
        return w

    known = list({word(n) for n in [*range(1, 30)] * 12} | {word(70)})
    terms = list({edited(rng.choice(known), rng.randrange(0, 5)) for _ in range(250)} | {"zzz", "", "z" * 40})
    got = {r.term: (r.word, r.distance) for r in lexical.corrections(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame([(w,) for w in known], "word string")).collect()}
    for t in terms:
        most = 1 if len(t) <= 4 else 2 if len(t) <= 12 else 3
        near = min(((distance(t, w), w) for w in known if abs(len(t) - len(w)) <= most), default=None)
        assert got[t] == ((None, None) if near is None or near[0] > most or near[0] == 0 else (near[1], near[0])), t


def test_a_key_is_shared_by_near_words_alone(spark):
    words = spark.createDataFrame([(f"{a}{b}{c}word",) for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx"], "word string")
    keys = words.select("word", F.explode(lexical.neighbour_keys(F.col("word"), asked=False)).alias("k")).groupBy("k").agg(F.count_distinct("word").alias("n"))
    assert keys.agg(F.max("n")).first()[0] <= 64  # of 512 words of one length


def test_blocks_are_not_gathered_in_one_task(spark):
    """Small shuffles are put together by size, and one task indexed all blocks: what it made of the texts is many times as large."""
    docs = spark.createDataFrame([(i, f"word{i % 7} and other text \U0001f600\U0001f601\U0001f602 {i}", "en") for i in range(256)], SCHEMA)
    index = TextIndex(spark, path(spark), ("lang",), shift=3)
    spark.sparkContext.setJobGroup("index", "")
    index.upsert(docs)
    stages = [s for j in spark.sparkContext.statusTracker().getJobIdsForGroup("index") for s in spark.sparkContext.statusTracker().getJobInfo(j).stageIds]
    tasks = [i.numTasks for s in set(stages) if (i := spark.sparkContext.statusTracker().getStageInfo(s))]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(tasks) >= 16
    assert rows(index.search("word3 word5", 300)) == rows(lexical.prefix_search(docs, "word3 word5", 300))
    assert rows(index.coverage("d5 \U0001f600\U0001f601\U0001f602", 300)) == rows(lexical.term_coverage(docs, "d5 \U0001f600\U0001f601\U0001f602", 300))


def test_an_index_of_nothing(spark):
    index = TextIndex(spark, path(spark), ("lang",))
    index.upsert(spark.createDataFrame([(1, "", "en"), (2, None, "en")], SCHEMA))
    assert rows(index.search("a", 5)) == [] and rows(index.coverage("abc", 5)) == [] and rows(index.vocabulary()) == []
    assert index.documents().count() == 2
