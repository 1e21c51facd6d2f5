"""Long texts, hot keys, ties and repeated rows; and results against plain Python where no SQL says them."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tessera.llm import chat, common, decontaminate, line_dedup, mixing, near_copies, quality, secrets, simhash, toxicity, warc

from tessera.llm.common import stored as _stored
from tessera.llm.common import text_key as common_key

from .test_corpus_ops import brute_print, brute_quality, water_fill, words

DOCS = "doc_id long, text string"


def common_stored(df):
    return _stored(df, "prints")


KNOWN = re.compile("|".join(f"(?:{p})" for p in secrets.ALLOW))
LONG = " ".join(f"word{i % 977}" for i in range(150_000))


def test_long_texts(spark):
    docs = spark.createDataFrame([(1, LONG), (2, LONG + "\n" + "password = abcdefghijkl1\n" * 3000)], DOCS)
    q = {r.doc_id: r for r in quality.op4_quality(docs).collect()}
    assert (q[1].n_words, q[1].n_repeat_words) == (150_000, brute_quality(LONG)[4])
    assert {r.doc_id: r.n_assign for r in secrets.op8_secrets(docs).collect()} == {1: 0, 2: 3000}
    assert {r.doc_id: r.n_lines for r in line_dedup.op10_lines(docs).collect()} == {1: 1, 2: 3002}
    assert {r.doc_id: int(r.fingerprint, 16) for r in simhash.op6_simhash(docs).collect()}[1] == brute_print(LONG)
    found = near_copies.shingles(LONG)
    assert near_copies.fingerprint(found) == sum(1 << b for b in range(64) if 2 * int(((found >> np.uint64(b)) & np.uint64(1)).sum()) > len(found))
    model = toxicity.Model({"word": 3.0}, [0.0, 1.0])
    assert {r.grade for r in toxicity.graded(docs, model).collect()} == {2}


def bits(s):
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def brute_entropy(text):
    """Places in entropy spans that no fixed span covers."""
    marked = set()
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if m[0].isalpha() or KNOWN.fullmatch(m[0]):
            continue
        part = [m[0][:i].count("/") for i in range(len(m[0]))]
        names = m[0].split("/")
        fine = {i for i in range(len(m[0])) if m[0][i] != "/" and len(names[part[i]]) >= 20 and KNOWN.fullmatch(names[part[i]])}
        for mark in ("EXAMPLE", "example", "placeholder", "xxxx", "XXXX"):
            for at in (i for i in range(len(m[0])) if m[0].startswith(mark, i)):
                fine |= {i for i in range(max(0, at - 64), min(len(m[0]), at + len(mark) + 64)) if part[i] == part[at] and m[0][i] != "/"}
        for c in secrets.CLASSES:
            for run in re.finditer("[" + re.escape("".join(sorted(c.alphabet))) + "]+", m[0]):
                hot = sorted({i for s in range(len(run[0]) - c.width + 1) if bits(run[0][s : s + c.width]) >= c.bits - 1e-12 and not fine & set(range(run.start() + s, run.start() + s + c.width)) for i in range(s, s + c.width)})
                while hot:
                    n = next((k for k in range(1, len(hot)) if hot[k] != hot[k - 1] + 1), len(hot))
                    part, hot = hot[:n], hot[n:]
                    if all(set(need) & {run[0][i] for i in part} for need in c.needs):
                        marked |= {m.start() + run.start() + i for i in part}
    return marked - {i for at in secrets.base_spans(text).values() for a, b in at for i in range(a, b)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text("0123456789abcdef", max_size=40), st.text("abcXYZ019+/-_", max_size=40), st.text("qwertyuiop1234567890ASDFGHJKL", min_size=20, max_size=60), st.sampled_from([" ", "token=", ".", "AKIA", "/", "example", "EXAMPLE", "sha256-"])), max_size=8))
def test_entropy_spans(parts):
    text = "".join(parts)
    spans = [s.split(":") for s in secrets.scan(text, KNOWN)[4].split(",") if s.startswith("entropy")]
    places = [i for _, a, b in spans for i in range(int(a), int(b))]
    assert len(places) == len(set(places)) and set(places) == brute_entropy(text)


def test_a_column_named_found(spark):
    out = secrets.secrets(spark.createDataFrame([(1, "x", 5)], "doc_id long, text string, found int")).collect()
    assert out[0].found.n_hex == 0


def test_words_that_the_mix_takes(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)] + [(7, "w w w", "a"), (7, "w w w", "a"), (None, "w w", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashed = {(r.doc_id, r.text, r.source): r.h for r in docs.withColumn("h", F.xxhash64("doc_id", common.text_key(), F.lit("mix"))).collect()}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    goal = water_fill(dict(sizes))
    stream = []
    for s in sizes:
        run = 0
        for i, t in sorted(((i, t) for i, t, x in rows if x == s), key=lambda r: (hashed[r[0], r[1], s], r[0] is not None, r[0] or 0)):
            run += len(words(t))
            for n in range(2):
                if words(t):
                    stream.append((run / goal[s] + n * sizes[s] / goal[s], hashed[i, t, s], -(1 << 63) if i is None else i, n, i, t))
    taken, total = Counter(), 0
    entries = sorted(stream, key=lambda e: e[:4])
    for at, e in enumerate(entries):
        total += len(words(e[5]))
        if total > sum(goal.values()) + 1e-6:
            break
        taken[e[4], e[5]] += len(words(e[5]))
    got = Counter()
    for r in mixing.mix(docs.withColumn("text", F.col("text"))).collect():
        got[r.doc_id, r.size] += r.taken
    want = Counter()
    for (i, t), n in taken.items():
        want[i, len(words(t))] += n
    assert +got == +want and at > 0
    ordered = [r.finish_time for r in mixing.op5_mix(docs).collect()]
    assert ordered == sorted(ordered, key=lambda x: (x is not None, x or 0))


def test_a_conversation_over_many_partitions(spark):
    rng = random.Random(2)
    turns = [(None, n, rng.choice("ua"), f"t{n}") for n in range(600)] + [(1, n, r, t) for n, (_, _, r, t) in enumerate([(0, 0, "u", "a"), (0, 0, "a", "b")])]
    turns += [(2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "a", "b"), (3, 2, "u", "c")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(6)
        rolled = chat.prefixes(frame).collect()
        kept = {r.conv_id: (r.n_turns, r.rendered) for r in chat.render(frame).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r.nth for r in rolled if r.conv_id is None) == list(range(1, 601)) and [r.nth for r in rolled if r.last and r.conv_id is None] == [600]
    marks = {(r.nth, r.h, r.g) for r in rolled}
    assert len(marks) == 600 + 3  # conversations 1 to 3 share their prefixes
    assert {k: v[0] for k, v in kept.items()} == {None: 600, 3: 3} and kept[None][1].count("<|end|>") == 600 and kept[None][1].index("t0<") < kept[None][1].index("t599<")


def test_archives_of_few_records(spark, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS", 3)
    rows = [(i, f"u/{i}", f"page {i % 8} " * (8000 if i % 5 == 0 else 3)) for i in range(40)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter(tuple(r) for r in warc.op3_warc(pages).collect())
    first = {}
    for i, _, h in rows[:40]:
        first.setdefault(h, i)
    want = Counter((i, len((h or "").encode()), warc.payload_digest((h or "").encode()), "response" if first.get(h, i) == i else "revisit", None if first.get(h, i) == i else first[h]) for i, _, h in rows)
    assert got == want
    path = common.scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    payloads = {r.name.split(":")[2]: bytes(r.payload) for r in warc.read_archives(spark, path).where("kind = 'response' and intact").collect()}
    assert payloads["0"] == rows[0][2].encode()


def test_broken_segments():
    records = warc.page_records(1, "u", "x" * 100, None, "s", segment=64)
    parsed = list(warc.parse_archive(__import__("io").BytesIO(b"\r\n\r\n".join(records) + b"\r\n\r\n")))
    first = Counter([tuple(parsed[0][c] for c in ("name", "kind", "refers_to", "digest", "block"))])
    parts = {r["number"]: r["block"] for r in parsed[1:]}
    whole = list(warc.assembled(first, parts, parsed[-1]["total"], True))
    assert whole[0]["payload"] == b"x" * 100 and whole[0]["intact"]
    gap = {n: b for n, b in parts.items() if n != 2}
    assert all(r["payload"] is None and not r["intact"] for r in [*warc.assembled(first, gap, None, True), *warc.assembled(first, parts, 7, True)])


def proximity(text, item, slack=4):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    w, v = split(text), split(item)
    n = min(8, len(v))
    wins = [set(v[i : i + n]) for i in range(len(v) - n + 1)] if v else []
    return any(win <= set(w[s : s + n + slack]) for win in wins for s in range(len(w)))


def test_proximity_in_the_result(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(None, None), (99, "")]
    items = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 12)))) for i in range(12)] + [(50, None)]
    got = {r.doc_id: r.n_near for r in decontaminate.op1_decontaminate(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {i: sum(proximity(t, x) for _, x in items) for i, t in rows} and max(got.values()) > 2


@pytest.mark.parametrize("sizes", [{"chunk": 1 << 9, "texts": 4}, {"heavy": 8, "rows": 64}, {"heavy": 2, "rows": 1}, {"pivots": 0, "texts": 7}])
def test_near_copies_in_small_pieces(spark, sizes):
    """The bounds are arguments, since workers import the module anew."""
    from .test_near_copies import kept, made

    rows = made(5, [f"Common{i}" for i in range(20)])
    got = sorted(r.doc_id for r in near_copies.one_of_each(spark.createDataFrame(rows, DOCS), near_copies.Sizes(**sizes)).collect())
    assert got == kept(rows)


def test_heavy_runs_join_nothing_without_a_comparison(spark):
    rng = random.Random(12)
    shared = " ".join(f"license{i}" for i in range(40))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(120)) + " " + shared) for i in range(150)]
    copied = rows[3][1].split()
    rows += [(200 + i, " ".join(w if n != 7 * i + 3 else f"other{i}" for n, w in enumerate(copied))) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    common = near_copies._common(docs)
    prints = docs.select("doc_id", common_key().alias("own"), near_copies.prints(F.col("text"), common).alias("p")).select("doc_id", "own", "p.*")
    stored = common_stored(prints)
    nodes = stored.where("n > 0").dropDuplicates(["sig"])
    shared_runs = nodes.select(F.explode("firsts").alias("s"), "sig")
    for heavy in (50, 10, 3):
        runs = near_copies._bounded_runs(shared_runs, nodes, heavy)
        assert runs.groupBy("s").count().agg(F.max("count")).first()[0] <= 3 * heavy  # tiles are dealt by a hash
        linked = near_copies.links(docs, stored, near_copies.Sizes(heavy=heavy)).collect()
        near = {r.sig for r in stored.where("doc_id = 3 or doc_id >= 200").collect()}
        assert {r.a for r in linked} | {r.b for r in linked} <= near
        assert {r.root for r in simhash.components(spark.createDataFrame(linked)).collect()} == {min(near)} and len(near) == 13


def test_runs_over_several_batches():
    import pyarrow as pa

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 62, (3, 4))
    rows = sorted((s, 100 + int(rng.integers(0, 3)), i, s * 40 % 3) for i, s in enumerate([*[1] * 200, *[2] * 90, *[3] * 5, 4]))
    flip = [[int(v) ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)) for v in base[k]] for *_, k in rows]
    cols = {"s": [r[0] for r in rows], "sig": [r[2] for r in rows], "fp": [f[0] for f in flip], "n": [r[1] for r in rows], **{f"w{i}": [f[i] for f in flip] for i in (1, 2, 3)}}
    batch = pa.RecordBatch.from_pydict(cols)
    for size, most in ((1000, 1 << 16), (7, 1), (13, 50)):
        parts = [batch.slice(at, size) for at in range(0, len(batch), size)]
        edges = [tuple(r.values()) for b in near_copies._runs(iter(parts), most) for r in b.to_pylist()]
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(a)] = find(b)
        assert len({find(r[2]) for r in rows}) == 4 and all(find(a) == find(b) for (s, _, a, _), (z, _, b, _) in zip(rows, rows[1:]) if s == z)


def test_any_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    prints = np.array([int(base) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 40), replace=False)) for _ in range(150)], np.uint64)
    table = simhash.planes(prints)
    for radius in (0, 2, 7, 26, 63):
        for lag in (1, 63, 64, 100):
            want = [i for i in range(150 - lag) if (int(prints[i]) ^ int(prints[i + lag])).bit_count() <= radius]
            assert simhash.within_radius(table, lag, np.ones(150 - lag, bool), radius).tolist() == want


def test_toxic_labels_of_any_kind(spark):
    rows = [(i, f"bad word{i}" if i % 3 == 0 else f"good word{i}") for i in range(60)]
    docs = spark.createDataFrame([*rows, (0, "other text of one id"), (3, None)], DOCS)
    for low, high in ((0, 1), (1, 5), (-3, 0)):
        labels = spark.createDataFrame([(i, high if i % 3 == 0 else low) for i in range(60)], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels)
        grades = {r.text: r.grade for r in toxicity.graded(docs, model).collect()}
        assert grades["bad word3"] > 0 == grades["good word1"]
        again = toxicity.fit(docs.repartition(5), labels)
        assert again.weights == model.weights and again.thresholds == model.thresholds


def test_severity_of_a_model():
    model = toxicity.Model({"bad": 1.5, "word*": 0.5}, [0.2, 1.1])
    above = [1 / (1 + math.exp(t - 2.0)) for t in model.thresholds]
    severity, p, grade = model.severity("Bad words, bad")
    assert severity == pytest.approx(sum(above)) and p == pytest.approx(above[0])
    shares = [1 - above[0], above[0] - above[1], above[1]]
    assert grade == shares.index(max(shares))


def test_ids_with_several_texts(spark):
    line = "a line that is long enough to be shared by many documents"
    rows = [(1, f"{line}\n{i}") for i in range(4)] + [(2, line), (2, line), (None, line)]
    got = Counter(tuple(r) for r in line_dedup.op10_lines(spark.createDataFrame(rows, DOCS)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == Counter([*[(1, 2, 1, sha(str(i))) for i in range(4)], (2, 1, 0, sha(line)), (2, 1, 0, sha(line)), (None, 1, 1, sha(""))])


def test_sole_rules(spark):
    rows = [(1, "few words"), (2, " ".join(f"word{i}" for i in range(40))), (3, " ".join(f"WORD{chr(65 + i)}" for i in range(26)))]
    got = {r.doc_id: (r.kept, r.sole_rule) for r in quality.op4_quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: (False, "too_short"), 2: (True, None), 3: (False, "capitals")}



def test_blocks_of_whole_records_are_not_shuffled():
    import pyarrow as pa

    records = [*warc.page_records(1, "u", "x" * 100, None, "s"), *warc.page_records(2, "u", "y" * 100, None, "s", segment=64)]
    batch = pa.RecordBatch.from_pydict({"content": [b"\r\n\r\n".join(records) + b"\r\n\r\n"]})
    rows = [r for b in warc._parse(False)(iter([batch])) for r in b.to_pylist()]
    assert (rows[0]["block"], rows[0]["bytes"], rows[0]["sha1"], rows[0]["intact"]) == (b"", 100, warc.payload_digest(b"x" * 100), True)
    assert len(rows) > 2 and all(r["block"] and r["intact"] is None for r in rows[1:])
    assert all(r["block"] for b in warc._parse(True)(iter([batch])) for r in b.to_pylist())
