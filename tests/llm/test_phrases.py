"""Collocations against counts of all runs of words in plain Python."""

import random
import re
from collections import Counter

import pytest
from tessera.llm import phrases

SCHEMA = "lang string, text string, phrase int"


def brute(rows, least, cover=80):
    f, n = Counter(), Counter()
    for lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = set()
    for (lang, p), a in cand.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                if 100 * a >= cover * f[lang, p[i : i + m]]:
                    covered.add((lang, p[i : i + m]))
    out = {}
    for (lang, p), a in cand.items():
        if (lang, p) not in covered:
            s, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out[lang, " ".join(p)] = (len(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s)
    return out


def made(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "zu", "new", "york", "city", "hall", "a", "b c", "x\x00y", "#", "aa", "ab", "b", "ß", "\U0001f600"]
    fixed = ["new york city hall", "of the", "a a a a a a", "b c zu é"]
    rows = []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))]
        text = "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for p in parts)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text, 0))
    return rows + [("en", None, 0), ("", "", 0), ("fr", "the the", 0)]


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"shard": 60, "size": 150, "nodes": 40, "sample": 1 << 30}), (3, {"shard": 500, "size": 60, "nodes": 1, "sample": 2000})])
def test_collocations(spark, seed, sizes):
    rows = made(seed)
    for least, cover in ((3, 80), (2, 101)):
        want = brute(rows, least, cover)
        frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = {(r.lang, r.phrase): (r["size"], r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(frame, least, cover, **sizes).collect()}
        assert got == want and len(want) > 30


def test_ranks_and_an_empty_table(spark):
    rows = [("en", "big dog. " * 40, 0), ("en", "red cat. " * 40, 0), (None, "one two, " * 31, 0)]
    got = [tuple(r) for r in phrases.op11_phrases(spark.createDataFrame(rows, SCHEMA)).orderBy("lang", "rank").collect()]
    assert got == [("en", 1, "big dog", 40, 40, 40, 160, 1_000_000), ("en", 2, "red cat", 40, 40, 40, 160, 1_000_000), ("und", 1, "one two", 31, 31, 31, 62, 1_000_000)]
    assert phrases.op11_phrases(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_long_text_and_a_hot_word(spark):
    text = " ".join("the" if i % 2 else f"w{i % 50}" for i in range(120_000))
    rows = [("en", text, 0)]
    got = {(r.lang, r.phrase): (r["size"], r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(spark.createDataFrame(rows, SCHEMA), 30, shard=1000, size=1 << 15).collect()}
    assert got == brute(rows, 30)


def counts(trie):
    out, names = {}, [[()]]
    for d, (parent, word, count, mark) in enumerate(trie.levels):
        above = names[-1]
        names.append([above[p] + (trie.names[w].as_py(),) for p, w in zip(parent.tolist(), word.tolist(), strict=True)])
        assert names[-1] == sorted(names[-1])
        out |= {n: (c, bool(m)) for n, c, m in zip(names[-1], count.tolist(), mark.tolist(), strict=True)}
    return out


def test_pieces_of_tries():
    rng = random.Random(7)
    shards = [phrases.words(" ".join(rng.choice("abcde.") for _ in range(80)).encode()) for _ in range(4)]
    cuts = sorted([[b"a"], [b"b", b"c"], [b"b", b"c", b"d"], [b"b", b"c", b"d", b"e"], [b"c", b"zz"], [b"d", b"d"], [b"f"]])
    want = Counter()
    for tokens in shards:
        for n, (c, _) in counts(phrases.built(tokens)).items():
            want[n] += c
    pieces = {}
    for tokens in shards:
        for number, piece in phrases.cut(phrases.built(tokens), cuts):
            again = phrases.read(phrases.written(piece))
            assert counts(again) == counts(piece)
            pieces.setdefault(number, []).append(again)
    got = {}
    for number, tries in pieces.items():
        for n, (c, mark) in counts(phrases.merged(tries)).items():
            if mark:
                assert c == want[n]  # ancestors have the counts of all shards
            else:
                assert n not in got
                got[n] = c
    assert got == dict(want)
