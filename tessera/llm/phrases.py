"""Phrase collocations from depth-limited count tries.

Each shard of a task's texts becomes one trie a language, of depth ``DEPTH``: level by level, a node is a parent and a word with a count.
Words have numbers in the order of their bytes, so that every level is sorted.  A trie is cut at phrases that are the same
for all shards, and the pieces of a range meet in one task, where the sorted runs are merged level by level.  A piece brings the
ancestors of its first phrase with it, so that the walk up a merged trie gives the counts of all left parts.  Right parts are other phrases, a word
shorter at the front: suffix links, one join for each level, since the right parts of a phrase are its link and the right parts of that.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, bounded, scope, stored, sweep

DEPTH = 4
LEAST = 30
#: A candidate goes if a longer one that holds it has this share, in percent, of its occurrences.
COVER = 80
TOP = 2000
SCALE = 2_000_000
#: Words in a shard, bytes of text for each range, and nodes that a range holds before they are merged.
SHARD, RANGE, NODES = 1 << 20, 1 << 22, 1 << 21
#: Bytes of text from which the cuts are drawn; they decide on balance alone.
SAMPLE = 1 << 22
#: Phrases up to this many are broadcast.
BROADCAST_ROWS = 50_000

_BREAK = b"\xff"  # in no UTF-8 text, and after all words in order
_FOLD = bytes.maketrans(UPPER.encode() + b".,;:!?\n\x0b\x0c\r\t", LOWER.encode() + _BREAK * 10 + b" ")
_MASK = np.int64(0xFFFFFFFF)


def words(text: bytes) -> list[bytes]:
    """The words of a text, with :data:`_BREAK` between pieces and at the end."""
    return (text.translate(_FOLD) + _BREAK).replace(_BREAK, b" \xff ").split()


class Trie:
    """``names``: the words in order of their bytes; ``levels``: ``parent, word, count, mark`` of the nodes of each level, in order.

    Parents are places in the level above, and words places in ``names``.  Marked nodes belong to another range.
    """

    def __init__(self, names: pa.Array, levels: list[tuple[np.ndarray, ...]]):
        self.names, self.levels = names, levels

    def __len__(self) -> int:
        return sum(len(x[0]) for x in self.levels)


def ordered(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values in order of their bytes, and the place of each value among them."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def built(tokens: list[bytes], depth: int = DEPTH) -> Trie:
    """The trie of all runs of up to ``depth`` words that no break cuts."""
    names, word = ordered(pa.array(tokens, pa.binary()))
    last = len(names) - 1  # a shard ends with a break
    at = np.flatnonzero(word != last)
    count = np.bincount(word, minlength=len(names))[:last].astype(np.int64)
    levels = [(np.zeros(last, np.int64), np.arange(last, dtype=np.int64), count, np.zeros(last, bool))]
    node = word[at]
    for d in range(1, depth):
        goes = word[at + d] != last
        at, node = at[goes], node[goes]
        key, node, count = np.unique((node << 32) | word[at + d], return_inverse=True, return_counts=True)
        levels.append((key >> 32, key & _MASK, count.astype(np.int64), np.zeros(len(key), bool)))
    return Trie(names.slice(0, last), levels)


def places(trie: Trie, keys: list[np.ndarray], phrase: list[bytes]) -> list[tuple[int, bool]]:
    """For each level, the nodes before ``phrase`` and whether the last of them is its ancestor; ``keys`` joins parents and words of the levels."""
    out, above, on = [], 0, True
    for d, key in enumerate(keys):
        found = False
        if on and d < len(phrase):
            name = _rank(trie.names, phrase[d])
            at = int(np.searchsorted(key, (above << 32) | name))
            found = at < len(key) and key[at] == ((above << 32) | name) and name < len(trie.names) and trie.names[name].as_py() == phrase[d]
        else:
            at = int(np.searchsorted(key, above << 32))
        inner = bool(found and d + 1 < len(phrase))
        out.append((at + inner, inner))
        above, on = at, found
    return out


def _rank(names: pa.Array, word: bytes) -> int:
    low, high = 0, len(names)
    while low < high:
        mid = (low + high) // 2
        if names[mid].as_py() < word:
            low = mid + 1
        else:
            high = mid
    return low


def cut(trie: Trie, phrases: list[list[bytes]]) -> Iterator[tuple[int, Trie]]:
    """The pieces of a trie between sorted ``phrases``, by number, that hold a node; the ancestors of a piece's first phrase come with it, marked."""
    ends = [len(x[0]) for x in trie.levels]
    keys = [(parent << 32) | word for parent, word, *_ in trie.levels]
    cuts = [[(0, False)] * len(ends), *(places(trie, keys, p) for p in phrases), [(n, False) for n in ends]]
    for number, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
        start = [n - mark for n, mark in a]
        if all(s >= e for s, (e, _) in zip(start, z, strict=True)):
            continue
        levels = []
        for d, (parent, word, count, _) in enumerate(trie.levels):
            part = slice(start[d], max(start[d], z[d][0]))
            mark = np.zeros(part.stop - part.start, bool)
            mark[: int(a[d][1])] = True
            levels.append((parent[part] - (start[d - 1] if d else 0), word[part], count[part], mark))
        used, rank = np.unique(np.concatenate([w for _, w, *_ in levels]), return_inverse=True)
        ranks = np.split(rank, np.cumsum([len(w) for _, w, *_ in levels])[:-1])
        yield number, Trie(trie.names.take(pa.array(used)), [(p, r, c, m) for (p, _, c, m), r in zip(levels, ranks, strict=True)])


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers, byte by byte: the high bytes are mostly nought."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def written(trie: Trie) -> bytes:
    """A trie as bytes, in order: its words, then for each level how many children each parent has, words, counts and marks."""
    names = trie.names.to_pylist()
    parts = [np.array([len(names), *(len(x[0]) for x in trie.levels)], "<i8").tobytes()]
    text = b" ".join(names)
    parts += [np.array([len(text)], "<i8").tobytes(), text]
    above = 1
    for parent, word, count, mark in trie.levels:
        parts += [_planes(np.bincount(parent, minlength=above)), _planes(word), _planes(count), np.packbits(mark).tobytes()]
        above = len(parent)
    return zstandard.compress(b"".join(parts), 3)


def read(data: bytes, depth: int = DEPTH) -> Trie:
    raw = zstandard.decompress(data)
    head = np.frombuffer(raw, "<i8", depth + 2)
    at = 8 * (depth + 2)
    names = pa.array(raw[at : at + head[-1]].split(b" ") if head[0] else [], pa.binary())
    at += int(head[-1])

    def numbers(n: int) -> np.ndarray:
        nonlocal at
        out = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel().astype(np.int64)
        at += 8 * n
        return out

    levels, above = [], 1
    for n in head[1:-1].tolist():
        parent = np.repeat(np.arange(above), numbers(above))
        word, count = numbers(n), numbers(n)
        mark = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        levels.append((parent, word, count, mark))
        above = n
    return Trie(names, levels)


def merged(tries: list[Trie]) -> Trie:
    """One trie with the counts of all: equal nodes of the sorted levels add up."""
    if len(tries) == 1:
        return tries[0]
    names, rank = ordered(pa.chunked_array([t.names for t in tries]).combine_chunks())
    starts = np.cumsum([0, *(len(t.names) for t in tries)])
    places_, levels = [np.zeros(1, np.int64)] * len(tries), []
    for d in range(len(tries[0].levels)):
        keys = [(places_[i][t.levels[d][0]] << 32) | rank[starts[i] + t.levels[d][1]] for i, t in enumerate(tries)]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")  # merges runs that are sorted
        sorted_ = flat[order]
        new = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(flat) else np.empty(0, bool)
        first = np.flatnonzero(new)
        place = np.empty(len(flat), np.int64)
        place[order] = np.cumsum(new) - 1
        count = np.add.reduceat(np.concatenate([t.levels[d][2] for t in tries])[order], first) if len(first) else np.empty(0, np.int64)
        mark = np.concatenate([t.levels[d][3] for t in tries])[order][first]
        key = sorted_[first]
        levels.append((key >> 32, key & _MASK, count, mark))
        places_ = np.split(place, np.cumsum([len(k) for k in keys])[:-1])
    return Trie(names, levels)


_FOUND = "lang string, size int, phrase string, a long, left array<long>"


def frequent(trie: Trie, lang: str, least: int) -> pa.RecordBatch:
    """The phrases of the range that are found ``least`` times, each with the counts of its left parts, and how many words there are."""
    names = trie.names.to_pylist()
    size, phrase, found, left = [0], [None], [int(trie.levels[0][2][~trie.levels[0][3]].sum())], [[]]
    for d, (_, _, count, mark) in enumerate(trie.levels):
        at = np.flatnonzero((count >= least) & ~mark)
        chain, up = [], at
        for e in range(d, -1, -1):
            parent, word, n, _ = trie.levels[e]
            chain.append((word[up].tolist(), n[up].tolist()))
            up = parent[up]
        chain.reverse()
        for i in range(len(at)):
            size.append(d + 1)
            phrase.append(b" ".join([names[w[i]] for w, _ in chain]))
            found.append(chain[-1][1][i])
            left.append([n[i] for _, n in chain[:-1]])
    text = pa.array(phrase, pa.binary()).cast(pa.string())
    return pa.record_batch([pa.array([lang] * len(size)), pa.array(size, pa.int32()), text, pa.array(found, pa.int64()), pa.array(left, pa.list_(pa.int64()))], names=[f.split()[0] for f in _FOUND.split(", ")])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def _cuts(texts: DataFrame, bytes_: dict[str, int], size: int, sample: int) -> dict[str, list[list[bytes]]]:
    """For each language, phrases that cut the tries of a sample of its texts into ranges of about equal size."""
    total = sum(bytes_.values())
    share = int(min(1.0, sample / max(1, total)) * (1 << 20))
    ranges = {lang: -(-n // size) for lang, n in bytes_.items()}

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set] = defaultdict(set)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                for i in range(len(w)):
                    run = w[i : i + DEPTH]
                    run = run[: run.index(_BREAK)] if _BREAK in run else run
                    if run:
                        seen[lang].add(b" ".join(run))
        for lang, runs in seen.items():
            runs = sorted((r.split(b" ") for r in runs))
            n = ranges.get(lang, 1)
            cuts = sorted({tuple(runs[i * len(runs) // n]) for i in range(1, n)})
            yield pa.record_batch([pa.array([lang] * len(cuts), pa.string()), pa.array([b" ".join(c) for c in cuts], pa.binary())], names=["lang", "phrase"])

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share).dropDuplicates(["lang", "text"]).repartition(1)
    out: dict[str, list[list[bytes]]] = defaultdict(list)
    for lang, phrase in some.mapInArrow(drawn, "lang string, phrase binary").collect():
        out[lang].append(bytes(phrase).split(b" "))
    return {lang: sorted(p) for lang, p in out.items()}


def counted(docs: DataFrame, least: int = LEAST, shard: int = SHARD, size: int = RANGE, sample: int = SAMPLE, nodes: int = NODES) -> DataFrame:
    """``lang, size, phrase, a, left``: the phrases of up to ``DEPTH`` words that are found ``least`` times or more, and rows of size 0 that tell how many words a range has.

    ``left`` are the counts of the phrase's first word, first two words and so on.
    """
    texts = _texts(docs)
    sizes = {r.lang: r.n for r in texts.groupBy("lang").agg(F.sum(F.length("text")).cast("long").alias("n")).collect()}
    cuts = docs.sparkSession.sparkContext.broadcast(_cuts(texts, sizes, size, sample))

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)

        def done() -> Iterator[pa.RecordBatch]:
            for lang, tokens in held.items():
                for number, piece in cut(built(tokens), cuts.value.get(lang, [])):
                    yield pa.record_batch([pa.array([lang]), pa.array([number], pa.int32()), pa.array([written(piece)], pa.binary())], names=["lang", "number", "trie"])
            held.clear()

        n = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = words(text)
                held[lang] += found
                n += len(found)
                if n >= shard:
                    yield from done()
                    n = 0
        yield from done()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for b in batches:
            for lang, number, data in zip(b.column("lang").to_pylist(), b.column("number").to_pylist(), b.column("trie"), strict=True):
                if key is not None and key != (lang, number):
                    yield frequent(merged(held), key[0], least)
                    held, n = [], 0
                key = (lang, number)
                held.append(read(data.as_py()))
                n += len(held[-1])
                if n >= nodes and len(held) > 1:
                    held = [merged(held)]
                    n = 0  # what is merged is as large as the range
        if held:
            yield frequent(merged(held), key[0], least)

    pieces = texts.mapInArrow(tries, "lang string, number int, trie binary").repartition("lang", "number").sortWithinPartitions("lang", "number")
    return pieces.mapInArrow(merge, _FOUND)


def _linked(found: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``found`` phrases of two words or more with ``right``, the counts of all but their first word, their first two words and so on."""
    below = found.where("size = 1").select("lang", "phrase", "a", F.array().cast("array<long>").alias("right"))
    out = None
    for n in range(2, depth + 1):
        link = below.select(F.col("lang").alias("_l"), F.col("phrase").alias("_p"), F.concat(F.array("a"), "right").alias("right"))
        here = found.where(F.col("size") == n).withColumn("rest", F.expr("substring(phrase, instr(phrase, ' ') + 1)"))
        here = here.join(bounded(link, BROADCAST_ROWS), (F.col("lang") == F.col("_l")) & (F.col("rest") == F.col("_p"))).select("lang", "size", "phrase", "a", "left", "right")
        out = here if out is None else out.unionByName(here)
        below = here.select("lang", "phrase", "a", "right")
    return out


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, **sizes: int) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of the candidates that no longer one covers.

    The score is that of the cut with the least, of equal ones the first.  Null languages are ``und`` and null texts empty; repeated rows count
    each; texts of any length are read whole, an empty table gives no rows, and other columns are ignored.  A text is never split over shards.
    """
    with scope(docs.sparkSession) as keep:
        found = stored(counted(docs, least, **sizes), "phrases")
        sweep(docs.sparkSession)
        total = found.where("size = 0").groupBy(F.col("lang").alias("_t")).agg(F.sum("a").alias("n"))
        wide = lambda c: c.cast("decimal(20,0)")
        linked = stored(_linked(found), "linked")
        options = F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), F.element_at("left", k).alias("l"), F.element_at("right", k).alias("r")))
        scored = linked.withColumn("o", F.explode(options)).withColumn("score", F.expr(f"(CAST(a AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(7,0))) DIV (CAST(o.l AS DECIMAL(20,0)) + CAST(o.r AS DECIMAL(20,0)))"))
        best = scored.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "o.k", "o.l", "o.r")).alias("best"))
        best = best.select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")
        w = F.split("phrase", " ")
        inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
        longer = linked.where("size > 2").select("lang", "a", F.explode(inside).alias("part")).groupBy(F.col("lang").alias("_l"), F.col("part").alias("_p")).agg(F.max("a").alias("longest"))
        covered = wide(F.col("longest")) * 100 >= wide(F.col("a")) * cover
        kept = best.join(longer, (F.col("lang") == F.col("_l")) & (F.col("phrase") == F.col("_p")), "left").where(F.col("longest").isNull() | ~covered)
        out = kept.join(F.broadcast(total) if total.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else total, F.col("lang") == F.col("_t"))
        return keep(stored(out.select("lang", "phrase", "size", "a", "l", "r", "n", "score"), "collocations"))


def op11_phrases(docs: DataFrame) -> DataFrame:
    """The first ``TOP`` of each language by score, occurrences and phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, m, array_to_string(ws[i : i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, range(1, 5) AS s(m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 30),
k AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1 : m], ' ') AS rp FROM f, range(1, 4) AS s(k) WHERE k < m),
c AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.a AS l, y.a AS r, (2000000 * k.a::HUGEINT) // (x.a::HUGEINT + y.a::HUGEINT) AS score
  FROM k JOIN f AS x ON x.lang = k.lang AND x.phrase = lp JOIN f AS y ON y.lang = k.lang AND y.phrase = rp),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, part, max(a) AS longest FROM (SELECT lang, a, unnest(list_concat(
    list_transform(range(1, m), lambda i: array_to_string(string_split(phrase, ' ')[i : i + 1], ' ')),
    CASE WHEN m = 4 THEN list_transform(range(1, 3), lambda i: array_to_string(string_split(phrase, ' ')[i : i + 2], ' ')) ELSE [] END)) AS part FROM f WHERE m > 2) GROUP BY lang, part)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM b LEFT JOIN g ON g.lang = b.lang AND g.part = b.phrase JOIN t ON t.lang = b.lang
WHERE longest IS NULL OR 100 * longest::HUGEINT < 80 * a::HUGEINT
QUALIFY row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
