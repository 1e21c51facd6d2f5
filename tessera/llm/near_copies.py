"""Near copies by the Jaccard similarity of word shingles: wide SimHash, and an exact check.

Fingerprints of similar texts can differ in many bits, so keys of equal bits would lose pairs.  Two sets that are
similar enough share one of the first shingles of either, in any order that all texts agree on; so runs of
equal first shingles hold every pair.  Shingles that a sample of texts finds common come last, which
keeps runs short; the sample decides about speed alone.  Most first shingles are those of one text alone and go before
anything else moves.  The texts of a run that is too large for a task meet on least hashes instead, of which similar sets share four in five, then on two
of them, and what still is too large is dealt into tiles of which every two meet; no text joins another without a comparison.  Within a run fingerprints
are compared in bit slices, what is within the radius by further words of the fingerprint,
and edges make groups that hold every pair.  The further words tell unrelated texts apart: with 64 bits alone one in twelve
pairs is joined, and the groups of a large table grow into one.  A group is cut into chunks of about one size;
each pair of chunks whose sizes fit is compared in the same way again, and what is left by the shingles themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, bounded, discard, fresh, scope, stored, sweep, text_key
from .simhash import components, forest

SHINGLE = 5
#: Least similarity, as a fraction of whole numbers.
PART, WHOLE = 4, 5
SEED = 42
#: Sets of similarity 0.8 differ in 9.7 of 64 bits on average; the chance of more than this many is 1.4e-7 there, and less above.
RADIUS = 26
#: Further words of a fingerprint, and the bits of all its words in which similar sets differ at most. Sets of four and five shingles differ most, in 48 of
#: 256 bits on average; unrelated ones in 128.
WORDS, WIDE = 3, 84
#: Texts that are sampled for common shingles, the count there that makes one common, and the most that are kept.
SAMPLE, COMMON, MOST = 20_000, 3, 1 << 18
#: Runs above this are keyed anew.
HEAVY = 1 << 14
#: Least hashes under which the texts of such a run meet, and again under two. Sets of similarity 0.8 share none of so many with a chance of 4e-9.
MINS = 12
#: Rows of runs that are compared in one go, unless one run is larger.
ROWS = 1 << 16
#: Shingles in a chunk of a group, and texts at most.
CHUNK, TEXTS = 1 << 20, 1 << 9
#: Chunks of a class of sizes are numbered below this.
CHUNKS = 1 << 40
#: Representatives up to this many are broadcast to the texts.
BROADCAST_ROWS = 200_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the runs of ``size`` words, or of all words if there are fewer; empty for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    known = {w: digest(w, SEED) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = (out ^ h[i : i + n]) * _ODD
        out ^= out >> np.uint64(29)
    return np.unique(out)


def fingerprint(found: np.ndarray) -> int:
    """The 64-bit SimHash of a set of shingles; 0 for an empty one."""
    counts, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, len(found), step):
        counts += np.unpackbits(found[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view("<u8")[0])


def wide(found: np.ndarray) -> list[int]:
    """The further words of a fingerprint: SimHashes of other hashes of the shingles."""
    out = []
    for i in range(1, WORDS + 1):
        x = found + _ODD * np.uint64(i)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(fingerprint(x ^ (x >> np.uint64(31))))
    return out


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 3, 1 << 64) for i in range(2 * MINS)], np.uint64)


def least_hashes(found: np.ndarray) -> np.ndarray:
    """The least of so many other hashes of the shingles; none for an empty set."""
    if not len(found):
        return np.empty(0, np.uint64)
    out = np.full(2 * MINS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1 << 12):
        x = found[at : at + (1 << 12), None] * _FACTORS
        out = np.minimum(out, (x ^ (x >> np.uint64(32))).min(axis=0))
    return out


def near(fp: np.ndarray, words: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Where the fingerprints at places ``i`` and ``j``, of first words ``fp`` and further ``words``, differ in ``WIDE`` bits at most."""
    return np.bitwise_count(fp[i] ^ fp[j]) + np.bitwise_count(words[i] ^ words[j]).sum(axis=1, dtype=np.int64) <= WIDE


def first_shingles(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """So many shingles that a similar set must hold one of them; ``common`` is sorted and its shingles come last."""
    n = len(found)
    if not n:
        return found
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        rank = np.where(common[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))][: n - -(-PART * n // WHOLE) + 1]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return WHOLE * both >= PART * (len(a) + len(b) - both)


def sizes_fit(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Where sets of these sizes, the second no smaller, can be similar."""
    return WHOLE * small >= PART * large


def _common(docs: DataFrame) -> Broadcast:
    """Sorted shingles that a sample of the texts finds common, and their counts there."""
    share = min(1.0, SAMPLE / max(1, docs.count()))
    sample = docs.select("text", text_key().alias("own")).where(F.pmod(F.xxhash64("own"), F.lit(1 << 20)) < int(share * (1 << 20))).dropDuplicates(["own"])

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def hashed(batch: pa.Array) -> pa.Array:
        return pa.array([shingles(x.as_py()).view(np.int64) for x in batch], pa.list_(pa.int64()))

    counted = sample.select(F.explode(hashed("text")).alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = counted.orderBy(F.desc("n"), "s").limit(MOST).toArrow()
    common, counts = top.column("s").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(common)
    return docs.sparkSession.sparkContext.broadcast((common[order], counts[order]))


_WIDE = [f"w{i}" for i in range(1, WORDS + 1)]
_PRINT = T.StructType([*(T.StructField(c, T.LongType()) for c in ("sig", "fp", "n", *_WIDE)), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("firsts", "mins"))])


def prints(text: Column, common: Broadcast) -> Column:
    """``sig, fp, n, w1..., firsts, mins`` of a text: a hash of its set of shingles, its fingerprint, size, further words of the fingerprint, first shingles and least hashes."""

    @F.arrow_udf(_PRINT)
    def run(batch: pa.Array) -> pa.Array:
        sig, fp, n, words, firsts, mins = [], [], [], [], [], []
        for x in batch:
            found = shingles(x.as_py())
            sig.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
            fp.append(fingerprint(found))
            n.append(len(found))
            words.append(wide(found))
            firsts.append(first_shingles(found, *common.value).view(np.int64))
            mins.append(least_hashes(found).view(np.int64))
        numbers = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (sig, fp, n, *(zip(*words, strict=True) if words else [[]] * WORDS))]
        return pa.StructArray.from_arrays([*numbers, *(pa.array(x, pa.list_(pa.int64())) for x in (firsts, mins))], _PRINT.names)

    return run.asNondeterministic()(text)


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edges(ids: np.ndarray, pairs: list[tuple[int, int]] | np.ndarray) -> pa.RecordBatch:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.record_batch([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], schema=_EDGES)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows ``s, sig``, sorted by ``s``, whose ``s`` another row has too."""
    s, sig, same = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    for b in batches:
        s, sig = np.concatenate([s, b.column("s").to_numpy()]), np.concatenate([sig, b.column("sig").to_numpy()])
        same = np.concatenate([same, np.zeros(len(s) - len(same), bool)])
        equal = s[1:] == s[:-1]
        same[1:] |= equal
        same[:-1] |= equal
        out = same[:-1]  # the last row may equal the next
        yield pa.RecordBatch.from_arrays([pa.array(s[:-1][out]), pa.array(sig[:-1][out])], ["s", "sig"])
        s, sig, same = s[-1:], sig[-1:], same[-1:]
    yield pa.RecordBatch.from_arrays([pa.array(s[same]), pa.array(sig[same])], ["s", "sig"])


def _star(at: np.ndarray, fp: np.ndarray, n: np.ndarray, words: np.ndarray) -> tuple[list[tuple[int, int]], bool]:
    """Edges of a run from its middle one to all that are near it, and from what is left to any; whether these are all that there are to make."""
    pivot = at[len(at) // 2]

    def close(i: int, to: np.ndarray) -> np.ndarray:
        fit = sizes_fit(np.minimum(n[i], n[to]), np.maximum(n[i], n[to]))
        return fit & (np.bitwise_count(fp[i] ^ fp[to]) <= RADIUS) & near(fp, words, np.full(len(to), i), to)

    reached = close(pivot, at)
    edges, left = [(int(pivot), int(i)) for i in at[reached & (at != pivot)]], at[~reached]
    if 4 * len(left) > len(at):
        return edges, False
    for i in left.tolist():
        edges += [(i, int(j)) for j in at[close(i, at) & (at != i)]]
    return edges, True


def run_edges(s: np.ndarray, fp: np.ndarray, n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of pairs that join, in each run of equal ``s``, the sets with near fingerprints whose sizes fit.

    Runs are sorted by size.  In a larger one a star joins most of the true copies first; if it joins three quarters, the others are compared with all.
    """
    new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    length = np.diff(np.concatenate([new, [len(s)]]))
    fp, words = fp.view(np.uint64), words.view(np.uint64)
    known, open_ = [], np.repeat(length > 1, length)
    for a, m in zip(new[length > 64].tolist(), length[length > 64].tolist(), strict=True):
        edges, whole = _star(np.arange(a, a + m), fp, n, words)
        known += edges
        open_[a : a + m] = not whole
    at = np.flatnonzero(open_)
    place = np.full(len(s), -1)
    place[at] = np.arange(len(at))
    size, first, further = n[at], fp[at], words[at]
    inside = [(int(place[a]), int(place[b])) for a, b in known if place[a] >= 0]
    found = forest(s[at], first, RADIUS, lambda i, j: sizes_fit(size[i], size[j]), known=inside, close=lambda i, j: near(first, further, i, j)) if len(at) else []
    return np.concatenate([np.array(known, np.int64).reshape(-1, 2), at[np.array(found, np.int64).reshape(-1, 2)]])


def _runs(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Edges within each run of equal ``s``; runs are bounded before they come here."""
    names = ("s", "sig", "fp", "n", *_WIDE)
    held: list[pa.RecordBatch] = []

    def done(s: np.ndarray, sig: np.ndarray, fp: np.ndarray, n: np.ndarray, *words: np.ndarray) -> pa.RecordBatch:
        return _edges(sig, run_edges(s, fp, n, np.column_stack(words)))

    def columns() -> list[np.ndarray]:
        return [np.concatenate([b.column(c).to_numpy() for b in held]) for c in names]

    count = 0
    for b in batches:
        held.append(b)
        count += len(b)
        if count >= rows:
            now = columns()
            cut = int(np.searchsorted(now[0], now[0][-1], "left"))  # the last run may go on
            if cut:
                yield done(*(c[:cut] for c in now))
            held = [pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in now], list(names))]
            count = len(held[0]) if cut else 0
    if held:
        yield done(*columns())


#: Texts that each text of a group is compared with first.
PIVOTS = 4


def _around(prints: np.ndarray, check: Callable[[int, int], bool], pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Edges to pivots, which are nearest to the majority of the bits of those that no pivot has reached."""
    left, edges = np.arange(len(prints)), []
    for _ in range(pivots):
        if len(left) < 3:
            break
        bits = np.unpackbits(prints[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = bits.sum(axis=0) * 2 > len(left)
        pivot = left[(bits != middle).sum(axis=1).argmin()]
        reached = [i for i in left.tolist() if i != pivot and check(min(i, pivot), max(i, pivot))]
        edges += [(min(i, pivot), max(i, pivot)) for i in reached]
        left = np.setdiff1d(left, [pivot, *reached])
    return edges


def unit_edges(sig: list[int], sets: list[np.ndarray], side: list[int], pivots: int = PIVOTS) -> pa.RecordBatch:
    """Edges between similar sets, sorted by size, of a pair of chunks; ``side`` tells the chunks apart, and is 0 throughout for one with itself."""
    n, sides = np.array([len(x) for x in sets], np.int64), np.array(side, np.int8)
    both = bool(sides.any())
    fp, words = np.array([fingerprint(x) for x in sets], np.uint64), np.array([wide(x) for x in sets], np.uint64)

    def may(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return sizes_fit(n[i], n[j]) & ((sides[i] != sides[j]) | (not both))

    def check(i: int, j: int) -> bool:
        return bool(sizes_fit(n[i], n[j])) and similar(sets[i], sets[j])

    found = _around(fp, check, pivots)
    found += forest(np.zeros(len(n), np.int8), fp, RADIUS, may, check, found, lambda i, j: near(fp, words, i, j))
    return _edges(np.array(sig, np.uint64).view(np.int64), found)


def _compared(batches: Iterator[pa.RecordBatch], pivots: int = PIVOTS) -> Iterator[pa.RecordBatch]:
    unit, sig, sets, side = None, [], [], []
    for b in batches:
        keys = zip(*(b.column(c).to_pylist() for c in ("root", "i", "j", "sig", "chunk")), strict=True)
        for (root, i, j, k, chunk), x in zip(keys, b.column("text"), strict=True):
            if (root, i, j) != unit:
                if len(sig) > 1:
                    yield unit_edges(sig, sets, side, pivots)
                unit, sig, sets, side = (root, i, j), [], [], []
            if sig and sig[-1] == k & (2**64 - 1):  # a repeated row
                continue
            sig.append(k & (2**64 - 1))
            sets.append(shingles(x.as_py()))
            side.append(int(chunk != i))
    if len(sig) > 1:
        yield unit_edges(sig, sets, side, pivots)


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task holds; they decide on speed and memory alone."""

    heavy: int = HEAVY
    rows: int = ROWS
    chunk: int = CHUNK
    texts: int = TEXTS
    pivots: int = PIVOTS


def _light(keyed: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows ``s, sig`` of runs of ``heavy`` rows at most, and those of larger ones, None if there are none."""
    large = stored(keyed.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") > heavy).select(F.col("s").alias("_s"), "c"), "near-heavy")
    if large.isEmpty():
        return keyed, None
    marked = keyed.join(bounded(large, BROADCAST_ROWS), F.col("s") == F.col("_s"), "left")
    return marked.where("_s is null").select("s", "sig"), marked.where("_s is not null").select("s", "sig", "c")


def _bounded_runs(shared: DataFrame, nodes: DataFrame, heavy: int) -> DataFrame:
    """``s, sig``: runs of ``heavy`` rows at most that hold every similar pair of the runs ``shared``.

    A text of larger ones is keyed by its least hashes, once however many of its runs are large; rows of runs that still are too large by each of these with
    each of the other half; and what is too large then is true copies for the most part, and falls into tiles of which every two make a run.
    """
    runs, large = _light(shared, heavy)
    if large is None:
        return runs
    both = large.select("sig").distinct().join(nodes.select("sig", "mins"), "sig")
    once = stored(both.select("sig", F.posexplode(F.slice("mins", 1, MINS)).alias("i", "m")).select("sig", F.xxhash64("i", "m").alias("s")), "near-mins")
    light, large = _light(once, heavy)
    runs = runs.unionByName(light)
    if large is None:
        return runs
    again = large.join(nodes.select("sig", "mins"), "sig").select("s", "sig", F.posexplode(F.slice("mins", MINS + 1, MINS)).alias("i", "m"))
    twice = stored(again.select(F.xxhash64("s", "i", "m").alias("s"), "sig"), "near-mins")
    light, large = _light(twice, heavy)
    runs = runs.unionByName(light)
    if large is None:
        return runs
    tiles = F.ceil(2 * F.col("c") / heavy)
    tiled = large.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("sig"), F.col("tiles")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.xxhash64("s", F.least("tile", j), F.greatest("tile", j)))
    return runs.unionByName(tiled.select(F.explode(meets).alias("s"), "sig"))


def links(docs: DataFrame, rows: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``a, b``: edges between the ``sig`` of similar sets that span each group of near copies.

    ``rows``: ``doc_id, own`` and the columns of :func:`prints` of each row of ``docs``.
    """
    nodes = rows.where("n > 0").dropDuplicates(["sig"])
    shingled = nodes.select(F.explode("firsts").alias("s"), "sig").repartition("s").sortWithinPartitions("s")
    shared = stored(shingled.mapInArrow(_shared, "s long, sig long"), "near-shared")
    sweep(docs.sparkSession)
    bound = _bounded_runs(shared, nodes, sizes.heavy)
    runs = bound.join(nodes.drop("doc_id", "own", "firsts", "mins"), "sig").repartition("s").sortWithinPartitions("s", "n", "sig")
    edges = stored(runs.mapInArrow(lambda batches: _runs(batches, sizes.rows), "a long, b long"), "near-runs")
    discard(shared)
    sweep(docs.sparkSession)
    groups = components(edges)
    first = rows.groupBy("sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own")).alias("first"), F.first("n").alias("n"))
    members = groups.join(first, F.col("node") == F.col("sig")).select("root", "sig", "n", F.col("first.doc_id").alias("_d"), F.col("first.own").alias("_o"))
    # sizes fall into classes of which similar ones are the same or next to each other, and a class of a group into chunks by a hash
    members = members.withColumn("class", F.floor(F.log("n") / math.log(WHOLE / PART)))
    weight = members.groupBy(F.col("root").alias("_r"), F.col("class").alias("_c")).agg(F.ceil(F.sum(F.greatest("n", F.lit(sizes.chunk // sizes.texts))) / sizes.chunk).alias("chunks"))
    dealt = members.join(weight, (F.col("root") == F.col("_r")) & (F.col("class") == F.col("_c")))
    members = stored(dealt.withColumn("chunk", F.col("class") * CHUNKS + F.pmod(F.xxhash64("sig"), F.col("chunks"))).drop("_r", "_c", "chunks"), "near-members")
    spans = members.select("root", "class", "chunk").distinct()
    other = spans.select(F.col("root").alias("_r"), F.col("class").alias("_k"), F.col("chunk").alias("_c"))
    meets = spans.join(other, (F.col("root") == F.col("_r")) & (F.col("_k") - F.col("class")).between(0, 1) & (F.col("chunk") <= F.col("_c")))
    units = meets.select("root", F.col("chunk").alias("i"), F.col("_c").alias("j"), F.explode(F.array_distinct(F.array("chunk", "_c"))).alias("chunk"))
    sent = members.join(units, ["root", "chunk"]).select("root", "i", "j", "chunk", "sig", "n", "_d", "_o")
    texts = docs.select("doc_id", "text", text_key().alias("own"))
    ship = texts.join(bounded(sent, BROADCAST_ROWS), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("own") == F.col("_o")))
    ship = ship.select("root", "i", "j", "chunk", "sig", "n", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "n", "sig")
    return ship.mapInArrow(lambda batches: _compared(batches, sizes.pivots), "a long, b long")


def one_of_each(docs: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """``docs`` with the first document in order of id of each group of near copies, nulls last; of repeated rows, one.

    Texts without words, null among them, are copies of each other, and so are texts with equal sets of shingles.
    An empty table gives an empty one; a very long text is one set of shingles, read whole.  Columns of any name pass through.
    """
    own, id_, key = fresh(docs, "_own", "_id", "_key")
    light = docs.select("doc_id", "text")
    with scope(docs.sparkSession) as keep:
        common = _common(light)
        printed = light.select("doc_id", text_key().alias("own"), prints(F.col("text"), common).alias("p"))
        rows = stored(printed.select("doc_id", "own", "p.*"), "near-prints")
        linked = stored(links(light, rows, sizes), "near-links")
        sweep(docs.sparkSession)
        group = components(linked)
        order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "own")
        best = rows.join(group, F.col("sig") == F.col("node"), "left").groupBy(F.coalesce("root", "sig").alias("root")).agg(F.min(order).alias("best"))
        best = keep(stored(best.select(F.col("best.doc_id").alias(id_), F.col("best.own").alias(key)), "near-best"))
        repeated = not rows.groupBy("doc_id", "own").count().where("count > 1").isEmpty()
    sweep(docs.sparkSession)
    found = docs.withColumn(own, text_key()).join(best, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left_semi")
    return (found.dropDuplicates(["doc_id", own]) if repeated else found).drop(own)
