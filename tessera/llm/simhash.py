"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that differ in at most two bits agree in two of four 16-bit
blocks, so six tables of 32-bit keys bring every such pair together once at least.
Within a run of equal keys, the fingerprints lie as vertical bit planes: 64 words, one for each
bit, each with a lane for every fingerprint.  Shifting the planes by a lag compares
every lane with the one that lies so far off; differing bits are added up by carry-save
adders, and words of lanes leave once all their lanes are over the radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, UPPER, fresh, scope, stored, text_key

SHINGLE = 3
SEED = 42
RADIUS = 2
BLOCKS = 4
#: Fingerprints that are compared in one go, unless one run of equal keys is larger.
CHUNK = 1 << 18
#: Runs above this get narrower keys.
HEAVY = 1 << 14
#: Edges in a file of a step of the components.
EDGES = 200_000

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text, as an unsigned number; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    counts, step = np.zeros(64, np.int64), 1 << 16
    for at in range(0, n, step):
        h = np.fromiter((digest(join(words[i : i + SHINGLE]), SEED) for i in range(at, min(n, at + step))), "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    @F.arrow_udf(T.LongType())
    def run(batch: pa.Array) -> pa.Array:
        return pa.array(np.fromiter((fingerprint(x.as_py()) for x in batch), np.uint64, len(batch)).view(np.int64))

    return run.asNondeterministic()(text)


def planes(prints: np.ndarray) -> np.ndarray:
    """64 rows of 64-lane words, with a word of padding at the end."""
    lanes = -(-len(prints) // 64) * 64 + 64
    bits = np.zeros((lanes, 64), np.uint8)
    bits[: len(prints)] = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[: len(flags)] = flags
    return np.packbits(out, bitorder="little").view("<u8")


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry of three bits in every lane."""
    odd = a ^ b
    return odd ^ c, (a & b) | (odd & c)


def _more_than(planes: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose vertical counter, lowest plane first, is above ``radius``."""
    above, level = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for i in reversed(range(len(planes))):
        if radius >> i & 1:
            level = level & planes[i]
        else:
            above = above | (level & planes[i])
            level = level & ~planes[i]
    return above


def within_radius(table: np.ndarray, lag: int, same: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Lanes ``i`` of ``same`` whose fingerprint and that of ``i + lag`` differ in ``radius`` bits at most."""
    words = table.shape[1] - 1
    alive = _lanes(same, words)
    at = np.flatnonzero(alive)
    alive = alive[at]
    skip, turn = np.uint64(lag % 64), np.uint64(64 - lag % 64)
    counter = [np.zeros(len(at), np.uint64) for _ in range(7)]

    def differing(bit: int) -> np.ndarray:
        row, far = table[bit], at + lag // 64
        other = row[np.minimum(far, words)]
        if lag % 64:
            other = (other >> skip) | (row[np.minimum(far + 1, words)] << turn)
        return row[at] ^ other

    for bit in range(0, 64, 8):
        ones, twos, fours = counter[:3]
        ones, a = _add(ones, differing(bit), differing(bit + 1))
        ones, b = _add(ones, differing(bit + 2), differing(bit + 3))
        twos, low = _add(twos, a, b)
        ones, a = _add(ones, differing(bit + 4), differing(bit + 5))
        ones, b = _add(ones, differing(bit + 6), differing(bit + 7))
        twos, high = _add(twos, a, b)
        fours, carry = _add(fours, low, high)
        counter[:3] = ones, twos, fours
        for i in range(3, 7):
            counter[i], carry = counter[i] ^ carry, counter[i] & carry
        if bit + 8 > radius:
            close = alive & ~_more_than(counter, radius)
            some = close != 0
            if not some.all():  # blocks of lanes that are all over the radius go
                at, alive, close, counter = at[some], alive[some], close[some], [c[some] for c in counter]
            if not len(at):
                return np.empty(0, np.int64)
    bits = np.unpackbits(close.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(bits)
    return at[row] * 64 + lane


May = Callable[[np.ndarray, np.ndarray], np.ndarray]
Check = Callable[[int, int], bool]


def forest(
    keys: np.ndarray, prints: np.ndarray, radius: int = RADIUS, may: May | None = None, check: Check | None = None, known: Iterable[tuple[int, int]] = (), close: May | None = None
) -> list[tuple[int, int]]:
    """Edges that join the fingerprints of each run of equal keys that are linked and that ``known`` edges do not join.

    ``may`` tells which pairs of places to compare at all; with lags that grow it says no to all from some lag on.
    ``close`` narrows the pairs within the radius, and ``check`` has the last word on each.
    """
    table, root, edges = planes(prints), np.arange(len(prints)), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in known:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    lag, everything = 1, np.arange(len(prints))
    while lag < len(keys):
        same = keys[lag:] == keys[:-lag]
        if may is not None:
            same &= may(everything[:-lag], everything[lag:])
        if not same.any():
            break
        if close is not None:
            same &= root[lag:] != root[:-lag]
            if not same.any():
                lag += 1
                continue
        found = within_radius(table, lag, same, radius)
        if close is not None:
            found = found[close(found, found + lag)]
            root[:] = root[root]
        for a in found[root[found] != root[found + lag]].tolist():
            x, y = find(a), find(a + lag)
            if x != y and (check is None or check(a, a + lag)):
                root[max(x, y)] = min(x, y)
                edges.append((a, a + lag))
        lag += 1
    return edges


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, prints = np.empty(0, np.int64), np.empty(0, np.int64)

    def done(k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        pairs = np.array(forest(k, p.view(np.uint64)), np.int64).reshape(-1, 2)
        return pa.record_batch([pa.array(p[pairs[:, 0]]), pa.array(p[pairs[:, 1]])], schema=_EDGES)

    for b in batches:
        keys = np.concatenate([keys, b.column("key").to_numpy()])
        prints = np.concatenate([prints, b.column("fp").to_numpy()])
        if len(keys) >= CHUNK:
            cut = int(np.searchsorted(keys, keys[-1], "left"))  # the last run may go on
            if cut:
                yield done(keys[:cut], prints[:cut])
                keys, prints = keys[cut:], prints[cut:]
    if len(keys):
        yield done(keys, prints)


def _bits(places: list[int]) -> Column:
    """The bits of ``fp`` at some places, as a number."""
    out = F.lit(0).cast("long")
    for n, at in enumerate(places):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", at).bitwiseAND(F.lit(1)), n))
    return out


def _narrowed(keyed: DataFrame, rests: list[list[int]], heavy: int) -> DataFrame | None:
    """``keyed(fp, rest, key)`` with runs above ``heavy`` keyed anew, or None if there are none.

    ``rests[rest]`` are the bits outside the key, which fall into three parts, one of which is equal in a pair that differs in two bits;
    the new rest is ``3 * rest`` and the part's number.  Rows of smaller runs get the rest -1 and are left alone.
    """
    open_ = keyed.where("rest >= 0")
    large = open_.groupBy("rest", "key").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select(F.col("rest").alias("_r"), F.col("key").alias("_k"))
    large = stored(large, "heavy-runs")
    if large.isEmpty():
        return None
    marked = keyed.join(large, (F.col("rest") == F.col("_r")) & (F.col("key") == F.col("_k")), "left")
    parts = F.get(F.array(*[F.array(*[_bits(bits[i::3]) for i in range(3)]) for bits in rests]), F.col("rest"))
    anew = F.transform(parts, lambda p, i: F.struct((3 * F.col("rest") + i).alias("rest"), F.xxhash64("key", i, p).alias("key")))
    same = F.array(F.struct(F.lit(-1).alias("rest"), F.col("key").alias("key")))
    return marked.select("fp", F.explode(F.when(F.col("_k").isNull(), same).otherwise(anew)).alias("x")).select("fp", "x.rest", "x.key")


def links(prints: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``a, b``: edges that span each group of linked fingerprints.  ``prints`` has one row ``fp`` for each value.

    Runs with more than ``heavy`` fingerprints are keyed anew by some more bits, up to three times; then a key is of 55 bits or more, and a run
    no larger than the different values of the other nine.
    """
    size = 64 // BLOCKS
    tables = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    keys = [F.xxhash64(F.lit(t), _bits([b * size + i for b in blocks for i in range(size)])) for t, blocks in enumerate(tables)]
    rests = [[b * size + i for b in range(BLOCKS) if b not in blocks for i in range(size)] for blocks in tables]
    keyed = prints.select("fp", F.posexplode(F.array(*keys)).alias("rest", "key"))
    for _ in range(3):
        narrower = _narrowed(keyed, rests, heavy)
        if narrower is None:
            break
        keyed = stored(narrower, "keyed")
        rests = [[b for b in bits if b not in bits[i::3]] for bits in rests for i in range(3)]
    keyed = keyed.select("key", "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_compare, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; ``root`` is the smallest node that it reaches.

    Alternates large-star and small-star steps until no edge changes; each step's
    edges are a table in the shared folder.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        small = large.join(low, large["a"] == low["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a step makes no more edges than it was given
        edges = stored(small.unionByName(low.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "edges", -(-before[0] // EDGES))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _order() -> Column:
    """Orders documents by id, nulls last."""
    return F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("k"))


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, k, fp, root, best``: one row for each row of ``docs``.

    ``root`` names the group of linked fingerprints and ``best`` is the group's first
    document in order of id.  Texts without words, null among them, have fingerprint zero and link
    to each other; repeated rows are in one group; if all ids of a group are null so is its component.  Texts of any length
    are read whole, an empty table gives no rows, and other columns are ignored.
    """
    with scope(docs.sparkSession) as keep:
        prints = keep(stored(docs.select("doc_id", text_key().alias("k"), fingerprint_column(F.col("text")).alias("fp")), "prints"))
        distinct = stored(prints.groupBy("fp").agg(F.min(_order()).alias("first")), "distinct-prints")
        group = components(links(distinct.select("fp")))
        joined = distinct.join(group, distinct["fp"] == group["node"], "left").withColumn("root", F.coalesce("root", "fp"))
        best = joined.groupBy("root").agg(F.min("first").alias("best"))
        named = joined.select("fp", "root").join(best, "root").select(F.col("fp").alias("_fp"), "root", "best")
        named = keep(stored(named, "classes"))
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with the first document of each group alone; of repeated rows, one.  Columns of any name pass through."""
    id_, key, own = fresh(docs, "_id", "_key", "_own")
    best = classes(docs).select(F.col("best.doc_id").alias(id_), F.col("best.k").alias(key)).distinct()
    found = docs.withColumn(own, text_key()).join(best, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left_semi")
    return found.dropDuplicates(["doc_id", own]).drop(own)


def op6_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each row, by :func:`classes`."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("best.doc_id").alias("component_id"))
