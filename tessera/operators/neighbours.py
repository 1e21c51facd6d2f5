"""Near pairs of vectors by banded hyperplane signatures, and navigable graphs of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators.vector import MET, _first, _tile_best, matrix
from tessera.session import scope, stored

SEED = 42
#: The chance that a pair right at the threshold is in no band.
MISS = 1e-3
#: Bits of the sketch that pairs of a band are compared by, and standard deviations above what is expected of a pair at the threshold.
SKETCH, DEVIATIONS = 256, 7
#: Rows of a band that meet in one task; larger ones are dealt into tiles of which every two meet.
HEAVY = 1 << 12


@dataclass(frozen=True)
class Bands:
    """``count`` bands of ``bits`` hyperplanes, and the most bits in which the sketches of a pair at the threshold differ."""

    bits: int
    count: int
    differ: int


def bands_for(threshold: float, rows: int, miss: float = MISS) -> Bands:
    """Bands whose keys hold about one row of ``rows`` by chance, and enough of them for a pair at the threshold to share one."""
    apart = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    bits = max(6, min(20, math.ceil(math.log2(max(2, rows)))))
    share = (1 - apart) ** bits
    count = 1 if share >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-share)))
    differ = min(SKETCH, math.ceil(SKETCH * apart + DEVIATIONS * math.sqrt(SKETCH * apart * (1 - apart))))
    return Bands(bits, count, differ)


def signed(unit: np.ndarray, planes: int, seed: int) -> np.ndarray:
    """Which side of so many random hyperplanes each row is on."""
    return unit @ np.random.RandomState(seed).standard_normal((unit.shape[1], planes)) >= 0


def signatures(vector: Column, size: int, bands: Bands, seed: int = SEED) -> Column:
    """``keys, sketch`` of a vector of ``size`` components: the key of each band, and ``SKETCH`` bits."""

    @F.arrow_udf("keys array<bigint>, sketch array<bigint>")
    def run(batch: pa.Array) -> pa.Array:
        unit = matrix(batch, size)
        bits = signed(unit, max(SKETCH, bands.bits * bands.count), seed)
        sketch = np.packbits(bits[:, :SKETCH], axis=1).view("<u8").view(np.int64)
        powers = np.left_shift(np.int64(1), np.arange(bands.bits))
        keys = bits[:, : bands.bits * bands.count].reshape(len(unit), bands.count, bands.bits) @ powers
        keys = keys * bands.count + np.arange(bands.count)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel())) for x in (keys, sketch)]
        return pa.StructArray.from_arrays(lists, ["keys", "sketch"])

    return run(vector)


_WORDS = SKETCH // 64


def _met(batches: Iterator[pa.RecordBatch], differ: int, rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Pairs ``a < b`` of rows of equal ``run`` whose sketches differ in so many bits at most; rows are in order of ``run``, and runs bounded."""
    held: list[pa.RecordBatch] = []

    def done(run: np.ndarray, ids: np.ndarray, words: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(run)], strict=True):
            for at in range(a, z - 1, 512):
                part = slice(at, min(at + 512, z))
                x, y = np.nonzero(np.bitwise_count(words[part, None] ^ words[None, at:z]).sum(axis=2, dtype=np.int64) <= differ)
                x, y = x[y > x] + at, y[y > x] + at
                x, y = x[ids[x] != ids[y]], y[ids[x] != ids[y]]
                if len(x):
                    yield pa.record_batch([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    def columns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        run, ids = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("run", "id"))
        return run, ids, np.column_stack([np.concatenate([b.column(f"s{i}").to_numpy() for b in held]).view(np.uint64) for i in range(_WORDS)])

    count = 0
    for b in batches:
        held.append(b)
        count += len(b)
        if count >= rows:
            run, ids, words = columns()
            cut = int(np.searchsorted(run, run[-1], "left"))  # the last run may go on
            if cut:
                yield from done(run[:cut], ids[:cut], words[:cut])
            held = [pa.RecordBatch.from_arrays([pa.array(run[cut:]), pa.array(ids[cut:]), *(pa.array(words[cut:, i].view(np.int64)) for i in range(_WORDS))], ["run", "id", *(f"s{i}" for i in range(_WORDS))])]
            count = len(held[0]) if cut else 0
    if held:
        yield from done(*columns())


@dataclass
class NearPairs:
    """``pairs``: ``a < b`` of different vectors and their ``score``; ``members``: ``id, rep`` of every vector, ``rep`` the smallest id with an equal vector of its block; ``sent``: rows that met in bands."""

    pairs: DataFrame
    members: DataFrame
    sent: int

    def links(self) -> DataFrame:
        """``id, rep, links``: with how many others each vector is linked, equal ones among them."""
        sizes = self.members.groupBy("rep").agg(F.count("*").alias("n"))
        both = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(sizes.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
        each = sizes.join(others, "rep", "left").select("rep", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("links"))
        return self.members.join(each, "rep").select("id", "rep", "links")


def near_pairs(items: DataFrame, threshold: float, block: str | None = None, item_id: str = "vec_id", vector: str = "embedding", miss: float = MISS, heavy: int = HEAVY, digits: int = 6) -> NearPairs:
    """Pairs, of one ``block`` if that is given, whose cosine rounds to ``threshold`` at least.

    Equal vectors are one.  Vectors meet in bands of hyperplane signatures, a pair right at the threshold in none with a chance of ``miss``; what meets is
    compared by sketches and what is left by the vectors.  A band with more than ``heavy`` rows is dealt into tiles, so that it loses no pair and no task
    holds it.  A high threshold needs few bands; at a low one :func:`tessera.operators.vector.similar_pairs` is cheaper.
    Null and zero vectors, those with nulls or NaN or not as long as the longest, and null ids or blocks, are in no pair and no class.
    """
    own = F.lit(0) if block is None else F.col(block)
    longest = items.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
    rows = items.select(own.alias("block"), F.col(item_id).cast("long").alias("id"), V.as_double(F.col(vector)).alias("v")).where((F.size("v") == longest) & F.col("block").isNotNull() & F.col("id").isNotNull() & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    with scope(items.sparkSession) as keep:
        known = keep(stored(rows.groupBy("block", "v").agg(F.min("id").alias("rep"), F.collect_set("id").alias("ids")), "vector-classes"))
        bands = bands_for(threshold, max(1, known.count()), miss)
        hashed = known.select("block", "rep", signatures(F.col("v"), longest, bands).alias("s"))
        words = [F.col("s.sketch")[i].alias(f"s{i}") for i in range(_WORDS)]
        met = stored(hashed.select(F.explode("s.keys").alias("key"), "block", F.col("rep").alias("id"), *words).withColumn("run", F.xxhash64("key", "block")), "bands")
        large = stored(met.groupBy("run").agg(F.ceil(2 * F.count("*") / heavy).alias("tiles"), F.count("*").alias("n")).where(F.col("n") > heavy).select(F.col("run").alias("_r"), "tiles"), "heavy-bands")
        tile = F.pmod(F.xxhash64("id"), F.col("tiles"))
        runs = F.when(F.col("_r").isNull(), F.array("run")).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.xxhash64("run", F.least(tile, j), F.greatest(tile, j))))
        dealt = met.join(large, F.col("run") == F.col("_r"), "left").select(F.explode(runs).alias("run"), "id", *(f"s{i}" for i in range(_WORDS)))
        found = dealt.repartition("run").sortWithinPartitions("run").mapInArrow(lambda batches: _met(batches, bands.differ), "a long, b long").distinct()
        side = lambda name: known.select(F.col("rep").alias(name), F.col("v").alias(f"_{name}"))
        scored = found.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.round(V.cosine(F.col("_a"), F.col("_b")), digits).alias("score"))
        pairs = keep(stored(scored.where(F.col("score") >= threshold), "near-pairs"))
        sent = met.count()
    return NearPairs(pairs, known.select(F.explode("ids").alias("id"), "rep"), sent)


#: Neighbours of a vector in the graph, each way.
DEGREE = 24
#: Vectors of a shard, and their components, at most.  A larger shard is compared less and found less of by queries that are not in it.
SHARD, COMPONENTS = 1 << 13, 1 << 24
#: Pairs of a shard and a part of the queries, at least if there are enough of them, and the fewest and most queries of a part.
CELLS, FEW, MANY = 32, 128, 1 << 13
#: Vectors of a shard at which every search begins, candidates that it keeps, and how many of them each round expands.
STARTS, BEAM, EXPAND = 64, 96, 8


def _cell_best(batches: Iterator[pa.RecordBatch], size: int, k: int, held: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Of one cell's rows, vectors ``id, v, low`` and groups ``ids``: for each vector the ``k`` nearest of all groups that it is in, as ``src, dst, score``.

    A score below ``low``, that of a vector's ``k``-th neighbour so far, can't enter its list and is left out.
    """
    vectors, groups = [], []
    for b in batches:
        whole = b.column("ids").is_null().to_numpy(zero_copy_only=False)
        vectors.append(b.select(["id", "v", "low"]).filter(pa.array(whole)))
        groups.append(b.column("ids").filter(pa.array(~whole)))
    if not vectors:
        return
    table = pa.Table.from_batches(vectors).sort_by("id")
    known, low = table.column("id").to_numpy(), table.column("low").fill_null(-2.0).to_numpy().copy()
    unit = matrix(table.column("v"), size)
    del vectors, table
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((-score, b, a))
        a, b, score = a[order], b[order], score[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        a, b, score = a[once], b[once], score[once]
        order = np.lexsort((b, -score, a))
        a, b, score = a[order], b[order], score[order]
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        nth = np.arange(len(a)) - np.repeat(start, np.diff([*start, len(a)]))
        last = nth == k - 1
        low[a[last]] = np.maximum(low[a[last]], score[last])
        return a[nth < k], b[nth < k], score[nth < k]

    count = 0
    for part in groups:
        ends, flat = part.offsets.to_numpy(), np.searchsorted(known, part.values.to_numpy())
        for x, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            at = flat[x:z]
            score = unit[at] @ unit[at].T
            np.fill_diagonal(score, -3)
            i, j = np.nonzero(score >= low[at][:, None])
            found.append((at[i], at[j], score[i, j]))
            count += len(i)
            if count >= held:
                found[:] = [best()]
                count = min(len(found[0][0]), held // 2)
    if found and sum(len(x[0]) for x in found):
        a, b, score = best()
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.record_batch([pa.array(known[a[part]]), pa.array(known[b[part]]), pa.array(score[part])], names=["src", "dst", "score"])


def _linked(unit: np.ndarray, degree: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``a, b`` of each row of ``unit`` to its ``degree`` nearest, and back to the nearest of those that have it as theirs; in order."""
    n, found = len(unit), []
    for at in range(0, n, MET):
        x, y, s = _tile_best(unit[at : at + MET], unit, degree + 1, 12)
        other = x + at != y
        x, y, s = x[other], y[other], s[other]
        near = np.arange(len(x)) - np.searchsorted(x, x) < degree
        found.append((x[near] + at, y[near], s[near]))
    a, b, _ = ahead = [np.concatenate(c) for c in zip(*found, strict=True)]
    back, to, _ = _first(ahead[1], ahead[0], ahead[2], degree)
    return np.divmod(np.unique(np.concatenate([a * n + b, back * n + to])), n)


def _shard(batches: Iterator[pa.RecordBatch], size: int, degree: int) -> Iterator[pa.RecordBatch]:
    """Rows ``shard, id, v`` of one shard become ``shard, at, ids, v, near``: different vectors by their number, the ids that have them, and the numbers that each is linked with."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held).sort_by("id")
    del held
    shard, ids, unit = table["shard"][0].as_py(), table["id"].to_numpy(), matrix(table["v"], size)
    if not size:
        return
    whole = np.ascontiguousarray(unit + 0.0).view(np.dtype((np.void, unit.shape[1] * 8))).ravel()  # no minus zero
    _, rep, of = np.unique(whole, return_index=True, return_inverse=True)
    place = np.empty(len(rep), np.int64)
    place[np.argsort(rep)] = np.arange(len(rep))  # numbers go by the smallest id
    rep, of = np.sort(rep), place[of.ravel()]
    copies, ends = ids[np.argsort(of, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(of))])
    a, b = _linked(unit[rep], degree)
    links = np.searchsorted(a, np.arange(len(rep) + 1))
    lists = lambda flat, offsets, kind: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind))
    made = pa.table({"shard": pa.repeat(pa.scalar(shard, pa.int32()), len(rep)), "at": pa.array(np.arange(len(rep)), pa.int32()), "ids": lists(copies, ends, pa.int64()), "v": table["v"].take(pa.array(rep)), "near": lists(b, links, pa.int32())})
    yield from made.to_batches(4096)


def _walked(unit: np.ndarray, near: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``query, vector, score`` of the ``beam`` best that searches from ``starts`` along ``near`` find, and how many vectors each has met.

    Every round goes on from the ``EXPAND`` best of a query that it hasn't gone on from; the search ends when its beam has none.
    """
    n, step = len(unit), max(1, (1 << 21) // unit.shape[1])
    seen = np.zeros((len(q), n), bool)
    seen[:, starts] = True
    row, at, score = np.repeat(np.arange(len(q)), len(starts)), np.tile(starts, len(q)), (q @ unit[starts].T).ravel()
    fresh = np.ones(len(row), bool)
    while True:
        order = np.lexsort((at, -score, row))
        order = order[np.arange(len(row)) - np.searchsorted(row[order], row[order]) < beam]
        row, at, score, fresh = row[order], at[order], score[order], fresh[order]
        front = np.flatnonzero(fresh)
        front = front[np.arange(len(front)) - np.searchsorted(row[front], row[front]) < EXPAND]
        if not len(front):
            return row, at, score, seen.sum(axis=1)
        fresh[front] = False
        to = near[at[front]]
        who, to = np.repeat(row[front], to.shape[1]), to.ravel()
        who, to = np.divmod(np.unique(who[to >= 0] * n + to[to >= 0]), n)
        new = ~seen[who, to]
        who, to = who[new], to[new]
        seen[who, to] = True
        met = [np.einsum("ij,ij->i", unit[to[i : i + step]], q[who[i : i + step]]) for i in range(0, len(to), step)]
        row, at, score, fresh = (np.concatenate(x) for x in ((row, who), (at, to), (score, *met), (fresh, np.ones(len(to), bool))))


def _searched(batches: Iterator[pa.RecordBatch], size: int, k: int, beam: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Of one shard's rows and rows ``q, v``: ``q, id, score`` of the best ``k`` for each query, and a row ``q, compared``."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    del held
    asks = table["q"].is_valid()
    asked, table = table.filter(asks).select(["q", "v"]), table.filter(pa.compute.invert(asks)).sort_by("at")
    if not len(table) or not len(asked):
        return
    unit, (ids, links) = matrix(table["v"], size), (table[c].combine_chunks() for c in ("ids", "near"))
    ends, ids, degree = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())]), ids.flatten().to_numpy(), links.value_lengths().to_numpy()
    near = np.full((len(unit), max(1, degree.max())), -1, np.int64)
    near[np.arange(near.shape[1]) < degree[:, None]] = links.flatten().to_numpy()
    names, q = asked["q"].to_numpy(), matrix(asked["v"], size)
    del table, asked
    starts = np.random.RandomState(seed).permutation(len(unit))[:STARTS]
    for begin in range(0, len(q), FEW):
        x, at, s, compared = _walked(unit, near, starts, q[begin : begin + FEW], beam)
        copies = np.minimum(ends[at + 1] - ends[at], k)
        nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        x, i, s = _first(np.repeat(x, copies), ids[np.repeat(ends[at], copies) + nth], np.repeat(np.round(np.clip(s, 0, 1), 6), copies), k)
        part = names[begin : begin + FEW]
        none = lambda count, kind: pa.nulls(count, kind)
        columns = ([part[x], part], [i, none(len(part), pa.int64())], [s, none(len(part), pa.float64())], [none(len(x), pa.int64()), compared.astype(np.int64)])
        yield pa.record_batch([pa.concat_arrays([y if isinstance(y, pa.Array) else pa.array(y) for y in c]) for c in columns], names=["q", "id", "score", "compared"])


class Graph:
    """Graphs of near neighbours over all vectors, one a shard: each vector is linked with its exact nearest of the shard, both ways.

    Vectors are dealt once, by a hash of their ids, to shards that a task can hold, so that the graphs are made where they are, in time that grows with the
    vectors alone.  A search walks the graph of every shard best first from fixed starts, many queries at once, and compares only what it meets:
    :attr:`compared` counts that.  It grows less than the vectors within a shard, and with the number of shards beyond.
    Equal vectors of a shard are one, which stands for all their ids.
    """

    def __init__(self, items: DataFrame, degree: int = DEGREE, seed: int = SEED, item_id: str = "vec_id", vector: str = "embedding"):
        self.spark, self.item_id, self.vector, self.seed = items.sparkSession, item_id, vector, seed
        self.size = size = items.agg(F.coalesce(F.max(F.size(vector)), F.lit(0))).first()[0]
        rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(vector).alias("v")).where((F.size("v") == size) & F.col("id").isNotNull())
        with scope(self.spark) as keep:
            vectors = stored(rows.dropDuplicates(["id"]), "graph-vectors")
            self.count = vectors.count()
            self.shards = max(1, math.ceil(self.count / max(1, min(SHARD, COMPONENTS // max(1, size)))))
            dealt = vectors.select(F.pmod(F.xxhash64("id"), F.lit(self.shards)).cast("int").alias("shard"), "id", "v").repartitionById(self.shards, "shard")
            kind = dict(vectors.dtypes)["v"]
            self.graph = keep(stored(dealt.mapInArrow(lambda batches: _shard(batches, size, degree), f"shard int, at int, ids array<long>, v {kind}, near array<int>"), "graph"))
        self.compared: DataFrame | None = None

    def search(self, queries: DataFrame, k: int, beam: int = BEAM, query_id: str = "query_id") -> DataFrame:
        """``query_id, item_id, score, rank`` of the best ``k`` that a best-first search of every shard finds; one ends when a query has no candidate left among its ``beam`` best."""
        size, seed, shards = self.size, self.seed, self.shards
        q = queries.select(F.col(query_id).cast("long").alias("q"), F.col(self.vector).cast(self.graph.schema["v"].dataType).alias("v")).where((F.size("v") == size) & F.col("q").isNotNull())
        n = q.count()
        parts = max(1, math.ceil(n / MANY), min(math.ceil(CELLS / shards), math.ceil(n / FEW)))
        every = lambda count: F.sequence(F.lit(0), F.lit(count - 1))
        part = F.pmod(F.xxhash64("q", F.lit(seed)), F.lit(parts)).cast("int")
        asked = q.select(F.explode(F.transform(every(shards), lambda i: i * parts + part)).alias("cell"), "q", "v")
        cells = F.transform(every(parts), lambda j: F.col("shard") * parts + j)
        met = self.graph.select(F.explode(cells).alias("cell"), "at", "ids", "v", "near").unionByName(asked, allowMissingColumns=True)
        found = met.repartitionById(shards * parts, "cell").mapInArrow(lambda batches: _searched(batches, size, k, max(beam, k), seed), "q long, id long, score double, compared long")
        found = stored(found, "graph-found")
        self.compared = found.where("compared is not null").groupBy(F.col("q").alias(query_id)).agg(F.sum("compared").alias("compared"))
        out = found.where("id is not null").select(F.col("q").alias(query_id), F.col("id").alias(self.item_id), "score")
        nth = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), self.item_id))
        return out.withColumn("rank", nth).where(F.col("rank") <= k)
