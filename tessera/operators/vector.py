"""Vector search: exact and two-phase, pairs of near vectors, and hybrid scores."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.session import cut

#: Query vectors that are shipped to every task at most.
MAX_QUERIES = 10_000
#: Query vectors that meet a batch of items at once.
MET = 512
#: Rows of a block that are compared in one task, with as many others.
TILE = 4096
#: Components of a tile of queries or items of a large exact join, about, and the fewest pairs of tiles that it is made of.
HELD, CELLS = 1 << 21, 32


def matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Rows of unit length; null, zero and wrongly sized vectors are zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), size))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    good = np.flatnonzero(lengths == size)
    if len(good):
        out[good] = np.nan_to_num(column.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def _first(x: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows ``query, id, score`` the first ``k`` of each query."""
    order = np.lexsort((i, -s, x))
    x, i, s = x[order], i[order], s[order]
    near = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[near], i[near], s[near]


class _Best:
    """The best ``k`` items of each query so far; no more than ``MET`` queries meet a batch at once, so that memory does not grow with the queries."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def meet(self, asked: np.ndarray, q: np.ndarray, items: np.ndarray, unit: np.ndarray, digits: int, key: int = 0) -> None:
        """Rows ``asked`` of ``q``, at most ``MET``, meet ``items``.  ``key`` tells apart what is asked of different lists."""
        s = np.round(np.clip(q[asked] @ unit.T, 0, 1), digits)
        cut_at = s.shape[1] - self.k
        x, y = np.nonzero(s >= np.partition(s, cut_at, axis=1)[:, cut_at, None]) if cut_at > 0 else np.nonzero(np.ones(s.shape, bool))
        new = (asked[x], items[y].astype(np.int64), s[x, y])
        if len(asked):
            place = (key, int(asked[0]))
            old = self.rows.get(place)
            self.rows[place] = _first(*(new if old is None else map(np.concatenate, zip(old, new, strict=True))), self.k)

    def named(self, ids: list, query_id: str, item_id: str) -> pa.RecordBatch:
        parts = self.rows.values()
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        x, i, s = _first(*map(np.concatenate, zip(empty, *parts, strict=True)), self.k)
        return pa.record_batch([pa.array(np.array(ids, np.int64)[x]), pa.array(i), pa.array(s)], [query_id, item_id, "score"])


def knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``query_id, item_id, score`` of the ``k`` items with the largest cosine, in [0, 1], for each query.

    Each task multiplies its batches with all query vectors and passes on its own best
    ``k`` alone, so what is shuffled is ``k`` rows a query and task.  Ties go to the smaller id.
    More than ``MAX_QUERIES`` queries are not shipped: queries and items fall into tiles of which every two meet.
    """
    queries = queries.where(F.col(query_id).isNotNull())
    count = queries.count()
    found = (_block_knn if count <= MAX_QUERIES else _tiled_knn)(queries, corpus, k, query_id, item_id, vector, digits)
    nth = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), item_id))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _block_knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, item_id: str, vector: str, digits: int) -> DataFrame:
    asked = queries.select(query_id, vector).toArrow()
    sizes = asked[vector].combine_chunks().value_lengths().to_pylist()
    size = max([n or 0 for n in sizes], default=0)
    q, ids = matrix(asked[vector], size), asked[query_id].to_pylist()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _Best(k)
        for b in batches:
            unit, items = matrix(b.column(1), size), b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), MET):
                top.meet(np.arange(at, min(at + MET, len(ids))), q, items, unit, digits)
        yield top.named(ids, query_id, item_id)

    return corpus.select(F.col(item_id).cast("long"), vector).where(F.col(item_id).isNotNull()).mapInArrow(best, f"{query_id} long, {item_id} long, score double")


def _tile_best(q: np.ndarray, unit: np.ndarray, k: int, digits: int, chunk: int = TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``q``, row of ``unit`` and score of the first ``k`` for each of the few queries ``q``.

    Items come in the order of their ids, so that a later one has to be above the ``k``-th score so far.
    """
    best, low = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(q), -1.0)
    for at in range(0, len(unit), chunk):
        s = q @ unit[at : at + chunk].T
        if at == 0 and s.shape[1] > k:
            s = np.round(np.clip(s, 0, 1), digits)
            x, y = np.nonzero(s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None])
        else:
            x, y = np.nonzero(s > (low + 0.49 * 10.0**-digits)[:, None])  # what is less can't be above when it is rounded
        if len(x):
            best = _first(*map(np.concatenate, zip(best, (x, y + at, np.round(np.clip(s[x, y], 0, 1), digits)), strict=True)), k)
            last = np.arange(len(best[0])) - np.searchsorted(best[0], best[0]) == k - 1
            low[best[0][last]] = best[2][last]
    return best


def _tiled_knn(queries: DataFrame, corpus: DataFrame, k: int, query_id: str, item_id: str, vector: str, digits: int) -> DataFrame:
    """As :func:`_block_knn` for any number of queries: a task holds one tile of them and one of items, and passes on the tile's best ``k``.

    The comparisons are all there are; the driver holds counts only.
    """
    size, n = queries.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)), F.count("*")).first()
    rows = max(1, HELD // max(1, size))
    tiles = max(1, math.ceil(corpus.count() / rows))
    parts = max(math.ceil(n / rows), math.ceil(CELLS / tiles))
    numbers = lambda count: F.sequence(F.lit(0), F.lit(count - 1))

    def side(df: DataFrame, name: str, count: int, asked: bool) -> DataFrame:
        own = F.pmod(F.xxhash64(F.col(name)), F.lit(count)).cast("int")
        cells = F.transform(numbers(tiles), lambda j: own * tiles + j) if asked else F.transform(numbers(parts), lambda i: i * tiles + own)
        return df.where(F.col(name).isNotNull()).select(F.explode(cells).alias("cell"), F.lit(asked).alias("asked"), F.col(name).cast("long").alias("id"), F.col(vector).alias("v"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).select(["asked", "id", "v"])
        sides = [table.filter(table["asked"]).sort_by("id"), table.filter(pa.compute.invert(table["asked"])).sort_by("id")]
        del held, table
        (ids, q), (items, unit) = ((t["id"].to_numpy(), matrix(t["v"], size)) for t in sides)
        del sides
        for at in range(0, len(ids) if len(items) else 0, MET):
            x, y, s = _tile_best(q[at : at + MET], unit, k, digits)
            yield pa.record_batch([pa.array(ids[x + at]), pa.array(items[y]), pa.array(s)], [query_id, item_id, "score"])

    met = side(queries, query_id, parts, True).unionByName(side(corpus, item_id, tiles, False))
    return met.repartitionById(parts * tiles, "cell").mapInArrow(best, f"{query_id} long, {item_id} long, score double")


def nearest(query: Column, corpus: DataFrame, k: int, item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``item_id, score`` of the ``k`` items nearest to one vector: an expression and a top-k, without Python."""
    return corpus.select(item_id, F.round(V.clamp01(V.cosine(F.col(vector), query)), 6).alias("score")).orderBy(F.col("score").desc(), item_id).limit(k)


#: Vectors that an index is fitted on at most; all of them are indexed.
FIT_ROWS = 20_000


class Index:
    """An inverted file of vectors: lists around centroids.  A search reads the lists nearest to each query and ranks what is in them exactly."""

    def __init__(self, items: DataFrame, lists: int = 32, seed: int = 42, item_id: str = "vec_id", vector: str = "embedding"):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.item_id, self.vector = item_id, vector
        rows = items.where(F.size(vector) > 0).select(item_id, vector, V.unit(F.col(vector)).alias("_u"))
        sample = rows.orderBy(F.xxhash64(F.lit(seed), item_id), item_id).limit(FIT_ROWS).select(array_to_vector("_u").alias("features"))
        model = KMeans(k=lists, seed=seed, maxIter=10).fit(sample)
        self.centres = [[float(x) for x in c] for c in model.clusterCenters()]
        self.lists = cut(rows.select(item_id, vector, self._order(F.col("_u"), 1)[0].alias("list")).repartition("list"))

    def _order(self, unit: Column, n: int) -> Column:
        """Numbers of the ``n`` centroids nearest to a unit vector."""
        centres = np.array(self.centres)

        @F.arrow_udf("array<int>")
        def run(batch: pa.Array) -> pa.Array:
            far = (centres * centres).sum(axis=1) - 2 * matrix(batch, centres.shape[1]) @ centres.T
            near = np.argsort(far, axis=1, kind="stable")[:, :n].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(near) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel()))

        return run(unit)

    def search(self, queries: DataFrame, k: int, probes: int = 20, query_id: str = "query_id") -> DataFrame:
        """``query_id, item_id, score, rank`` of the best ``k`` in the ``probes`` lists nearest to each query.

        Vectors without clusters, as random ones, need most lists for a recall of nine tenths; clustered ones need few.
        """
        blocks = max(1, -(-queries.count() // MAX_QUERIES))
        parts = [self._found(queries.where(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == n) if blocks > 1 else queries, k, probes, query_id) for n in range(blocks)]
        scored = parts[0]
        for p in parts[1:]:
            scored = scored.unionByName(p)
        nth = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), self.item_id))
        return scored.withColumn("rank", nth).where(F.col("rank") <= k)

    def _found(self, queries: DataFrame, k: int, probes: int, query_id: str) -> DataFrame:
        """The best of each task: batches of items are multiplied with the queries that ask for their lists, and no pairs are joined."""
        asked = queries.select(query_id, self.vector, self._order(V.unit(F.col(self.vector)), probes).alias("lists")).toArrow()
        size, item_id, ids = len(self.centres[0]), self.item_id, asked[query_id].to_pylist()
        q, lists = matrix(asked[self.vector], size), asked["lists"].to_pylist()
        want = {n: np.array([i for i, x in enumerate(lists) if n in (x or ())], np.int64) for n in range(len(self.centres))}

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = _Best(k)
            for b in batches:
                of = b.column(2).to_numpy(zero_copy_only=False)
                items, unit = b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), size)
                for n in np.unique(of).tolist():
                    here = of == n
                    for at in range(0, len(want[n]), MET):
                        top.meet(want[n][at : at + MET], q, items[here], unit[here], 6, n)
            yield top.named(ids, query_id, item_id)

        return self.lists.select(F.col(item_id).cast("long"), self.vector, "list").where(F.col(item_id).isNotNull()).mapInArrow(best, f"{query_id} long, {item_id} long, score double")


def collected(items: DataFrame, ids: list[int] | None = None, item_id: str = "vec_id", **where: object) -> DataFrame:
    """Items of a collection by id and by the values of columns."""
    out = items if ids is None else items.where(F.col(item_id).isin(ids))
    for column, value in where.items():
        out = out.where(F.col(column) == F.lit(value))
    return out


def two_phase(query: Column, corpus: DataFrame, k: int, size: int, item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The best ``min(20 k, 200)`` items by Hamming distance of sign bits, ranked anew by cosine.  Ties go to the smaller id."""
    bits = corpus.select(item_id, vector, V.hamming(V.sign_words(F.col(vector), size), V.sign_words(query, size)).alias("distance"))
    near = bits.orderBy("distance", item_id).limit(min(20 * k, 200))
    return near.select(item_id, "distance", F.round(V.clamp01(V.cosine(F.col(vector), query)), 6).alias("score")).orderBy(F.col("score").desc(), item_id).limit(k)


def similar_pairs(items: DataFrame, block: str, threshold: float, item_id: str = "vec_id", vector: str = "embedding", digits: int = 6) -> DataFrame:
    """``a < b`` of one block whose cosine is at least ``threshold``, with ``score``.

    A block of more than ``TILE`` rows is dealt into tiles and every two tiles meet in one task, where a
    matrix product compares them; only the pairs that qualify leave it.  So no task holds more than two tiles, however
    large a block is.  Null and zero vectors, and null ids or blocks, are in no pair.
    """
    kind = dict(items.dtypes)[block]
    rows = items.select(F.col(block).alias("block"), F.col(item_id).cast("long").alias("id"), F.col(vector).alias("v")).where("block is not null and id is not null")
    sizes = rows.groupBy("block").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    dealt = rows.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1), lambda j: F.struct(F.least(F.col("tile"), j).alias("lo"), F.greatest(F.col("tile"), j).alias("hi")))
    placed = dealt.select("block", "id", "v", "tile", F.explode(meets).alias("m")).select("block", "id", "v", "tile", "m.lo", "m.hi")

    def compare(table: pa.Table) -> pa.Table:
        ids, tile = table["id"].to_numpy(), table["tile"].to_numpy()
        lo, hi = table["lo"][0].as_py(), table["hi"][0].as_py()
        size = max(table["v"].combine_chunks().value_lengths().fill_null(0).to_pylist(), default=0)
        unit = matrix(table["v"], size)
        left, right = np.flatnonzero(tile == lo), np.flatnonzero(tile == hi)
        score = np.round(unit[left] @ unit[right].T, digits)
        x, y = np.nonzero((score >= threshold) & (ids[left][:, None] < ids[right][None, :] if lo == hi else ids[left][:, None] != ids[right][None, :]))
        p, q = ids[left][x], ids[right][y]
        named = pa.repeat(table["block"][0], len(x))
        return pa.table({block: named, "a": np.minimum(p, q), "b": np.maximum(p, q), "score": score[x, y]})

    return placed.groupBy("block", "lo", "hi").applyInArrow(compare, f"{block} {kind}, a long, b long, score double")


def weighted_hybrid(streams: list[tuple[DataFrame, float]], item_id: str = "id") -> DataFrame:
    """``id, score``: scores of all streams, each times its weight, summed by id."""
    parts = [df.select(item_id, (F.col("score") * w).alias("score")) for df, w in streams]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy(item_id).agg(F.round(F.sum("score"), 6).alias("score"))


def boosted(hits: DataFrame, age_days: Column, uses: Column, recency: float = 0.1, popularity: float = 0.1) -> DataFrame:
    """Scores times a recency factor and a popularity factor, at most 1."""
    fresh = F.greatest(F.lit(0.5), 1 - age_days / 365 * recency)
    used = 1 + F.log1p(uses) / 10 * popularity
    return hits.withColumn("score", F.least(F.lit(1.0), F.col("score") * fresh * used))


def evolved(items: DataFrame, samples: DataFrame, item_id: str = "id", min_samples: int = 5, min_cosine: float = 0.5) -> DataFrame:
    """Vectors drawn to the centroid of the queries that found them: 0.7 to 0.3, if there are enough and they are near."""
    dims = samples.select(item_id, F.posexplode(V.as_double(F.col("embedding"))).alias("d", "x"))
    means = dims.groupBy(item_id, "d").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    centre = means.groupBy(item_id).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "x"))).alias("c")).withColumn("c", F.col("c.x"))
    near = (F.col("n") >= min_samples) & (V.cosine(F.col("embedding"), F.col("c")) >= min_cosine)
    blend = F.zip_with(V.as_double(F.col("embedding")), F.col("c"), lambda a, b: 0.7 * a + 0.3 * b)
    out = items.join(centre, item_id, "left")
    return out.withColumn("evolved", F.coalesce(near, F.lit(False))).withColumn("embedding", F.when(F.col("evolved"), blend).otherwise(V.as_double(F.col("embedding")))).drop("c", "n")


def evolved_in_groups(items: DataFrame, group: str, item_id: str = "id", min_samples: int = 5, min_cosine: float = 0.5) -> DataFrame:
    """:func:`evolved` where each item's samples are the others of its group: the group's sum less its own vector, so that no pairs are made."""
    dims = items.select(group, F.posexplode(V.as_double(F.col("embedding"))).alias("d", "x")).groupBy(group, "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = dims.groupBy(F.col(group).alias("_g")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "x"))).alias("s"))
    own = V.as_double(F.col("embedding"))
    rows = items.join(sums, F.col(group).eqNullSafe(F.col("_g"))).withColumn("c", F.zip_with(F.col("s.x"), own, lambda a, b: (a - b) / (F.col("n") - 1)))
    near = (F.col("n") - 1 >= min_samples) & (V.cosine(own, F.col("c")) >= min_cosine)
    blend = F.zip_with(own, F.col("c"), lambda a, b: 0.7 * a + 0.3 * b)
    return rows.select(item_id, F.coalesce(near, F.lit(False)).alias("evolved"), F.when(near, blend).otherwise(own).alias("embedding"))


def store_stats(items: DataFrame, group: str, text: str) -> DataFrame:
    """Items and characters of each group."""
    return items.groupBy(group).agg(F.count("*").alias("items"), F.sum(F.length(text)).cast("long").alias("chars"))
