"""Product codes of vectors: codebooks by Lloyd's rounds with group bounds.

The entries of each codebook are clustered into a few groups.  Every part of every vector keeps its code, an upper bound of the
distance to its entry and one lower bound a group of the distance to the group's other entries.  After a round the bounds
drift with the entries; only groups whose bound no longer lies above are scanned.  Distances are whole numbers, bounds are
rounded outwards and a group is skipped on a strict inequality alone, so that ties are settled by integers and codes are those of
a full scan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, discard, scope, stored

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096.0
#: Entries of a codebook for each of its groups.
GROUP = 4
#: Labels up to this many are broadcast to the vectors.
BROADCAST_ROWS = 500_000

_STATE = "vec_id long, label string, x binary, code binary, upper binary, lower binary, error long, sums array<long>, scanned long"


def limit_of(dims: int) -> int:
    """The largest scaled component, of either sign, that keeps an error of ``dims`` components within 64 bits."""
    return math.isqrt((1 << 61) // max(1, dims)) // 2


def quantised(values: np.ndarray) -> np.ndarray:
    """``floor(4096 * x)`` of rows of vectors, held to :func:`limit_of`."""
    most = limit_of(values.shape[1])
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -most, most).astype(np.int64)


def cuts(dims: int, parts: int = PARTS) -> list[slice]:
    """``parts`` consecutive parts; of dimensions that don't divide equally the first ones get one more."""
    size, more = divmod(dims, parts)
    ends = np.cumsum([0, *(size + (i < more) for i in range(parts))]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of whole-numbered rows, exactly."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # doubles hold these exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for i, entry in enumerate(c):
        d = x - entry
        out[:, i] = (d * d).sum(axis=1)
    return out


def _above(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers no less than ``x``."""
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(np.inf))


def _below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.asarray(x, np.float64).astype(np.float32), np.float32(-np.inf))


def grouped(entries: np.ndarray, size: int = GROUP) -> list[np.ndarray]:
    """The places of ``entries`` in groups that lie close together: a few rounds of clustering of the entries themselves."""
    k = max(1, len(entries) // size)
    x = entries.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(5):
        near = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.array([x[near == g].mean(axis=0) if (near == g).any() else centres[g] for g in range(k)])
    return [at for g in range(k) if len(at := np.flatnonzero(near == g))]


def drift(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far each entry has moved, rounded up."""
    return _above(np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12))


def settle(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray], code: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each row, its new bounds, and how many distances were computed.

    ``code, upper, lower`` are those of the round before, and ``moved`` the entries' drift since.
    """
    code, computed = code.copy(), 0
    upper = _above(upper.astype(np.float64) + moved[code])
    lower = np.column_stack([_below(lower[:, g].astype(np.float64) - moved[at].max()) for g, at in enumerate(groups)])
    open_ = np.flatnonzero(~(lower.min(axis=1) > upper))
    if not len(open_):
        return code, upper, lower, computed

    def root_above(d: np.ndarray) -> np.ndarray:
        return _above(np.sqrt(d.astype(np.float64)) * (1 + 1e-12))

    d = x[open_] - entries[code[open_]]
    own = (d * d).sum(axis=1)
    computed += len(open_)
    upper[open_] = root_above(own)
    some = ~(lower[open_].min(axis=1) > upper[open_])
    at, own = open_[some], own[some]
    best, nearest, old = own.copy(), code[at].copy(), code[at].copy()
    found = {}
    for g, members in enumerate(groups):
        scan = np.flatnonzero(~(lower[at, g] > root_above(best)))
        if not len(scan):
            continue
        dist = distances(x[at[scan]], entries[members])
        computed += dist.size
        first = dist.argmin(axis=1)  # members are in order, so that ties go to the lower one
        least, who = dist[np.arange(len(scan)), first], members[first]
        closer = (least < best[scan]) | ((least == best[scan]) & (who < nearest[scan]))
        best[scan[closer]], nearest[scan[closer]] = least[closer], who[closer]
        dist[np.arange(len(scan)), first] = np.iinfo(np.int64).max
        found[g] = (scan, least, who, dist.min(axis=1))
    group_of = np.empty(len(entries), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    left = np.flatnonzero(nearest != old)  # the entry that was left bounds its group again
    was = group_of[old[left]]
    lower[at[left], was] = np.minimum(lower[at[left], was], _below(np.sqrt(own[left].astype(np.float64)) * (1 - 1e-12)))
    for g, (scan, least, who, second) in found.items():
        other = np.where(who == nearest[scan], second, least)
        bound = np.sqrt(other.astype(np.float64)) * (1 - 1e-12)
        lower[at[scan], g] = np.where(other == np.iinfo(np.int64).max, np.float32(np.inf), _below(bound))
    code[at], upper[at] = nearest, root_above(best)
    return code, upper, lower, computed


def _narrow(x: np.ndarray) -> list[bytes]:
    """Rows as bytes of two, four or eight a number."""
    most = int(np.abs(x).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return [r.tobytes() for r in x.astype(kind)]


def _wide(rows: list[bytes], dims: int) -> np.ndarray:
    if len({len(r) for r in rows}) == 1:
        return np.frombuffer(b"".join(rows), f"<i{len(rows[0]) // dims}").reshape(-1, dims).astype(np.int64)
    return np.array([np.frombuffer(r, f"<i{len(r) // dims}") for r in rows], np.int64).reshape(-1, dims)


Books = list[np.ndarray]


def _round(dims: int, parts: int, books: Books, groups: list[list[np.ndarray]], moved: list[np.ndarray]):
    """The batch function of a round: new codes and bounds of each row, and at the end the sums and counts of the task's rows by part and entry."""
    where, entries, wide = cuts(dims, parts), len(books[0]), max(map(len, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((entries, s.stop - s.start), np.int64) for s in where]
        counts, total, scanned = np.zeros((parts, entries), np.int64), 0, 0
        for b in batches:
            rows = b.column("x").to_pylist()
            n = len(rows)
            if not n:
                continue
            x = _wide(rows, dims)
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts).copy()
            upper = np.frombuffer(b"".join(b.column("upper").to_pylist()), "<f4").reshape(n, parts).copy()
            lower = np.frombuffer(b"".join(b.column("lower").to_pylist()), "<f4").reshape(n, parts, wide).copy()
            error = np.zeros(n, np.int64)
            for p, s in enumerate(where):
                of = len(groups[p])
                c, upper[:, p], lower[:, p, :of], computed = settle(x[:, s], books[p], groups[p], code[:, p].astype(np.int64), upper[:, p], lower[:, p, :of], moved[p])
                code[:, p], scanned = c, scanned + computed
                d = x[:, s] - books[p][c]
                error += (d * d).sum(axis=1)
                counts[p] += np.bincount(c, minlength=entries)
                for e in range(entries):
                    sums[p][e] += x[c == e, s].sum(axis=0)
            total += n
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.record_batch([b.column("vec_id"), b.column("label"), b.column("x"), pa.array([r.tobytes() for r in code], pa.binary()), pa.array([r.tobytes() for r in upper], pa.binary()),
                                   pa.array([r.tobytes() for r in lower], pa.binary()), pa.array(error), none, pa.nulls(n, pa.int64())], names=[f.split()[0] for f in _STATE.split(", ")])
        if total:
            flat = np.concatenate([np.column_stack([counts[p], sums[p]]).ravel() for p in range(parts)])
            void = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), *[pa.binary()] * 4, pa.int64())]
            yield pa.record_batch([*void, pa.array([flat.tolist()], pa.list_(pa.int64())), pa.array([scanned], pa.int64())], names=[f.split()[0] for f in _STATE.split(", ")])

    return run


def _kept(vectors: DataFrame) -> DataFrame:
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").where(x.isNotNull() & (F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)))


class Codes:
    """What :func:`encode` returns: ``rows`` (``vec_id, label, code, error``), the final ``books``, and the distances that each round computed."""

    def __init__(self, rows: DataFrame, books: Books, scanned: list[int]):
        self.rows, self.books, self.scanned = rows, books, scanned

    def digest(self) -> str:
        """SHA-256 of all entries' components by part, entry and place."""
        return hashlib.sha256(",".join(str(v) for book in self.books for entry in book.tolist() for v in entry).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of the rows of ``vectors(vec_id, embedding, label)``.

    Rows go whose vector is null, empty, or holds a null or non-finite component, or has not as many components as the kept row
    with the smallest ``vec_id``.  With fewer rows than ``entries`` there are as many entries as rows; without rows the result is empty.
    Rows with one id are told apart by their vectors, null ids come last, and scaled components are held to :func:`limit_of`.  Each round is one
    job over a table in the shared folder: a row's state is its own, so nothing is shuffled but the sums of each task.
    """
    spark, kept = vectors.sparkSession, _kept(vectors)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.xxhash64("embedding"), "embedding").limit(entries)
    with scope(spark) as keep:
        first = start.select(F.col("embedding").cast("array<double>")).collect()
        if not first:
            return Codes(kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), [], [])
        dims = len(first[0][0])
        kept = kept.where(F.size("embedding") == dims)
        if any(len(r[0]) != dims for r in first):
            first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.xxhash64("embedding"), "embedding").limit(entries).select(F.col("embedding").cast("array<double>")).collect()
        whole = quantised(np.array([r[0] for r in first]))
        books = [whole[:, s].copy() for s in cuts(dims, parts)]
        groups = [grouped(b) for b in books]
        wide = max(map(len, groups))

        def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n, at = len(b), b.column("embedding")
                x = quantised(at.flatten().to_numpy(zero_copy_only=False).reshape(n, dims)) if n else np.empty((0, dims), np.int64)
                blank = [np.zeros(parts, np.uint8).tobytes(), np.full(parts, np.inf, "<f4").tobytes(), np.full((parts, wide), -np.inf, "<f4").tobytes()]
                yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(_narrow(x), pa.binary()), *(pa.array([v] * n, pa.binary()) for v in blank), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int64())],
                                      names=[f.split()[0] for f in _STATE.split(", ")])

        state = kept.mapInArrow(begun, _STATE)
        moved, computed, table = [np.zeros(len(b), np.float32) for b in books], [], None
        for i in range(rounds + 1):
            after = stored(state.mapInArrow(_round(dims, parts, books, groups, moved), _STATE), f"codes-{i}")
            if table is not None:
                discard(table)
            table, state = after, after.where("sums is null")
            told = after.where("sums is not null")
            computed.append(int(told.agg(F.coalesce(F.sum("scanned"), F.lit(0))).first()[0]))
            if i == rounds:
                break
            # one number for each part, entry and place, whatever the table's size
            sums = dict(told.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect())
            new, at = [], 0
            for s, book in zip(cuts(dims, parts), books, strict=True):
                size = s.stop - s.start
                flat = [int(sums[at + j]) for j in range(len(book) * (size + 1))]
                at += len(flat)
                lines = [flat[e * (size + 1) : (e + 1) * (size + 1)] for e in range(len(book))]
                new.append(np.array([[v // line[0] for v in line[1:]] if line[0] else book[e].tolist() for e, line in enumerate(lines)], np.int64).reshape(len(book), size))
            moved, books = [drift(a, b) for a, b in zip(books, new, strict=True)], new
        keep(table)
    return Codes(state.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), books, computed)


def op13_codes(vectors: DataFrame) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of each row that :func:`encode` keeps."""
    codes = encode(vectors)
    by_label = codes.rows.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    out = codes.rows.join(bounded(by_label, BROADCAST_ROWS), F.col("label").eqNullSafe(F.col("_l")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    steps = [
        """WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS x FROM kept, range(8) AS t(part)),
c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id))"""
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, part, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), e := entry)) AS best
  FROM p JOIN c{i} USING (part) GROUP BY vec_id, part)""")
        if i < ROUNDS:
            steps.append(f"""m{i} AS MATERIALIZED (SELECT part, entry, list(CAST(floor_div AS BIGINT) ORDER BY pos) AS c FROM (
  SELECT part, best.e AS entry, pos, (s - ((s % n) + n) % n) // n AS floor_div FROM (SELECT part, best, pos, sum(v) AS s, count(*) AS n
  FROM (SELECT part, struct_pack(e := best.e) AS best, unnest(x) AS v, unnest(range(len(x))) AS pos FROM p JOIN a{i} USING (vec_id, part)) GROUP BY part, best, pos)) GROUP BY part, entry),
c{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (part, entry))""")
    last = ROUNDS
    steps.append(f"""r AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c{last}) AS codebooks_sha256
FROM r JOIN kept USING (vec_id)""")
    return ",\n".join(steps)


OP13_SQL = _sql()
