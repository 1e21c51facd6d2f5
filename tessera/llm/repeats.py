"""Repeated passages of bytes by bucket-pointer refinement.

A window is a string of ``DEPTH`` bytes.  Each window is filed under one of its q-grams, the one with the least hash, so that
equal windows lie in the same initial bucket at the same distance from the q-gram; neighbouring windows mostly share it and make a block, one row
for some thirty bytes.  Buckets of one block are done.  In the others the first of equal blocks stands for all,
and where blocks differ their windows are refined: buckets of short strings are sorted on the bucket pointers of later offsets, and the
new pointers are used again at the next, longer offset, until they stand for whole windows.  A heavy bucket is refined beforehand on what
lies beside its q-gram, until each piece is small or holds one window alone, so that no task holds an unbounded bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, discard, fresh, scope, stored, sweep, text_key

#: Bytes of a window and of the q-gram under which it is filed.
DEPTH, GRAM = 100, 32
#: Windows of a text that are looked at in one go.
PIECE = 1 << 21
#: Blocks that are passed on in one go.
ROWS = 1 << 15
#: Blocks of a bucket above this are refined before they meet in a task, and bytes that a task refines in one go.
HEAVY, BYTES = 1 << 12, 1 << 21
#: Documents up to this many are broadcast.
BROADCAST_ROWS = 200_000

_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LOCAL = 255  # in place of an offset: a run of windows that the piece itself holds before


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _ONE
    x += b
    x ^= x >> np.uint64(31)
    x *= _TWO
    x ^= x >> np.uint64(29)
    return x


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64), np.full(256, 0x94D049BB133111EB, np.uint64))


def blocks(text: bytes, start: int, size: int = PIECE, depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``b, s, lo, n, off`` of the blocks of the windows that begin in ``size`` bytes from ``start``, and ``lo, n`` of the runs of windows that begin earlier there too.

    ``b`` is the bucket, ``s`` a hash of the block's bytes, ``lo`` its first window, ``n`` how many windows it has and ``off`` where the q-gram lies from ``lo``.
    """
    part = np.frombuffer(text, np.uint8, min(len(text) - start, size + depth - 1), start)
    windows = len(part) - depth + 1
    h, length = _BYTES[part], 1
    while length < gram:
        h, length = _mix(h[:-length], h[length:]), 2 * length
    double = _mix(h[:-gram], h[gram:])
    # the least hash of the q-grams in a window, of equal ones the leftmost: the place is the lower half
    least, span = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64), 1
    reach = depth - gram + 1
    while 2 * span <= reach:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < reach:
        least = np.minimum(least[: -(reach - span)], least[reach - span :])
    at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    alive = np.ones(windows, bool)
    anchors = at[np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))]
    buckets, counts = np.unique(h[anchors], return_counts=True)
    if (counts > 1).any():
        again = np.isin(h[at], buckets[counts > 1])
        some = np.flatnonzero(again)
        first, last = double[some], double[some + depth - 2 * gram]
        order = np.lexsort((last, first))
        same = np.concatenate([[False], (first[order[1:]] == first[order[:-1]]) & (last[order[1:]] == last[order[:-1]])])
        alive[some[order[same]]] = False
    live = np.flatnonzero(alive)
    new = np.flatnonzero(np.concatenate([[True], (live[1:] != live[:-1] + 1) | (at[live[1:]] != at[live[:-1]])])) if len(live) else live
    lo, n = live[new], np.diff(np.concatenate([new, [len(live)]]))
    end = lo + n + depth - 1 - 2 * gram
    s = _mix(_mix(double[lo], double[end]), _mix(double[np.minimum(lo + 52, end)], n.astype(np.uint64)))
    gone = np.flatnonzero(~alive)
    cut = np.flatnonzero(np.concatenate([[True], gone[1:] != gone[:-1] + 1])) if len(gone) else gone
    return h[at[lo]], s, lo + start, n, at[lo] - lo, gone[cut] + start, np.diff(np.concatenate([cut, [len(gone)]]))


_BLOCK = "b long, s long, doc_id long, k long, at long"


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each text; ``at`` packs the first window, their number and the offset of the q-gram."""
    held, rows = [], 0

    def done() -> pa.RecordBatch:
        each = np.array([len(h[2]) for h in held])
        doc = pa.array([h[3] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), each)))
        b, s, at = (pa.array(np.concatenate([h[i] for h in held])) for i in range(3))
        return pa.record_batch([b, s, doc, pa.array(np.repeat(np.array([h[4] for h in held], np.int64), each)), at], names=["b", "s", "doc_id", "k", "at"])

    for batch in batches:
        for doc, k, text in zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), batch.column("text"), strict=True):
            data = text.as_buffer()
            for start in range(0, data.size - DEPTH + 1, PIECE):
                b, s, lo, n, off, gone, m = blocks(data, start)
                own = np.full(len(gone), k, np.int64) ^ gone
                at = np.concatenate([(lo << 32) | (n << 8) | off, (gone << 32) | (m << 8) | _LOCAL])
                held.append((np.concatenate([b.view(np.int64), own]), np.concatenate([s.view(np.int64), own]), at, doc, k))
                rows += len(at)
                if rows >= ROWS:
                    yield done()
                    held, rows = [], 0
    if held:
        yield done()


_JUDGED = "b long, doc_id long, k long, lo long, n int, off int"


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of ``b, s`` and place: those with an equal block before them come with a null ``b``, and where a bucket has different blocks, the first of each with its ``b``."""
    held, sent = None, False  # the last first block, and whether it was sent

    def out(rows: pa.RecordBatch, gone: bool) -> pa.RecordBatch:
        at = rows.column("at").to_numpy()
        n = len(rows)
        return pa.record_batch([pa.nulls(n, pa.int64()) if gone else rows.column("b"), rows.column("doc_id"), rows.column("k"), pa.array(at >> 32), pa.array(((at >> 8) & 0xFFFFFF).astype(np.int32)), pa.array((at & 0xFF).astype(np.int32))],
                               names=[f.split()[0] for f in _JUDGED.split(", ")])

    for batch in batches:
        local = (batch.column("at").to_numpy() & 0xFF) == _LOCAL
        if local.any():
            yield out(batch.filter(pa.array(local)), True)
            batch = batch.filter(pa.array(~local))
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        b, s = batch.column("b").to_numpy(), batch.column("s").to_numpy()
        first = np.concatenate([[True], (b[1:] != b[:-1]) | (s[1:] != s[:-1])])
        yield out(batch.filter(pa.array(~first)), True)
        firsts = np.flatnonzero(first)
        fb = b[firsts]
        beside = np.concatenate([fb[1:] == fb[:-1], [False]])
        beside[1:] |= fb[1:] == fb[:-1]
        if held is not None and sent:
            send = beside.copy()
            send[0] = False
        else:
            send = beside
        yield out(batch.take(pa.array(firsts[send])), False)
        # the last first block goes on with the next batch; it was sent if its bucket had another before it
        sent = bool(beside[-1]) or (sent and len(firsts) == 1)
        held = batch.slice(int(firsts[-1]), 1)


def pointers(text: np.ndarray, room: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Bucket pointers of the strings of ``depth`` bytes of ``text``; equal ones have equal pointers.

    ``room`` is how many bytes follow from each place on, its own included, before its string ends; places with less than ``depth`` have no meaning.
    """
    v, length = text.astype(np.uint64), 1
    while length < 8:
        v, length = (v[:-length] << np.uint64(8 * length)) | v[length:], 2 * length
    pointer = np.full(len(text), -1, np.int64)
    valid = np.flatnonzero(room[: len(v)] >= 8)
    order = valid[np.argsort(v[valid], kind="stable")]
    starts = np.concatenate([[True], v[order[1:]] != v[order[:-1]]]) if len(order) else np.empty(0, bool)
    pointer[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1] if len(order) else 0
    while length < depth:
        longer = min(2 * length, depth)
        offset = longer - length
        valid = np.flatnonzero(room >= longer)
        open_ = valid[np.bincount(pointer[valid], minlength=1)[pointer[valid]] > 1]  # a bucket of one stays as it is
        later = (pointer[open_].astype(np.uint64) << np.uint64(32)) | pointer[open_ + offset].astype(np.uint64)
        order = np.argsort(later, kind="stable")
        key, places = later[order], open_[order]
        if len(key):
            bucket, sub = np.concatenate([[True], (key[1:] >> np.uint64(32)) != (key[:-1] >> np.uint64(32))]), np.concatenate([[True], key[1:] != key[:-1]])
            fresh_, old = np.flatnonzero(sub)[np.cumsum(sub) - 1], np.flatnonzero(bucket)[np.cumsum(bucket) - 1]
            pointer[places] = pointer[places] + fresh_ - old
        length = longer
    return pointer


def repeated(strings: list[bytes], depth: int = DEPTH) -> list[np.ndarray]:
    """For each string, which of its windows an earlier window of the same or an earlier string equals."""
    sizes = np.array([len(x) for x in strings], np.int64)
    ends = np.cumsum(sizes)
    text = np.frombuffer(b"".join(strings), np.uint8)
    room = np.repeat(ends, sizes) - np.arange(len(text))
    pointer = pointers(text, room, depth)
    windows = np.flatnonzero(room >= depth)
    order = windows[np.argsort(pointer[windows], kind="stable")]
    again = np.zeros(len(text), bool)
    again[order[1:]] = pointer[order[1:]] == pointer[order[:-1]]
    return [again[e - z : e - depth + 1] for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)]


_RUNS = "doc_id long, k long, lo long, n int"


def _refined(batches: Iterator[pa.RecordBatch], most: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of repeated windows of the rows ``g, one, doc_id, k, lo, bytes``, which are in order of ``g`` and place; ``one`` tells that all of a ``g`` are one window."""
    rows, size, known = [], 0, None

    def done(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        # strings of different buckets have no window in common
        for (_, _, doc, k, lo, data), again in zip(rows, repeated([r[5] for r in rows]), strict=True):
            places = np.flatnonzero(again)
            if len(places):
                new = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))
                out += [(doc, k, lo + int(a), int(m)) for a, m in zip(places[new], np.diff(np.concatenate([new, [len(places)]])))]
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "k", "lo", "n"])

    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("g", "one", "doc_id", "k", "lo", "bytes")), strict=True):
            if row[1] and row[0] == known:
                out.append(row)
                continue
            if size >= most and (row[0] != rows[-1][0] or row[1]):
                yield done(rows)
                known = rows[-1][0] if rows[-1][1] else None
                rows, size = [], 0
                if row[1] and row[0] == known:
                    out.append(row)
                    continue
            rows.append(row)
            size += len(row[5])
        if out:
            yield pa.record_batch([pa.array([r[2] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.int64()), pa.array([r[4] for r in out], pa.int64()), pa.array([1] * len(out), pa.int32())], names=["doc_id", "k", "lo", "n"])
    if rows:
        yield done(rows)


def _split(rows: DataFrame, heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """The ``rows`` of buckets of ``heavy`` blocks at most, and those of the others in split buckets, None if there are none.

    The windows of a bucket begin ``u`` to ``v`` bytes before its q-gram.  The nearer and the farther half of them each have more bytes in
    common, which make the new key, and a block goes with its windows to either.
    """
    large = stored(rows.where("v > u").groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > heavy).select(F.col("g").alias("_g")), "heavy-buckets")
    if large.isEmpty():
        return rows, None
    keys = bounded(large, BROADCAST_ROWS)
    light = rows.join(keys, F.col("g") == F.col("_g"), "left_anti")
    rows = rows.join(keys, F.col("g") == F.col("_g"), "left_semi")
    m = F.floor((F.col("u") + F.col("v") + 1) / 2).cast("int")
    low = F.col("off") - F.col("n") + 1  # its last window begins so far before the q-gram
    far_n = F.col("off") - F.greatest(m, low) + 1
    near_off = F.least(F.col("off"), m - 1)
    near_n, skip = near_off - low + 1, F.col("off") - near_off

    def piece(side: int, u: Column, v: Column, off: Column, n: Column, skip: Column, common: Column, length: Column) -> Column:
        data = F.substring(F.col("bytes"), skip + 1, n + DEPTH - 1)
        g = F.xxhash64("g", F.lit(side), F.substring(F.col("bytes"), skip + common + 1, length))
        return F.struct(g.alias("g"), u.alias("u"), v.alias("v"), (F.col("lo") + skip).alias("lo"), n.alias("n"), off.alias("off"), data.alias("bytes"))

    far = F.when(F.col("off") >= m, piece(0, m, F.col("v"), F.col("off"), far_n, F.lit(0), F.col("off") - m, DEPTH - F.col("v") + m))
    near = F.when(low < m, piece(1, F.col("u"), m - 1, near_off, near_n, skip, near_off - F.col("u"), DEPTH - m + 1 + F.col("u")))
    pieces = F.array_compact(F.array(far, near))
    return light, rows.select("doc_id", "k", F.explode(pieces).alias("x")).select("doc_id", "k", "x.*")


def _order() -> list[Column]:
    return [F.col("doc_id").asc_nulls_last(), F.col("k"), F.col("lo")]


def removed(docs: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """``doc_id, k, copy, runs`` of the rows of ``docs`` that lose bytes: ``copy`` rows all of theirs, others the windows in ``runs`` of ``lo, n``.

    ``k`` is :func:`tessera.llm.common.text_key`.  The order of documents is that of their ids, nulls last; rows that share an id are told
    apart by ``k``, and rows that share both are one document.  Copies of whole texts leave first: only the first of them has blocks, so that a bucket
    has about one block a document.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", text_key().alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("text")).where(F.length("text") >= DEPTH)
    with scope(spark) as keep:
        rows = stored(texts.select("doc_id", "k", F.xxhash64(F.lit(1), "text").alias("k2")).groupBy("doc_id", "k", "k2").agg(F.count("*").alias("times")), "texts")
        place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
        first = rows.groupBy(F.col("k").alias("_k"), F.col("k2").alias("_k2")).agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
        same = (F.col("k") == F.col("_k")) & (F.col("k2") == F.col("_k2"))
        copies = rows.join(bounded(first, BROADCAST_ROWS), same).where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("doc_id", "k")
        copies = stored(copies, "copies")
        mine = lambda a, b: a["doc_id"].eqNullSafe(b["_d"]) & (a["k"] == b["_k"])
        not_first = bounded(copies.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k")), BROADCAST_ROWS)
        if not rows.where("times > 1").isEmpty():
            texts = texts.dropDuplicates(["doc_id", "k"])
        firsts = texts.join(not_first, mine(texts, not_first), "left_anti")
        filed = firsts.mapInArrow(_filed, _BLOCK).repartition("b")
        judged = filed.sortWithinPartitions("b", "s", F.col("doc_id").asc_nulls_last(), "k", "at").mapInArrow(_judged, _JUDGED)
        judged = stored(judged, "judged")
        sweep(spark)
        open_ = judged.where("b is not null").groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(F.collect_list(F.struct("b", "lo", "n", "off")).alias("found"))
        whole = texts.join(open_, mine(texts, open_))
        cut = F.transform("found", lambda x: F.struct(x["b"].alias("g"), F.lit(0).alias("u"), F.lit(DEPTH - GRAM).alias("v"), x["lo"].alias("lo"), x["n"].alias("n"), x["off"].alias("off"), F.substring(F.col("text"), (x["lo"] + 1).cast("int"), x["n"] + DEPTH - 1).alias("bytes")))
        strings = stored(whole.select("doc_id", "k", F.explode(cut).alias("x")).select("doc_id", "k", "x.*"), "strings")
        strings, large = _split(strings, heavy)
        while large is not None:  # rows of light buckets are not looked at again
            light, large = _split(stored(large, "strings"), heavy)
            strings = strings.unionByName(light)
        dealt = strings.select("g", (F.col("u") == F.col("v")).alias("one"), "doc_id", "k", "lo", "bytes").repartition("g").sortWithinPartitions("g", *_order())
        runs = judged.where("b is null").select("doc_id", "k", "lo", "n").unionByName(dealt.mapInArrow(_refined, _RUNS))
        found = runs.groupBy("doc_id", "k").agg(F.collect_list(F.struct("lo", "n")).alias("runs")).select("doc_id", "k", F.lit(False).alias("copy"), "runs")
        empty = F.array().cast("array<struct<lo:bigint,n:int>>")
        return keep(stored(found.unionByName(copies.select("doc_id", "k", F.lit(True).alias("copy"), empty.alias("runs"))), "removed"))


_KEPT = T.StructType([T.StructField("removed", T.LongType()), T.StructField("spans", T.LongType()), T.StructField("kept", T.BinaryType())])


@F.arrow_udf(_KEPT)
def _cut(text: pa.Array, runs: pa.Array) -> pa.Array:
    """What is left of a text, how much went, and in how many pieces; all null where there is no text."""
    gone, spans, kept = [], [], []
    for t, found in zip(text, runs, strict=True):
        if not t.is_valid:
            gone.append(None), spans.append(None), kept.append(None)
            continue
        data, pieces = t.as_py(), found.values
        lo = pieces.field("lo").to_numpy().astype(np.int64)
        order = np.argsort(lo)
        lo, end = lo[order], (lo + pieces.field("n").to_numpy() + DEPTH - 1)[order]
        end = np.maximum.accumulate(end)
        new = np.flatnonzero(np.concatenate([[True], lo[1:] > end[:-1]]))
        a, z = lo[new], end[np.concatenate([new[1:] - 1, [len(lo) - 1]])]
        gone.append(int((z - a).sum())), spans.append(len(a))
        kept.append(b"".join(data[x:y] for x, y in zip([0, *z.tolist()], [*a.tolist(), len(data)], strict=True)))
    return pa.StructArray.from_arrays([pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], _KEPT.names)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes that are ``kept`` of each text.

    Each byte goes that a window covers which begins earlier too, in a smaller ``doc_id`` or the same text.  Null texts are empty, texts with fewer bytes than
    a window stay whole, very long ones are read in pieces of ``PIECE`` windows, and an empty table gives no rows.  Rows with equal ids and texts are one document and
    each get its result; columns of any name pass through, but for those four.
    """
    id_, key, own, copy, runs, at, cut = fresh(docs, "_id", "_key", "_own", "_copy", "_runs", "_at", "_cut")
    gone = removed(docs).select(F.col("doc_id").alias(id_), F.col("k").alias(key), F.col("copy").alias(copy), F.col("runs").alias(runs))
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.withColumn(own, text_key()).withColumn(at, data)
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left")
    some = F.col(copy).isNotNull() & ~F.coalesce(F.col(copy), F.lit(False))
    out = out.withColumn(cut, _cut(F.when(some, F.col(at)), F.col(runs)))
    whole = F.coalesce(F.col(copy), F.lit(False))
    size, zero, one = F.length(at).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long")
    return out.select(
        *docs.columns, size.alias("n_bytes"),
        F.when(whole, size).otherwise(F.coalesce(f"{cut}.removed", zero)).alias("n_removed"),
        F.when(whole, one).otherwise(F.coalesce(f"{cut}.spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(b"")).otherwise(F.coalesce(f"{cut}.kept", at)).alias("kept"),
    )


def op12_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each row, by :func:`deduplicated`."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
