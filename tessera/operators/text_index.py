"""A stored text index: words with block-wise largest counts, trigrams, and segments that take upserts and deletes.

Documents fall into blocks of ``2 ** SHIFT`` ids.  A posting row is one word, or one trigram, with all its documents of a block, so that lists never
grow beyond a block; the rows are sorted by word, and a search reads the row groups of its words alone.  For a ranked search the largest count of a word
in a block bounds the score of every document there: blocks are scored from the best bound on, and those that cannot enter the first ``k`` are never read.
A search for parts of words intersects the lists of each term's rarest trigrams, and reads the texts that are left.

An index is a list of immutable segments, in order of their numbers, and a manifest that names them.  An upsert or a delete
writes one more segment; a document is what the last segment that knows it says.  Segments that are not larger than the newer ones together are
merged.  Manifests are numbered and put in place by a rename that fails if another writer was first.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lexical import query_terms, sanitized, sum_or
from tessera.session import discard, stored
from tessera.sources.manifest import Manifest

#: Ids of a block as a power of two, and blocks that are scored in the first round; each round takes twice as many, up to the last number.
SHIFT, FIRST, MOST = 10, 4, 4096
#: Trigrams of a term whose lists are intersected.
RAREST = 3
#: Candidates up to this many are looked up by their ids.
BY_ID = 1000
#: Segments up to this many stay as they are.
SEGMENTS = 4
#: Blocks that a task indexes, where there are many.
BLOCKS = 8
#: Posting rows; those of trigrams have no counts.
LISTS = "kind string, key string, block long, most long, ids array<long>, counts array<long>"

_WORD = re.compile("[a-z0-9_]+")


@dataclass
class Read:
    """What the last search read: posting blocks of ``total``, or texts."""

    total: int = 0
    blocks: int = 0
    texts: int = 0


def trigrams(part: str) -> list[str]:
    return list(dict.fromkeys(part[i : i + 3] for i in range(len(part) - 2)))


class TextIndex:
    """The index at ``path``; documents are ``doc_id, text`` and the attributes that searches filter by.  Ids are whole numbers; rows with null ids are left out."""

    def __init__(self, spark: SparkSession, path: str, attributes: tuple[str, ...] = (), shift: int = SHIFT):
        """``attributes`` and ``shift`` are those of the first writer for as long as the index lives."""
        self.spark, self.path, self.attributes, self.shift = spark, path.rstrip("/"), attributes, shift
        self.read = Read()

    def _manifest(self) -> tuple[int, list[dict]]:
        """The number of the last manifest and its segments, oldest first."""
        return Manifest(self.spark, f"{self.path}/manifest").read([])

    def _commit(self, after: int, segments: list[dict]) -> None:
        Manifest(self.spark, f"{self.path}/manifest").commit(after, segments)

    def segments(self) -> list[dict]:
        return self._manifest()[1]

    # writing

    def _placed(self, docs: DataFrame) -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *self.attributes)
        return rows.withColumn("block", F.shiftright("doc_id", self.shift))

    def _write(self, name: str, docs: DataFrame, texts: DataFrame | None) -> None:
        folder = f"{self.path}/{name}"
        docs.repartitionByRange("block", "doc_id").sortWithinPartitions("block", "doc_id").write.parquet(f"{folder}/docs")
        if texts is not None:
            lists = stored(self._lists(texts), "posting-lists")  # a range partitioning reads its rows twice
            lists.repartitionByRange("kind", "key", "block").sortWithinPartitions("kind", "key", "block").write.partitionBy("kind").parquet(f"{folder}/lists")
            discard(lists)

    def _lists(self, texts: DataFrame) -> DataFrame:
        """The posting rows of ``block, doc_id, text``.  A block is one task's, so that its lists need no further shuffle; a task has a few blocks, whatever their size in bytes."""
        blocks, cores = texts.select("block").distinct().count(), self.spark.sparkContext.defaultParallelism
        low = texts.select("block", "doc_id", F.lower("text").alias("low")).repartition(max(1, min(blocks, 4 * cores), blocks // BLOCKS), "block")
        return low.sortWithinPartitions("block", "doc_id").mapInArrow(_postings, LISTS)

    def upsert(self, docs: DataFrame) -> None:
        """Add documents, or put them in place of those with their ids; ids are unique in ``docs``."""
        number, segments = self._manifest()
        placed = self._placed(docs)
        self._add(number, segments, placed.withColumn("deleted", F.lit(False)), placed)

    def delete(self, ids: DataFrame) -> None:
        """Leave out the documents whose ``doc_id`` is in ``ids``."""
        number, segments = self._manifest()
        if not segments:
            return
        kinds = dict(self._docs(segments).dtypes)
        rows = ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        rows = rows.select("doc_id", F.lit("").alias("text"), *[F.lit(None).cast(kinds[a]).alias(a) for a in self.attributes], F.shiftright("doc_id", self.shift).alias("block"), F.lit(True).alias("deleted"))
        self._add(number, segments, rows, None)

    def _add(self, number: int, segments: list[dict], docs: DataFrame, texts: DataFrame | None) -> None:
        name = f"segment-{uuid.uuid4().hex}"
        self._write(name, docs, texts)
        count = self.spark.read.parquet(f"{self.path}/{name}/docs").count()
        new = {"name": name, "number": max((s["number"] for s in segments), default=0) + 1, "docs": count, "postings": texts is not None}
        self._commit(number, [*segments, new])

    def merge(self, least: int = SEGMENTS) -> bool:
        """If there are more than ``least`` segments, make one of the newest and all before them that are not larger than those after them together; whether it did.

        Deletes are kept as long as there is an older segment.  What is left is indexed anew from its texts.
        """
        number, segments = self._manifest()
        if len(segments) <= least:
            return False
        start, total = len(segments) - 1, segments[-1]["docs"]
        while start and (segments[start - 1]["docs"] <= total or len(segments) - start < 2):
            start -= 1
            total += segments[start]["docs"]
        run = segments[start:]
        last = stored(self._last(self._docs(run)).drop("number"), "merged-docs")
        live = last.where("not deleted")
        name = f"segment-{uuid.uuid4().hex}"
        self._write(name, last if start else live, live)
        discard(last)
        count = self.spark.read.parquet(f"{self.path}/{name}/docs").count()
        self._commit(number, [*segments[:start], {"name": name, "number": run[-1]["number"], "docs": count, "postings": True}])
        return True

    # reading

    def _rows(self, segments: list[dict], kind: str) -> DataFrame:
        def rows(name: str) -> DataFrame:
            if kind == "docs":
                return self.spark.read.parquet(f"{self.path}/{name}/docs")
            lists = self.spark.read.schema(LISTS).parquet(f"{self.path}/{name}/lists").where(F.col("kind") == kind)
            return lists.select(F.col("key").alias("word"), "block", "most", "ids", "counts") if kind == "words" else lists.select(F.col("key").alias("gram"), "block", "ids")

        parts = [rows(s["name"]).withColumn("number", F.lit(s["number"])) for s in segments if kind == "docs" or s["postings"]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def _docs(self, segments: list[dict]) -> DataFrame:
        return self._rows(segments, "docs")

    def _last(self, rows: DataFrame) -> DataFrame:
        """What the last segment says of each document."""
        best = F.max_by(F.struct(*[F.col(c) for c in rows.columns if c != "doc_id"]), "number")
        return rows.groupBy("doc_id").agg(best.alias("r")).select("doc_id", "r.*")

    def _live(self, segments: list[dict], where: Column | None, filters: dict[str, object], columns: tuple[str, ...] = ()) -> DataFrame:
        """``doc_id, number`` and ``columns`` of the documents that are there and have the values of ``filters``."""
        rows = self._docs(segments)
        rows = (rows if where is None else rows.where(where)).select("doc_id", "number", "deleted", *dict.fromkeys([*filters, *columns]))
        rows = (rows if len(segments) == 1 else self._last(rows)).where("not deleted")
        for column, value in filters.items():
            rows = rows.where(F.col(column) == F.lit(value))
        return rows.select("doc_id", "number", *columns)

    def documents(self) -> DataFrame:
        """The documents that are there: ``doc_id, text`` and the attributes."""
        return self._live(self.segments(), None, {}, ("text", *self.attributes)).drop("number")

    def search(self, text: str, limit: int, **filters: object) -> DataFrame:
        """``doc_id, score`` of the first ``limit`` documents with words that begin with a term of ``text``; ``filters`` are values of attributes, None is any.

        Each such word is a cover of an OR query by itself and counts a tenth; the score is doubled, at most 1.  Ties go to the smaller id.
        """
        terms, segments = query_terms(text), self.segments()
        filters = {k: v for k, v in filters.items() if v is not None}
        empty = self.spark.createDataFrame([], "doc_id long, score double")
        self.read = Read()
        if not terms or not any(s["postings"] for s in segments):
            return empty
        found = self._rows(segments, "words").where(sum_or([F.col("word").startswith(t) for t in terms]))
        score = lambda n: F.round(F.least(F.lit(1.0), 2 * 0.1 * n), 6)
        bounds = stored(found.groupBy("block").agg(score(F.sum("most")).alias("bound"), F.count("*").alias("rows")), "bounds")
        self.read.total = bounds.count()
        top: list[tuple[float, int]] = []  # (-score, id) of the best so far
        cursor, size = None, FIRST
        while True:
            left = bounds
            if cursor is not None:
                left = left.where((F.col("bound") < cursor[0]) | ((F.col("bound") == cursor[0]) & (F.col("block") > cursor[1])))
            if len(top) == limit:  # a block comes in with a better bound, or with the same one and a smaller id
                least, worst = -top[-1][0], top[-1][1]
                left = left.where((F.col("bound") > least) | ((F.col("bound") == least) & (F.shiftleft("block", self.shift) < worst)))
            batch = [(r.bound, r.block) for r in left.orderBy(F.desc("bound"), "block").limit(size).collect()]
            if not batch:
                break
            cursor, size = batch[-1], min(MOST, 2 * size)
            self.read.blocks += len(batch)
            some = F.col("block").isin([b for _, b in batch])
            hits = found.where(some).select("number", F.explode(F.arrays_zip("ids", "counts")).alias("p")).groupBy("number", F.col("p.ids").alias("doc_id")).agg(F.sum("p.counts").alias("n"))
            if len(segments) > 1 or filters:
                hits = hits.join(self._live(segments, some, filters), ["doc_id", "number"], "left_semi")
            best = hits.select("doc_id", score(F.col("n")).alias("score")).orderBy(F.desc("score"), "doc_id").limit(limit).collect()
            top = sorted([*top, *((-r.score, r.doc_id) for r in best)])[:limit]
        discard(bounds)
        return self.spark.createDataFrame([(d, -s) for s, d in top], "doc_id long, score double") if top else empty

    def candidates(self, terms: list[str], wild: bool = True) -> DataFrame | None:
        """``doc_id, number``: documents that have the rarest trigrams of a term; None if a term has no trigram, so that any may match."""
        segments = self.segments()
        asked = {}
        for t in terms:
            parts = re.split("[_%]", t.lower()) if wild else [t.lower()]
            asked[t] = list(dict.fromkeys(g for p in parts for g in trigrams(p)))
            if not asked[t]:
                return None
        rows = self._rows(segments, "grams")
        counted = rows.where(F.col("gram").isin(sorted({g for gs in asked.values() for g in gs}))).groupBy("gram").agg(F.sum(F.size("ids")).alias("n"))
        n = {r.gram: r.n for r in counted.collect()}  # one row for each trigram of the query
        chosen = {t: sorted(gs, key=lambda g: (n[g], g))[:RAREST] for t, gs in asked.items() if all(g in n for g in gs)}
        if not chosen:
            return self.spark.createDataFrame([], "doc_id long, number int")
        need = self.spark.createDataFrame([(g, i, len(gs)) for i, gs in enumerate(chosen.values()) for g in gs], "gram string, term int, need int")
        lists = rows.where(F.col("gram").isin(sorted({g for gs in chosen.values() for g in gs}))).join(F.broadcast(need), "gram")
        met = lists.groupBy("term", "need", "number", "block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == F.col("need"))
        both = F.aggregate(F.slice("lists", 2, RAREST), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
        return met.select("number", F.explode(both).alias("doc_id")).distinct().select("doc_id", "number")

    def coverage(self, text: str, limit: int, wild: bool = True, **filters: object) -> DataFrame:
        """``doc_id, score``: the share of the terms of ``text`` that a document contains, in any case, best first; ties go to the smaller id.

        ``_`` and ``%`` of a term are wild unless ``wild`` is off; such a term goes by its fixed parts.  Texts that lack a rare trigram of every
        term are not read.  A query with a term that has no fixed part of three characters reads all texts.
        """
        terms, segments = sanitized(text), self.segments()
        filters = {k: v for k, v in filters.items() if v is not None}
        self.read = Read()
        if not terms or not segments:
            return self.spark.createDataFrame([], "doc_id long, score double")
        wanted, rows = self.candidates(terms, wild), None
        if wanted is None:
            rows = self._live(segments, None, filters, ("text",))
            self.read.texts = sum(s["docs"] for s in segments)
        else:
            wanted = stored(wanted, "candidates")
            self.read.texts = wanted.count()
            ids = [r.doc_id for r in wanted.select("doc_id").distinct().limit(BY_ID + 1).collect()]
            where = F.col("doc_id").isin(ids) if len(ids) <= BY_ID else None
            rows = self._live(segments, where, filters, ("text",)).join(wanted, ["doc_id", "number"], "left_semi")
        low = F.lower("text")

        def has(term: str) -> Column:
            t = term.lower()
            return low.like(f"%{t}%") if wild and re.search("[_%]", t) else F.contains(low, F.lit(t))

        matched = sum((has(t).cast("int") for t in terms[1:]), has(terms[0]).cast("int"))
        return rows.select("doc_id", F.round(matched / float(len(terms)), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)

    def vocabulary(self) -> DataFrame:
        """``word, df`` over the documents that are there."""
        segments = self.segments()
        rows = self._rows(segments, "words")
        if len(segments) == 1:
            return rows.groupBy("word").agg(F.sum(F.size("ids")).cast("long").alias("df"))
        each = rows.select("number", "word", F.explode("ids").alias("doc_id")).join(self._live(segments, None, {}), ["doc_id", "number"], "left_semi")
        return each.groupBy("word").agg(F.count("*").alias("df"))


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :data:`LISTS` for ``block, doc_id, low`` in order: each word of a block with its documents and how often they have it, and each trigram with its documents."""
    block, words, ids, grams = None, {}, [], []

    def lists(kind: str, keys: list[str], sizes: np.ndarray, docs: np.ndarray, counts: np.ndarray | None) -> pa.RecordBatch:
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        most = pa.nulls(len(keys), pa.int64()) if counts is None else pa.array(np.maximum.reduceat(counts, ends.to_numpy()[:-1]))
        n = pa.nulls(len(keys), pa.list_(pa.int64())) if counts is None else pa.ListArray.from_arrays(ends, pa.array(counts))
        columns = [pa.array([kind] * len(keys)), pa.array(keys), pa.array(np.full(len(keys), block)), most, pa.ListArray.from_arrays(ends, pa.array(docs)), n]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "block", "most", "ids", "counts"])

    def done() -> Iterator[pa.RecordBatch]:
        if words:
            sizes = np.array([len(x) // 2 for x in words.values()])
            flat = np.array([v for x in words.values() for v in x], np.int64).reshape(-1, 2)
            yield lists("words", list(words), sizes, flat[:, 0].copy(), flat[:, 1].copy())
        keys = np.concatenate(grams) if grams else np.empty(0, np.int64)
        if len(keys):
            order = np.argsort(keys, kind="stable")
            docs, keys = np.repeat(np.array(ids, np.int64), [len(g) for g in grams])[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            points = np.column_stack([keys[first] >> 42, keys[first] >> 21 & 0x1FFFFF, keys[first] & 0x1FFFFF]).astype("<u4")
            text = points.tobytes().decode("utf-32-le")
            yield lists("grams", [text[i : i + 3] for i in range(0, len(text), 3)], np.diff(np.append(first, len(keys))), docs, None)

    for batch in batches:
        for b, i, low in zip(*(batch.column(c).to_pylist() for c in ("block", "doc_id", "low")), strict=True):
            if b != block:
                yield from done()
                block, words, ids, grams = b, {}, [], []
            for word, n in Counter(_WORD.findall(low)).items():
                words.setdefault(word, []).extend((i, n))
            x = np.frombuffer(low.encode("utf-32-le"), "<u4").astype(np.int64)
            ids.append(i)
            grams.append(np.unique(x[:-2] << 42 | x[1:-1] << 21 | x[2:]))
    yield from done()
