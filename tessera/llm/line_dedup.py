"""Removing lines that many documents share.

Line hashes are pre-aggregated in salted groups, range-partitioned and sorted by
document and position; a streaming pass keeps the first entry of each hash, which
names the document that keeps the line, and the number of documents.  What goes back
to the documents are bitmaps of lines, not text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, stored, text_key

MIN_CHARS = 40
MIN_DOCS = 5
SALTS = 16
WORD = 64


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def long_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, k, pos, h, g`` of the lines whose key is long enough; ``h, g`` hash the key to 96 bits."""
    lines = docs.select("doc_id", text_key().alias("k"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.select("doc_id", "k", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "k", "pos", F.xxhash64("key").alias("h"), F.hash("key").alias("g"))


def keepers(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h, g, keeper`` of the keys in at least ``min_docs`` documents; ``keeper`` is the largest doc_id.

    A row of the documents counts as a document once, however often it has the line.
    """
    once = lines.groupBy("h", "g", "doc_id", "k").agg(F.min("pos").alias("pos"), F.lit(1).alias("one"))
    salted = (
        once.groupBy("h", "g", F.pmod("k", F.lit(SALTS)).alias("salt"))
        .agg(F.sum("one").alias("n"), F.max(F.struct(F.col("doc_id"), (-F.col("pos")).alias("up"))).alias("first"))
    )
    # a hash has at most SALTS rows from here on
    ranged = salted.repartitionByRange("h").select("h", "g", "n", F.col("first.doc_id").alias("doc_id"), (-F.col("first.up")).alias("pos"))
    stream = Window.partitionBy("h", "g").orderBy(F.col("doc_id").desc(), "pos")
    whole = Window.partitionBy("h", "g")
    return (
        ranged.withColumn("nth", F.row_number().over(stream)).withColumn("docs", F.sum("n").over(whole))
        .where((F.col("nth") == 1) & (F.col("docs") >= min_docs)).select("h", "g", F.col("doc_id").alias("keeper"))
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, k, n_dropped, bitmap`` of the documents that lose lines.

    ``bitmap`` is an array of ``(word, bits)`` for the words of 64 lines in which a
    line goes, ascending; a set bit keeps its line, and a word that is not
    listed keeps all of them.
    """
    lines = stored(long_lines(docs, min_chars), "lines")
    common = keepers(lines, min_docs)
    gone = (
        lines.join(common, ["h", "g"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("doc_id", "k", F.shiftright("pos", 6).alias("word"))
        .agg(F.bit_or(F.expr(f"shiftleft(1L, pos & {WORD - 1})")).alias("lost"))
    )
    return gone.groupBy("doc_id", "k").agg(
        F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("lost").alias("bits")))).alias("bitmap"),
    )


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines that a bitmap keeps, in order; all of them for a null bitmap."""
    lost = F.flatten(
        F.transform(
            bitmap,
            lambda w: F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda s: F.getbit(w["bits"], s) == 0), lambda s: w["word"] * WORD + s
            ),
        )
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
    return F.when(bitmap.isNull(), lines).otherwise(F.transform(kept, lambda i: F.get(lines, i)))


def deduplicated(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with the shared lines removed from ``text`` and the columns ``n_lines, n_dropped``.

    Null and empty texts are one empty line, which is too short to go.  Repeated rows
    each count as a document if their text or id differs; exact repeats count once and
    are treated alike.  With null ids the largest non-null id keeps a line, and if all are null
    every one of them does.  Texts of any length go by lines, and an empty table stays empty.  Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    id_, key, own, lost, bitmap = fresh(docs, "_id", "_key", "_own", "_lost", "_bitmap")
    maps = keep_bitmaps(docs, **limits).select(F.col("doc_id").alias(id_), F.col("k").alias(key), F.col("n_dropped").alias(lost), F.col("bitmap").alias(bitmap))
    out = docs.withColumn(own, text_key()).join(maps, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left")
    lines = split_lines(F.col("text"))
    return (
        out.withColumn("n_lines", F.size(lines).cast("long")).withColumn("n_dropped", F.coalesce(lost, F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col(bitmap).isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept_lines(lines, F.col(bitmap)), "\n")))
        .drop(id_, key, own, lost, bitmap)
    )


def op10_lines(docs: DataFrame) -> DataFrame:
    """The digest of :func:`deduplicated` for each row: a document is a row with an id and a text, and exact repeats are one."""
    return deduplicated(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, r, u, pos, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, r, u, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS r, md5(text) AS u, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), k AS (
  SELECT doc_id, r, u, pos, line, translate(bare, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT (doc_id, u)) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN c USING (key) GROUP BY doc_id, r
"""
