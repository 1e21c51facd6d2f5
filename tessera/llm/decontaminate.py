"""Benchmark decontamination with a positional inverted index.

The index holds the postings ``(term, document, position)`` of training tokens.
Test texts are cut into windows of words; the terms of a window are taken in order of their number of
postings.  The rarest term's postings, moved back by its offset in the window, are
the candidate starts; they are intersected with the moved postings of the second
rarest term, and what is left with those of all others.  Proximity matches start from the rarest term too:
the second rarest has to lie near it, and of what is left all others within a short stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, fresh, scope, stored, text_key

WINDOW = 8
MIN_ITEMS = 2
#: Words that a proximity match may have more than its window.
SLACK = 4
#: Test-side tables up to this many rows are broadcast.
BROADCAST_ROWS = 500_000
#: Files of a stored test-side table.
FILES = 16
SEPARATORS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Ends every document's tokens; no word has such a character.
_END = "\x00"


def with_words(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the array of lower-cased words of ``text``; none for null."""
    bare = df.withColumn(name, F.btrim(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SEPARATORS)))
    return bare.withColumn(name, F.when(F.col(name) == "", F.array().cast("array<string>")).otherwise(F.split(name, _SPLIT, -1)))


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(terms, lexicon, owners)`` of the test texts ``item_id, text``.

    ``terms``: ``wid, len, off, term`` of each different window; ``lexicon``: ``word, term``;
    ``owners``: ``wid, item_id``.  A text with fewer words than ``size`` is one window,
    one without words none.
    """
    words = with_words(items.select("item_id", "text"), "text", "w").where(F.size("w") > 0)
    cut = words.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))), lambda i: F.slice("w", i + 1, size))).alias("ws"))
    cut = cut.distinct()
    # numbers by task, which are fixed once they are stored
    ids = stored(cut.select("ws").distinct().withColumn("wid", F.monotonically_increasing_id()), "window-ids")
    flat = ids.select("wid", F.size("ws").alias("len"), F.posexplode("ws").alias("off", "word"))
    lexicon = stored(flat.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1), "lexicon")
    terms = stored(flat.join(lexicon, "word").select("wid", "len", "off", "term"), "window-terms")
    return terms, lexicon, cut.join(ids, "ws").select("wid", "item_id")


def build_index(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Postings ``term, doc_id, k, pos`` of the words that ``lexicon(word, term)`` numbers, as a stored table.

    Postings of words outside the lexicon of the test texts can lie in no window, and are
    not kept.  Each row of ``docs`` has one more posting, of term 0, at the position
    after its last word.
    """
    words = with_words(docs.select("doc_id", "text", text_key().alias("k")), "text", "w")
    tokens = words.select("doc_id", "k", F.posexplode(F.array_append("w", F.lit(_END))).alias("pos", "word"))
    known = lexicon.unionByName(docs.sparkSession.range(1).select(F.lit(_END).alias("word"), F.lit(0).cast("long").alias("term")))
    found = tokens.join(bounded(known, BROADCAST_ROWS), "word").select("term", "doc_id", "k", "pos")
    return stored(found, "postings")


def _at(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings that candidates need: one for each of their windows' ``terms``."""
    return candidates.join(bounded(terms, BROADCAST_ROWS), "wid").select(
        "wid", "doc_id", "k", "start", "off", "term", (F.col("start") + F.col("off")).alias("pos")
    )


def _intersect(need: DataFrame, postings: DataFrame) -> DataFrame:
    """Those of ``need`` that are postings."""
    p = postings.where(F.col("term") > 0).select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.col("pos").alias("_p"), F.col("term").alias("_t"))
    same = need["doc_id"].eqNullSafe(p["_d"]) & (need["k"] == p["_k"]) & (need["pos"] == p["_p"]) & (need["term"] == p["_t"])
    return need.join(p, same)


def _of(postings: DataFrame, candidates: DataFrame) -> DataFrame:
    """The postings of the documents that have candidates."""
    some = bounded(candidates.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).distinct(), BROADCAST_ROWS)
    return postings.join(some, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left_semi")


def term_counts(postings: DataFrame) -> DataFrame:
    """``term, n``: the length of each term's list, as a stored table."""
    return stored(postings.where(F.col("term") > 0).groupBy("term").agg(F.count("*").alias("n")), "term-counts", FILES)


def phrase_matches(postings: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """``wid, len, doc_id, k, start`` of every occurrence of a window, each once."""
    ranked = (
        terms.join(bounded(counts, BROADCAST_ROWS), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("n", "off")))
        .withColumn("rarest", F.min("n").over(Window.partitionBy("wid"))).where("rarest > 0")
    )
    ranked = stored(ranked.select("wid", "len", "off", "term", "rank"), "ranked-terms", FILES)
    first = bounded(ranked.where("rank = 1").select("wid", "term", "off"), BROADCAST_ROWS)
    start = (
        postings.join(first, "term").select("wid", "doc_id", "k", (F.col("pos") - F.col("off")).alias("start"))
        .where("start >= 0").distinct()
    )
    # windows of one or two words meet their rarest term again, so that all take the same way
    second, rest = ranked.where("rank = least(2, len)"), ranked.where("rank > 2 or (len <= 2 and rank = 1)")
    seconds = bounded(second.select("term").distinct(), BROADCAST_ROWS)
    two = _intersect(_at(start, second), postings.join(seconds, "term", "left_semi")).select("wid", "doc_id", "k", "start").distinct()
    two = stored(two, "phrase-candidates")
    lens = bounded(ranked.where("rank = 1").select("wid", "len"), BROADCAST_ROWS)
    all_of = _intersect(_at(two, rest), _of(postings, two)).groupBy("wid", "doc_id", "k", "start").agg(F.count_distinct("off").alias("n"))
    return all_of.join(lens, "wid").where(F.col("n") == F.greatest(F.lit(1), F.col("len") - 2)).drop("n")


def _beside(anchors: DataFrame, need: DataFrame, postings: DataFrame, span: int) -> DataFrame:
    """``anchors(wid, doc_id, k, anchor)`` with the ``term, pos`` of each posting of their windows' ``need`` less than ``len + slack`` words off.

    Positions fall into tiles of ``span`` words, so that the join is one of equal keys.
    """
    wide = anchors.join(bounded(need.select("wid", "reach", "term"), BROADCAST_ROWS), "wid")
    tile = lambda c: F.floor(c / span)
    spots = wide.withColumn("tile", F.explode(F.sequence(tile(F.col("anchor") - F.col("reach") + 1), tile(F.col("anchor") + F.col("reach") - 1))))
    p = postings.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.col("term").alias("_t"), tile(F.col("pos")).alias("_tile"), "pos")
    same = spots["doc_id"].eqNullSafe(p["_d"]) & (spots["k"] == p["_k"]) & (spots["term"] == p["_t"]) & (spots["tile"] == p["_tile"])
    return spots.join(p, same).where(F.abs(F.col("pos") - F.col("anchor")) < F.col("reach")).select("wid", "doc_id", "k", "anchor", "reach", "term", "pos")


def proximity_matches(postings: DataFrame, terms: DataFrame, counts: DataFrame, slack: int = SLACK, size: int = WINDOW) -> DataFrame:
    """``wid, doc_id, k``: documents with all different terms of a window, in any order, within a stretch of ``len + slack`` words."""
    each = terms.groupBy("wid", "len", "term").agg(F.lit(1).alias("one")).join(bounded(counts, BROADCAST_ROWS), "term", "left")
    by_wid = Window.partitionBy("wid")
    need = (
        each.withColumn("different", F.count("*").over(by_wid)).withColumn("known", F.count("n").over(by_wid)).where("known = different")
        .withColumn("rank", F.row_number().over(by_wid.orderBy("n", "term"))).withColumn("reach", F.col("len") + slack)
    )
    need = stored(need.select("wid", "reach", "term", "rank", "different"), "near-terms", FILES)
    anchors = postings.join(bounded(need.where("rank = 1").select("wid", "term"), BROADCAST_ROWS), "term").select("wid", "doc_id", "k", F.col("pos").alias("anchor"))
    second = need.where("rank = least(2, different)")
    seconds = bounded(second.select("term").distinct(), BROADCAST_ROWS)
    two = _beside(anchors, second, postings.join(seconds, "term", "left_semi"), size + slack).select("wid", "doc_id", "k", "anchor").distinct()
    two = stored(two, "near-candidates")
    # a stretch has at most so many words on each side of the anchor
    around = (
        _beside(two, need, _of(postings.where(F.col("term") > 0), two), size + slack)
        .groupBy("wid", "doc_id", "k", "anchor", "reach").agg(F.collect_set(F.struct("pos", "term")).alias("hits"))
        .join(bounded(need.where("rank = 1").select("wid", "different"), BROADCAST_ROWS), "wid")
    )
    inside = lambda s: F.filter("hits", lambda h: (h["pos"] >= s["pos"]) & (h["pos"] < s["pos"] + F.col("reach")))
    whole = F.exists("hits", lambda s: F.size(F.array_distinct(F.transform(inside(s), lambda h: h["term"]))) == F.col("different"))
    return around.where(whole).select("wid", "doc_id", "k").distinct()


def _items(found: DataFrame, owners: DataFrame) -> DataFrame:
    """``doc_id, k, ids``: the sorted ids, as strings, of the items with windows in ``found(wid, doc_id, k)``."""
    named = found.select("wid", "doc_id", "k").distinct().join(bounded(owners, BROADCAST_ROWS), "wid")
    return named.groupBy("doc_id", "k").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_items: int = MIN_ITEMS, slack: int | None = SLACK) -> DataFrame:
    """``doc_id, k, n_words, n_hit, n_items, items_sha256, contaminated, n_near`` for each row of ``docs``.

    ``n_near`` counts the items with a proximity match, phrases among them; without ``slack`` it is null.
    Null and empty texts have no words; rows that share id and text are looked up once and
    each get the result; rows that share an id alone are kept apart by their texts.
    Items with equal windows all count; an item with a null id counts under the empty id.  Without items nothing is hit,
    an empty table gives no rows, and other columns are ignored.
    """
    with scope(docs.sparkSession) as keep:
        terms, lexicon, owners = windows(items, size)
        postings = build_index(docs, lexicon)
        counts = term_counts(postings)
        found = stored(phrase_matches(postings, terms, counts), "matches")
        ahead = Window.partitionBy("doc_id", "k").orderBy("start", "wid").rowsBetween(Window.unboundedPreceding, -1)
        hits = (
            found.withColumn("end", F.col("start") + F.col("len")).withColumn("done", F.coalesce(F.max("end").over(ahead), F.lit(0)))
            .groupBy("doc_id", "k").agg(F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", "done"))).cast("long").alias("n_hit"))
        )
        parts = [
            hits.select("doc_id", "k", "n_hit", *[F.lit(None).cast(t).alias(c) for c, t in (("n_items", "long"), ("items_sha256", "string"), ("n_near", "long"))]),
            _items(found, owners).select(
                "doc_id", "k", F.lit(None).cast("long").alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"), F.lit(None).cast("long").alias("n_near")
            ),
        ]
        if slack is not None:
            near = _items(proximity_matches(postings, terms, counts, slack, size), owners)
            parts.append(near.select("doc_id", "k", *[F.lit(None).cast(t).alias(c) for c, t in (("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"))], F.size("ids").cast("long").alias("n_near")))
        together = parts[0]
        for p in parts[1:]:
            together = together.unionByName(p)
        per_doc = together.groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(*[F.max(c).alias(c) for c in ("n_hit", "n_items", "items_sha256", "n_near")])
        per_doc = stored(per_doc, "contaminated")
        ends = postings.where("term = 0").select("doc_id", "k", F.col("pos").cast("long").alias("n_words"))
        zero = F.lit(0).cast("long")
        out = ends.join(bounded(per_doc, BROADCAST_ROWS), ends["doc_id"].eqNullSafe(per_doc["_d"]) & (ends["k"] == per_doc["_k"]), "left").select(
            "doc_id", "k", "n_words",
            F.coalesce("n_hit", zero).alias("n_hit"),
            F.coalesce("n_items", zero).alias("n_items"),
            F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_items", zero) >= min_items).alias("contaminated"),
            (F.lit(None).cast("long") if slack is None else F.coalesce("n_near", zero)).alias("n_near"),
        )
        return keep(stored(out, "contamination"))


def decontaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, min_items: int = MIN_ITEMS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; columns of any name pass through."""
    id_, key, own = fresh(docs, "_id", "_key", "_own")
    bad = contamination(docs, items, size, min_items, slack=None).where("contaminated").select(F.col("doc_id").alias(id_), F.col("k").alias(key)).distinct()
    rows = docs.withColumn(own, text_key())
    return rows.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(key)), "left_anti").drop(own)


def op1_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """:func:`contamination` at the production parameters."""
    return contamination(docs, items).drop("k")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 8) AS n, array_to_string(ws[i + 1 : i + 8], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(greatest(len(ws) - 8, 0) + 1)) AS i FROM b WHERE len(ws) > 0)
), lens AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)
), m AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.w = bw.w AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
vt AS (SELECT DISTINCT n, w, unnest(string_split(w, ' ')) AS term FROM bw), vd AS (SELECT n, w, count(*) AS different FROM vt GROUP BY n, w),
c AS (SELECT doc_id, vt.n, vt.w, different FROM (SELECT DISTINCT doc_id, unnest(ws) AS term FROM d) AS dt JOIN vt USING (term) JOIN vd ON vd.n = vt.n AND vd.w = vt.w
  GROUP BY doc_id, vt.n, vt.w, different HAVING count(*) = different),
hp AS (SELECT c.doc_id, c.n, c.w, different, vt.term, pos FROM c JOIN vt ON vt.n = c.n AND vt.w = c.w JOIN (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM d) AS dp ON dp.doc_id = c.doc_id AND dp.term = vt.term),
near AS (SELECT DISTINCT doc_id, n, w FROM (SELECT x.doc_id, x.n, x.w FROM (SELECT *, unnest([pos // 12, pos // 12 + 1]) AS tile FROM hp) AS x
  JOIN (SELECT *, pos // 12 AS tile FROM hp) AS z ON z.doc_id = x.doc_id AND z.n = x.n AND z.w = x.w AND z.tile = x.tile AND z.pos >= x.pos AND z.pos < x.pos + x.n + 4
  GROUP BY x.doc_id, x.n, x.w, x.pos, x.different HAVING count(DISTINCT z.term) = x.different)),
nr AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM near JOIN bw USING (n, w) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN nr USING (doc_id)
"""
