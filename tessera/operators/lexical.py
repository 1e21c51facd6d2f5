"""Keyword search, correction of misspelt terms, and reranking by proximity."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that a keyword query drops.
STOP_WORDS = (
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "has", "his", "how", "its", "may", "new", "now", "old", "see", "way", "who", "did", "get", "got", "let",
    "say", "she", "too", "use", "will", "with", "this", "that", "from", "they", "been", "have", "many", "some", "them", "than", "each", "make", "like", "just", "over", "such", "take", "into", "year",
    "your", "good", "could", "would", "about", "which", "their", "there", "other", "after", "should", "through", "also", "more", "most", "only", "very", "when", "what", "then", "these",
    "those", "being", "does", "done", "both", "same", "still", "while", "where", "here", "were", "much",
)
# Words that a search in long outputs drops, and the size from which it searches.
INTENT_STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for", "of",
    "to", "in", "on", "at", "by", "with", "from", "is", "are", "was", "were",
    "be", "been", "being", "this", "that", "these", "those", "it", "its",
    "as", "at", "use", "using", "used", "into", "not", "no", "yes", "true",
    "false", "null", "none", "undefined", "function", "return", "var", "let",
    "const", "import", "export", "class", "def", "func", "fn",
)
INTENT_BYTES = 5_000


def split_camel(text: Column) -> Column:
    return F.regexp_replace(text, r"([a-z])([A-Z])", "$1 $2")


def words(text: Column, least: int = 3) -> Column:
    """Lower-case words of ``[a-z0-9_]``, camel case split, of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(split_camel(F.coalesce(text, F.lit("")))), F.lit(rf"([a-z0-9_]{{{least},}})"), 1)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, df``: the documents that each word is in."""
    return docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def query_terms(text: str, least: int = 3) -> list[str]:
    """Lower-case terms of a full-text query."""
    bare = (re.sub(r"[^a-z0-9_]", "", w) for w in text.lower().split())
    return [w for w in bare if len(w) >= least]


def sanitized(text: str) -> list[str]:
    """Terms of a coverage query: without punctuation, at least three characters, each once, and no stop
    words unless there is nothing else."""
    clean = re.sub(r"""["'(){}\[\]*:^~]""", "", text).strip()
    seen: dict[str, str] = {}
    for w in clean.split() if len(clean) >= 3 else ():
        if len(w) >= 3:
            seen.setdefault(w.lower(), w)
    kept = [w for k, w in seen.items() if k not in STOP_WORDS]
    return kept or list(seen.values())


def phrase_query(text: str, expansions: list[str]) -> str:
    """An OR of the quoted query and its expansions."""
    parts = dict.fromkeys(p.strip().replace('"', "") for p in [text, *expansions])
    return " OR ".join(f'"{p}"' for p in parts if p)


def postings(docs: DataFrame, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """``word, doc_id, n``: a keyword index.  Written sorted by ``word``, a search reads the row groups of its prefixes alone."""
    ws = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(content), F.lit(""))), F.lit("([a-z0-9_]+)"), 1)).alias("word"))
    return ws.groupBy("word", "doc_id").agg(F.count("*").alias("n"))


def write_postings(docs: DataFrame, path: str) -> None:
    postings(docs).repartitionByRange("word").sortWithinPartitions("word", "doc_id").write.parquet(path)


def index_search(index: DataFrame, text: str, limit: int, docs: DataFrame | None = None, **filters: object) -> DataFrame:
    """``doc_id, score``: documents with words that begin with a term, by an index ``word, doc_id, n``; ``filters`` are values of columns of ``docs``.

    Each word that matches is a cover of an OR query by itself and counts a tenth; the score is doubled, at most 1.
    """
    terms = query_terms(text)
    if not terms:
        return index.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    hit = sum_or([F.col("word").startswith(t) for t in terms])
    found = index.where(hit).groupBy("doc_id").agg(F.sum("n").alias("n"))
    if docs is not None:
        kept = docs
        for column, value in filters.items():
            if value is not None:
                kept = kept.where(F.col(column) == F.lit(value))
        found = found.join(kept.select("doc_id"), "doc_id", "left_semi")
    return found.select("doc_id", F.round(F.least(F.lit(1.0), 2 * 0.1 * F.col("n")), 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(limit)


def prefix_search(docs: DataFrame, text: str, limit: int, doc_id: str = "doc_id", content: str = "text") -> DataFrame:
    """:func:`index_search` without an index: one pass over the texts."""
    terms = query_terms(text)
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    found = F.regexp_count(F.lower(F.coalesce(F.col(content), F.lit(""))), F.lit(rf"(?:^|[^a-z0-9_])(?:{'|'.join(terms)})"))
    hits = docs.select(doc_id, F.round(F.least(F.lit(1.0), 2 * 0.1 * found), 6).alias("score")).where("score > 0")
    return hits.orderBy(F.col("score").desc(), doc_id).limit(limit)


def term_coverage(docs: DataFrame, text: str, limit: int, doc_id: str = "doc_id", content: str = "text", wild: bool = True) -> DataFrame:
    """The share of the query's terms that a document contains, in any case.

    ``_`` and ``%`` of a term are wild, as they are in ``ILIKE``, unless ``wild`` is off.
    """
    terms = sanitized(text)
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("score")).limit(0)
    low = F.lower(F.coalesce(F.col(content), F.lit("")))

    def has(term: str) -> Column:
        if wild and re.search("[_%]", term):
            return low.like("%" + term.lower() + "%")
        return F.contains(low, F.lit(term.lower()))

    matched = sum((has(t).cast("int") for t in terms[1:]), has(terms[0]).cast("int"))
    hits = docs.select(doc_id, F.round(matched / float(len(terms)), 6).alias("score")).where("score > 0")
    return hits.orderBy(F.col("score").desc(), doc_id).limit(limit)


def max_edits(length: Column) -> Column:
    return F.when(length <= 4, 1).when(length <= 12, 2).otherwise(3)


#: Words with more characters than this may have three edits.
LONG = 12
_BASE, _FIRST, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D)


class _Runs:
    """Hashes of parts of words of one length ``m``, given as a matrix of code points; ``run(i, j)`` is that of the characters from ``i`` to ``j``."""

    def __init__(self, points: np.ndarray):
        self.m = points.shape[1]
        self.power = [np.uint64(pow(int(_BASE), i, 1 << 64)) for i in range(self.m + 1)]
        self.heads = [np.zeros(len(points), np.uint64)]
        for i in range(self.m):
            self.heads.append(self.heads[-1] * _BASE + points[:, i] + np.uint64(1))

    def run(self, i: int, j: int) -> np.ndarray:
        return self.heads[j] - self.heads[i] * self.power[j - i]

    def without(self, i: int, j: int, *gone: int) -> np.ndarray:
        """The characters from ``i`` to ``j`` but for some places, which are in order."""
        out = np.zeros_like(self.heads[0])
        for a, z in zip([i, *(g + 1 for g in gone)], [*gone, j], strict=True):
            out = out * self.power[z - a] + self.run(a, z)
        return out

    def deletions(self, most: int) -> list[np.ndarray]:
        return [self.without(0, self.m, *gone) for k in range(min(most, self.m) + 1) for gone in combinations(range(self.m), k)]

    def end(self, size: int, last: bool) -> list[np.ndarray]:
        """So many characters of an end, and those without one of them."""
        i, j = (self.m - size, self.m) if last else (0, size)
        return [x ^ (_LAST if last else _FIRST) for x in (self.run(i, j), *(self.without(i, j, g) for g in range(i, j)))]


def _term_keys(runs: _Runs) -> list[np.ndarray]:
    if runs.m <= LONG:
        return runs.deletions(1 if runs.m <= 4 else 2)
    half = runs.m // 2
    return runs.end(half, False) + runs.end(runs.m - half, True)


def _word_keys(runs: _Runs) -> list[np.ndarray]:
    out = runs.deletions(2) if runs.m <= LONG + 2 else []
    if runs.m >= LONG - 2:
        for size in range(max(1, runs.m // 2 - 4), min(runs.m, runs.m // 2 + 5) + 1):
            out += runs.end(size, False) + runs.end(size, True)
    return out


def neighbour_keys(word: Column, asked: bool) -> Column:
    """Hashes, of which those of an asked term and those of each word within :func:`max_edits` have one in common.

    Words within one or two edits have a form in common that lacks as many characters of either.  Of a longer term one half has one edit at most, so that
    it has a form in common with an end of the word; the keys then grow with the square of the length, not with its cube.
    """
    keys = _term_keys if asked else _word_keys

    @F.arrow_udf("array<bigint>")
    def run(batch: pa.Array) -> pa.Array:
        words = [w or "" for w in batch.to_pylist()]
        sizes = np.array([len(w) for w in words])
        found = {}
        for m in set(sizes.tolist()):
            at = np.flatnonzero(sizes == m)
            points = np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(at), m).astype(np.uint64)
            found[m] = (at, np.column_stack(keys(_Runs(points))))
        each = np.zeros(len(words), np.int64)
        for at, k in found.values():
            each[at] = k.shape[1]
        ends = np.concatenate([[0], np.cumsum(each)])
        flat = np.empty(ends[-1], np.uint64)
        for at, k in found.values():
            flat[ends[at][:, None] + np.arange(k.shape[1])] = k
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))

    return run(word)


def corrections(terms: DataFrame, known: DataFrame) -> DataFrame:
    """``term, word, distance``: the nearest known word, ties to the first in order; null if the term is known or none is near.

    Terms and words meet on equal hashes of what is left of them without a few characters, so that a key is shared by near words alone;
    then the edits are counted with a bound.
    """
    asked = terms.select("term").distinct().withColumn("most", max_edits(F.length("term")))
    longest = asked.agg(F.coalesce(F.max(F.length("term")), F.lit(0))).first()[0] + 3
    near = (
        known.where(F.length("word") <= longest).select("word", F.explode(neighbour_keys(F.col("word"), asked=False)).alias("key"))
        .join(asked.select("term", "most", F.explode(neighbour_keys(F.col("term"), asked=True)).alias("key")), "key")
        .select("term", "word", "most").distinct()
        .withColumn("distance", F.levenshtein("term", "word", 3)).where("distance between 0 and most")
        .groupBy("term").agg(F.min(F.struct("distance", "word")).alias("best"))
    )
    out = asked.select("term").join(near, "term", "left")
    exact = F.col("best.distance") == 0
    return out.select("term", F.when(~exact, F.col("best.word")).alias("word"), F.when(~exact, F.col("best.distance").cast("long")).alias("distance"))


def corrected_queries(queries: DataFrame, known: DataFrame) -> DataFrame:
    """``query, corrected``: queries of one word in its nearest known form; others, and those without a near word, as they are."""
    ws = queries.select("query", F.filter(F.split(F.lower(F.trim("query")), r"\s+"), lambda w: w != "").alias("ws"))
    single = ws.where((F.size("ws") == 1) & (F.length(F.element_at("ws", 1)) >= 3)).select("query", F.element_at("ws", 1).alias("term"))
    fixed = single.join(corrections(single.select("term"), known).where("word is not null"), "term").select("query", F.col("word").alias("_w"))
    return queries.select("query").join(fixed.distinct(), "query", "left").select("query", F.coalesce("_w", "query").alias("corrected"))


def min_span(positions: list[list[int]]) -> float:
    """The smallest window that has a position of every list."""
    if len(positions) < 2 or not all(positions):
        return 0 if len(positions) == 1 else float("inf")
    merged = sorted((p, i) for i, ps in enumerate(positions) for p in ps)
    counts, missing, left, best = [0] * len(positions), len(positions), 0, float("inf")
    for p, i in merged:
        counts[i] += 1
        missing -= counts[i] == 1
        while not missing:
            q, j = merged[left]
            best = min(best, p - q)
            counts[j] -= 1
            missing += counts[j] == 0
            left += 1
    return best


def adjacent_pairs(positions: list[list[int]], terms: list[str], gap: int = 30) -> int:
    """Neighbouring terms of the query that follow each other within ``gap``; each right position counts once."""
    total = 0
    for i in range(len(terms) - 1):
        right = iter(positions[i + 1])
        at = next(right, None)
        for p in positions[i]:
            start = p + len(terms[i])
            while at is not None and at < start:
                at = next(right, None)
            if at is not None and at <= start + gap:
                total += 1
                at = next(right, None)
    return total


def _positions(text: str, term: str) -> list[int]:
    return [m.start() for m in re.finditer(f"(?={re.escape(term)})", text)]


def term_spans(docs: DataFrame, terms: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, span``: the smallest distance from a first to a last character place that holds all ``terms``, in any case; documents that lack one are left out."""

    @F.arrow_udf("long")
    def run(batch: pa.Array) -> pa.Array:
        out = []
        for x in batch.to_pylist():
            low = (x or "").lower()
            at = [_positions(low, t.lower()) for t in terms] if all(t.lower() in low for t in terms) else []
            out.append(int(min_span(at)) if at else None)
        return pa.array(out, pa.int64())

    return docs.select(F.col(doc_id).alias("doc_id"), run(F.col(text)).alias("span")).where("span is not null")


def phrase_search(docs: DataFrame, query: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, phrases``: how many of the quoted phrases of an OR ``query``, as :func:`phrase_query` writes it, a document holds, in any case; most first."""
    phrases = list(dict.fromkeys(p.lower() for p in re.findall('"([^"]+)"', query)))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    found = sum((F.contains(low, F.lit(p)).cast("long") for p in phrases), F.lit(0).cast("long"))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("phrases")).where("phrases > 0").orderBy(F.desc("phrases"), "doc_id").limit(limit)


def proximity_boost(content: str, title: str, is_code: bool, terms: list[str]) -> float:
    hits = sum(t in title.lower() for t in terms)
    boost = (0.6 if is_code else 0.3) * hits / len(terms) if hits else 0.0
    if len(terms) >= 2:
        low = content.lower()
        at = [_positions(low, t) for t in terms]
        if all(at):
            boost += 1 / (1 + min_span(at) / max(len(low), 1)) + 0.5 * min(1, adjacent_pairs(at, terms) / 4)
    return boost


def proximity_rerank(hits: DataFrame, schema: str = "query_id long, id long, score double, rank long, boost double") -> DataFrame:
    """Hits ``query_id, query, id, score, content, title, is_code`` in order of score, but by boost within runs of scores
    that are 0.01 from the run's first at most."""

    def rerank(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "id"], ascending=[False, True])
        low = str(group["query"].iloc[0]).lower().split()
        asked = [w for w in low if len(w) >= 2]
        terms = [w for w in asked if w not in STOP_WORDS] or asked
        boost = [proximity_boost(c or "", t or (c or "").split("\n", 1)[0][:80], bool(k), terms) if terms else 0.0 for c, t, k in zip(group["content"], group["title"], group["is_code"], strict=True)]
        run, head, n = [], None, -1
        for s in group["score"]:
            if head is None or head - s > 0.01:
                head, n = s, n + 1
            run.append(n)
        out = group.assign(boost=boost, run=run).sort_values(["run", "boost"], ascending=[True, False], kind="stable")
        return out.assign(rank=range(1, len(out) + 1))[["query_id", "id", "score", "rank", "boost"]]

    return hits.groupBy("query_id").applyInPandas(rerank, schema)


def intent_tokens(text: Column) -> Column:
    """Lower-case words of three characters or more, without common ones, as often as they are there."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{3,})"), 1), lambda w: ~w.isin(*INTENT_STOP_WORDS))


def intent_search(outputs: DataFrame, intent: str, limit: int = 5, least_bytes: int = INTENT_BYTES, lines: int = 50) -> DataFrame:
    """``id, line_start, line_end, label, preview, score``: of each long output ``id, text`` the sections that fit an intent best.

    Sections are of ``lines`` lines.  A term scores its frequency over that of the section's commonest word, and a half if
    a section's label has it.  Outputs below ``least_bytes`` are not searched.
    """
    long = outputs.where(F.octet_length("text") >= least_bytes)
    ls = F.split("text", "\n", -1)
    cut = long.select("id", ls.alias("ls")).select("id", "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(lines))).alias("s"))
    part = F.slice("ls", F.col("s") + 1, lines)
    sections = cut.select(
        "id", (F.col("s") + 1).cast("long").alias("line_start"), F.least(F.col("s") + lines, F.size("ls")).cast("long").alias("line_end"), F.array_join(part, "\n").alias("content"), first_line(part).alias("preview")
    ).where(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")
    label = F.concat(F.lit("lines "), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"))
    sections = sections.withColumn("label", label)
    return ranked_sections(sections, intent, limit)


def ranked_sections(sections: DataFrame, intent: str, limit: int = 5) -> DataFrame:
    """The ``limit`` best ``sections(id, line_start, line_end, label, content, preview)`` of each output for an intent."""
    low = [w for w in re.findall("[a-z0-9_]{3,}", intent.lower()) if w not in INTENT_STOP_WORDS]
    key = ["id", "line_start"]
    ws = sections.select(*key, F.explode(intent_tokens(F.col("content"))).alias("w")).groupBy(*key, "w").agg(F.count("*").alias("n"))
    used = ws.groupBy(*key).agg(F.max("n").alias("most"), *[F.max(F.when(F.col("w") == t, F.col("n"))).alias(f"t{i}") for i, t in enumerate(low)])
    score = F.lit(0.0)
    for i, t in enumerate(low):
        score = score + F.coalesce(F.col(f"t{i}") / F.col("most"), F.lit(0.0)) + F.when(F.array_contains(intent_tokens(F.col("label")), t), 0.5).otherwise(0.0)
    scored = sections.drop("content").join(used, key, "left").withColumn("score", F.round(score, 6))
    if low:
        scored = scored.where("score > 0")
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "line_start"))
    return scored.withColumn("nth", nth).where(F.col("nth") <= limit).select("id", "line_start", "line_end", "label", F.substring("preview", 1, 120).alias("preview"), "score")


def first_line(lines: Column) -> Column:
    """The first line with text that is no header of a chunk, or else the first line."""
    real = F.filter(lines, lambda x: (F.ltrim(x) != "") & ~F.ltrim(x).rlike("^// (File|Section):"))
    return F.coalesce(F.try_element_at(real, F.lit(1)), F.element_at(lines, 1))


def distinctive_terms(chunks: DataFrame, limit: int = 10) -> DataFrame:
    """``word, score``: uses over the chunks that have the word; more first, then by word."""
    per = chunks.select("chunk_id", F.explode(words(F.col("text"))).alias("word")).groupBy("chunk_id", "word").agg(F.count("*").alias("n"))
    return per.groupBy("word").agg(F.round(F.sum("n") / F.count("*"), 6).alias("score")).orderBy(F.col("score").desc(), "word").limit(limit)


def contains_any(text: Column, tokens: list[str]) -> Column:
    """Whether a text contains one of the tokens, in any case."""
    return F.lit(False) if not tokens else sum_or([F.contains(F.lower(text), F.lit(t.lower())) for t in tokens])


def sum_or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out
