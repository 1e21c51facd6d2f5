"""Keyword search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import lexical
from tessera.operators.text_index import TextIndex
from tessera.plans.registry import Tables, query
from tessera.session import once, scratch_path

TEXT = "the erst tion"
MISSPELT = ["teh", "thr", "onn", "thing", "andd", "fromm", "zzzzzzzzzz", "requestt"]
_WORDS = r"regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\1 \2', 'g')), '[a-z0-9_]{3,}')"
VOCABULARY_SQL = f"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct({_WORDS})) AS word FROM documents) GROUP BY word"


def indexed(t: Tables) -> TextIndex:
    """An index of all documents, written once for each application and folder."""

    def write() -> str:
        path = scratch_path(t.spark, "text-index")
        TextIndex(t.spark, path, ("lang", "source")).upsert(t.documents)
        return path

    return TextIndex(t.spark, once(t.spark, f"text-index {t.folder}", write), ("lang", "source"))


@query(VOCABULARY_SQL)
def vocabulary(t: Tables) -> DataFrame:
    return lexical.vocabulary(t.documents)


@query(
    """SELECT doc_id, round(least(1.0::DOUBLE, 0.2::DOUBLE * len(regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^a-z0-9_])(?:the|erst|tion)'))), 6) AS score
    FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(?:^|[^a-z0-9_])(?:the|erst|tion)') ORDER BY score DESC, doc_id LIMIT 20"""
)
def fts_prefix_search(t: Tables) -> DataFrame:
    return indexed(t).search(TEXT, 20)


COVERAGE_SQL = """SELECT doc_id, round((CAST(contains(lower(text), 'erst') AS INT) + CAST(contains(lower(text), 'tion') AS INT) + CAST(contains(lower(text), 'ouble') AS INT)) / 3.0, 6) AS score
    FROM documents WHERE contains(lower(text), 'erst') OR contains(lower(text), 'tion') OR contains(lower(text), 'ouble') ORDER BY score DESC, doc_id"""


@query(COVERAGE_SQL + " LIMIT 20")
def term_coverage_search(t: Tables) -> DataFrame:
    return indexed(t).coverage("(the) erst tion: ouble Erst", 20)


@query(
    f"""WITH v AS ({VOCABULARY_SQL}), t AS (SELECT unnest({MISSPELT!r}) AS term), m AS (SELECT term, CASE WHEN length(term) <= 4 THEN 1 WHEN length(term) <= 12 THEN 2 ELSE 3 END AS most FROM t),
    c AS (SELECT term, word, levenshtein(term, word) AS d, row_number() OVER (PARTITION BY term ORDER BY levenshtein(term, word), word) AS n
      FROM m JOIN v ON length(word) BETWEEN length(term) - most AND length(term) + most WHERE levenshtein(term, word) <= most)
    SELECT t.term, CASE WHEN d > 0 THEN word END AS word, CASE WHEN d > 0 THEN d END AS distance FROM t LEFT JOIN c ON t.term = c.term AND c.n = 1"""
)
def fuzzy_correct(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(w,) for w in MISSPELT], "term string")
    return lexical.corrections(asked, lexical.vocabulary(t.documents))


@query()
def proximity_rerank(t: Tables) -> DataFrame:
    hits = lexical.term_coverage(t.documents, "erst tion ouble", 50).join(t.documents, "doc_id")
    return lexical.proximity_rerank(
        hits.select(F.lit(1).cast("long").alias("query_id"), F.lit("erst tion ouble").alias("query"), F.col("doc_id").alias("id"), "score", F.col("text").alias("content"), F.lit(None).cast("string").alias("title"), F.lit(False).alias("is_code"))
    )


_INTENT = "the erst tion lines 1"


@query(
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE strlen(text) >= 5000), c AS (SELECT doc_id, s, ls[s + 1 : s + 50] AS part, least(s + 50, len(ls)) AS e FROM (SELECT doc_id, ls, unnest(range(0, len(ls), 50)) AS s FROM l)),
    k AS (SELECT doc_id, s, e, list_filter(regexp_extract_all(lower(array_to_string(part, chr(10))), '[a-z0-9_]{{3,}}'), lambda w: NOT list_contains({list(lexical.INTENT_STOP_WORDS)!r}, w)) AS ws FROM c WHERE trim(regexp_replace(array_to_string(part, ''), '\\s+', '', 'g')) <> ''),
    f AS (SELECT doc_id, s, e, coalesce(max(n), 1) AS most, coalesce(max(n) FILTER (WHERE w = 'erst'), 0) AS a, coalesce(max(n) FILTER (WHERE w = 'tion'), 0) AS b, coalesce(max(n) FILTER (WHERE w = 'lines'), 0) AS g
      FROM (SELECT doc_id, s, e, w, count(*) AS n FROM (SELECT doc_id, s, e, unnest(ws) AS w FROM k) GROUP BY ALL) GROUP BY doc_id, s, e),
    r AS (SELECT k.doc_id, k.s, k.e, coalesce((a + b + g) / greatest(1, most), 0) + 0.5 AS score FROM k LEFT JOIN f ON f.doc_id = k.doc_id AND f.s = k.s)
    SELECT doc_id AS id, s + 1 AS line_start, e AS line_end, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, s) AS n FROM r) WHERE n <= 5"""
)
def intent_search(t: Tables) -> DataFrame:
    return lexical.intent_search(t.documents.select(F.col("doc_id").alias("id"), "text"), _INTENT).select("id", "line_start", "line_end", "score")


@query(
    """SELECT doc_id, round(least(1.0::DOUBLE, 0.2::DOUBLE * len(regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^a-z0-9_])(?:the|erst|tion)'))), 6) AS score
    FROM documents WHERE lang = 'en' AND source = 'src3' AND regexp_matches(lower(coalesce(text, '')), '(?:^|[^a-z0-9_])(?:the|erst|tion)') ORDER BY score DESC, doc_id LIMIT 20"""
)
def fts_filtered_search(t: Tables) -> DataFrame:
    return indexed(t).search(TEXT, 20, lang="en", source="src3")


_CHANGED = "(SELECT doc_id, CASE WHEN lang = 'fr' THEN 'the thesis ' || text ELSE text END AS text, lang FROM documents WHERE source <> 'src5')"


def changed_index(t: Tables) -> TextIndex:
    """An index that has taken an upsert of one language, a delete of one source, and a merge."""
    index = TextIndex(t.spark, scratch_path(t.spark, "changed-index"), ("lang", "source"))
    index.upsert(t.documents)
    index.upsert(t.documents.where("lang = 'fr'").withColumn("text", F.concat(F.lit("the thesis "), "text")))
    index.delete(t.documents.where("source = 'src5'"))
    index.merge(least=2)
    return index


@query(
    f"""SELECT doc_id, round(least(1.0::DOUBLE, 0.2::DOUBLE * len(regexp_extract_all(lower(coalesce(text, '')), '(?:^|[^a-z0-9_])(?:thes|erst)'))), 6) AS score
    FROM {_CHANGED} WHERE regexp_matches(lower(coalesce(text, '')), '(?:^|[^a-z0-9_])(?:thes|erst)') ORDER BY score DESC, doc_id LIMIT 50"""
)
def index_after_changes(t: Tables) -> DataFrame:
    return changed_index(t).search("thes erst", 50)


@query(f"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'))) AS word FROM {_CHANGED}) GROUP BY word")
def index_words_after_changes(t: Tables) -> DataFrame:
    return changed_index(t).vocabulary()


@query(
    """SELECT doc_id, round((CAST(lower(text) LIKE '%re_ti%' AS INT) + CAST(contains(lower(text), 'eanau') AS INT)) / 2.0, 6) AS score
    FROM documents WHERE (lower(text) LIKE '%re_ti%' OR contains(lower(text), 'eanau')) ORDER BY score DESC, doc_id LIMIT 200"""
)
def wildcard_search(t: Tables) -> DataFrame:
    """Terms with wild characters, by the trigrams of their fixed parts."""
    return indexed(t).coverage("re_ti eanau", 200)


@query(
    f"""WITH v AS ({VOCABULARY_SQL}), t AS (SELECT unnest({[*MISSPELT, "teh other", " thr ", "ab"]!r}) AS query), q AS (SELECT query, list_filter(string_split_regex(lower(trim(query)), '\\s+'), lambda w: w <> '') AS ws FROM t),
    o AS (SELECT query, ws[1] AS term, CASE WHEN length(ws[1]) <= 4 THEN 1 WHEN length(ws[1]) <= 12 THEN 2 ELSE 3 END AS most FROM q WHERE len(ws) = 1 AND length(ws[1]) >= 3),
    c AS (SELECT query, word, levenshtein(term, word) AS d, row_number() OVER (PARTITION BY query ORDER BY levenshtein(term, word), word) AS n FROM o JOIN v ON abs(length(word) - length(term)) <= most AND levenshtein(term, word) <= most)
    SELECT t.query, CASE WHEN d > 0 THEN word ELSE t.query END AS corrected FROM t LEFT JOIN c ON c.query = t.query AND n = 1"""
)
def query_correction(t: Tables) -> DataFrame:
    asked = t.spark.createDataFrame([(w,) for w in [*MISSPELT, "teh other", " thr ", "ab"]], "query string")
    return lexical.corrected_queries(asked, lexical.vocabulary(t.documents))


@query(
    """WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(coalesce(text, ''), '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z0-9_]{3,}')) AS word FROM documents),
    n AS (SELECT doc_id, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT word, round(sum(n) / count(*), 6) AS score FROM n GROUP BY word ORDER BY score DESC, word LIMIT 10"""
)
def distinctive_terms(t: Tables) -> DataFrame:
    return lexical.distinctive_terms(t.documents.select(F.col("doc_id").alias("chunk_id"), "text"))


@query(
    """SELECT c.conv_id, c.turn, length(c.text) AS importance FROM conversations c
    WHERE (contains(lower(c.text), 'erst') OR contains(lower(c.text), 'ouble')) AND NOT EXISTS
      (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.role = c.role AND n.turn = c.turn + 2) ORDER BY importance DESC, conv_id, turn LIMIT 30"""
)
def memory_text_search(t: Tables) -> DataFrame:
    """Turns that contain a token and that no later turn of the same speaker supersedes."""
    c = t.conversations
    later = c.select(F.col("conv_id"), (F.col("turn") - 2).alias("turn"), "role")
    found = c.where(lexical.contains_any(F.col("text"), ["erst", "ouble"])).join(later, ["conv_id", "turn", "role"], "left_anti")
    return found.select("conv_id", "turn", F.length("text").cast("long").alias("importance")).orderBy(F.col("importance").desc(), "conv_id", "turn").limit(30)


@query(
    """WITH k AS (SELECT doc_id, term, string_split(lower(text), term) AS parts FROM documents, (VALUES ('erst'), ('ouble')) AS v(term) WHERE contains(lower(text), 'erst') AND contains(lower(text), 'ouble')),
    p AS (SELECT doc_id, term, i, n, sum(length(part)) OVER (PARTITION BY doc_id, term ORDER BY i) + (i - 1) * length(term) AS pos FROM (SELECT doc_id, term, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i, len(parts) AS n FROM k))
    SELECT a.doc_id, CAST(min(abs(a.pos - b.pos)) AS BIGINT) AS span FROM p a JOIN p b ON a.doc_id = b.doc_id AND a.term = 'erst' AND b.term = 'ouble' AND a.i < a.n AND b.i < b.n GROUP BY a.doc_id"""
)
def term_spans(t: Tables) -> DataFrame:
    return lexical.term_spans(t.documents, ["Erst", "ouble"])


@query(
    """SELECT doc_id, CAST(contains(lower(text), 'of the') AS BIGINT) + CAST(contains(lower(text), 'and the') AS BIGINT) + CAST(contains(lower(text), 'is that') AS BIGINT) AS phrases FROM documents
    WHERE contains(lower(text), 'of the') OR contains(lower(text), 'and the') OR contains(lower(text), 'is that') ORDER BY phrases DESC, doc_id LIMIT 100"""
)
def expanded_phrase_search(t: Tables) -> DataFrame:
    """A query and its expansions as one OR of phrases."""
    return lexical.phrase_search(t.documents, lexical.phrase_query("Of the", ['and "the"', "is that", "Of the"]), 100)
