"""Rank fusion, gates, and session-aware reranking.

All operators take hits of many queries at once: ``query_id, id, score`` and what
else they name.  Ties go to the smaller id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import clamp01, cosine

RRF_K = 60
VECTOR_WEIGHT = 0.3
KEYWORD_BOOST = 2.5
PER_FILE = 2
MIN_SCORE = 0.3
HALF_LIFE_DAYS = 7.0
HEAD = 50
#: Weights of the signals of attention.
ATTENTION = {"semantic": 0.25, "recency": 0.15, "heat": 0.15, "task": 0.2, "affinity": 0.1, "confidence": 0.15}

# What makes a query look like code.
CODE_PATTERNS = (r"\w+\(\)", r"(?i)\bfunction\b", r"(?i)\bclass\b", r"(?i)\binterface\b", r"(?i)\benum\b", r"(?i)\btype\b", r"(?i)\bconst\b", r"(?i)\bimport\b", r"(?i)\bexport\b")


def any_match(text: Column, patterns: tuple[str, ...]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return out


def is_code_query(query: Column) -> Column:
    return any_match(query, CODE_PATTERNS)


def stream(hits: DataFrame, kind: str, name: str | None = None) -> DataFrame:
    """A stream for :func:`fuse`: hits with ``kind`` (vector, lexical or memory) and their rank from 0 on."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")) - 1
    return hits.select("query_id", "id", "score", F.lit(kind).alias("kind"), F.lit(name or kind).alias("stream"), nth.alias("rank0"))


def fuse(streams: list[DataFrame], queries: DataFrame | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, id, rrf, vector_score, keyword_score, score``.

    Vector and memory streams add up and of lexical ones the best counts, times 2.5 for the ``queries(query_id, query)``
    that look like code.  ``score`` is 0.7 of the fused score over the query's largest and 0.3 of the vector score.
    """
    rows = streams[0]
    for s in streams[1:]:
        rows = rows.unionByName(s)
    if queries is not None:
        boosts = queries.select("query_id", F.when(is_code_query(F.col("query")), KEYWORD_BOOST).otherwise(1.0).alias("boost"))
        rows = rows.join(boosts, "query_id", "left")
    else:
        rows = rows.withColumn("boost", F.lit(1.0))
    is_lexical = F.col("kind") == "lexical"
    rows = rows.withColumn("part", F.when(is_lexical, F.coalesce("boost", F.lit(1.0))).otherwise(1.0) / (RRF_K + F.col("rank0") + 1))
    fused = rows.groupBy("query_id", "id").agg(
        (F.coalesce(F.sum(F.when(~is_lexical, F.col("part"))), F.lit(0.0)) + F.coalesce(F.max(F.when(is_lexical, F.col("part"))), F.lit(0.0))).alias("rrf"),
        F.max(F.when(F.col("kind") == "vector", F.col("score"))).alias("vector_score"),
        F.max(F.when(is_lexical, F.col("score"))).alias("keyword_score"),
    )
    top = F.max("rrf").over(Window.partitionBy("query_id"))
    return fused.withColumn("score", F.round((1 - VECTOR_WEIGHT) * F.col("rrf") / top + VECTOR_WEIGHT * F.coalesce("vector_score", F.lit(0.0)), 6)).withColumn("rrf", F.round("rrf", 9))


def with_centrality(hits: DataFrame, centrality: Column) -> DataFrame:
    return hits.withColumn("score", F.least(F.lit(1.0), F.col("score") * (1 + 0.2 * F.coalesce(centrality, F.lit(0.0)))))


def overfetch(k: int, filtered: bool) -> int:
    """How many hits to fetch for ``k`` results."""
    return min(5 * k, k + 200) if filtered else 2 * k


def gate(hits: DataFrame, least: float = MIN_SCORE, raw: str = "vector_score") -> DataFrame:
    """Hits whose raw score, or else fused score, is high enough."""
    return hits.where(F.coalesce(F.col(raw), F.col("score")) >= least)


def file_cap(hits: DataFrame, file: str, cap: int = PER_FILE, k: int | None = None) -> DataFrame:
    """The best ``cap`` hits of each file, and of these the best ``k`` of each query."""
    nth = F.row_number().over(Window.partitionBy("query_id", file).orderBy(F.col("score").desc(), "id"))
    kept = hits.withColumn("in_file", nth).where(F.col("in_file") <= cap).drop("in_file")
    if k is None:
        return kept
    return top_k(kept, k)


def top_k(hits: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return hits.withColumn("rank", nth).where(F.col("rank") <= k)


def explained(hits: DataFrame) -> DataFrame:
    """Hits with ``explanation``, a struct of scores and ranks from 1 on and a ``breakdown`` that says how the score came about.

    Reads ``score, rrf, vector_score, keyword_score, vector_rank, keyword_rank, combined_rank``, ranks counted from 1.
    """
    pct = lambda c: F.format_string("%.1f%%", 100 * c)
    part = lambda name, score, rank: F.when(F.col(score).isNotNull() & F.col(rank).isNotNull(), F.concat(F.lit(f"{name}: "), pct(F.col(score)), F.lit(" (rank #"), F.col(rank).cast("string"), F.lit(")")))
    parts = F.array_compact(F.array(part("Vector", "vector_score", "vector_rank"), part("Keyword", "keyword_score", "keyword_rank")))
    text = F.concat(F.array_join(parts, " + "), F.lit(" → RRF: "), F.format_string("%.4f", F.col("rrf")), F.lit(" → Final: "), pct(F.col("score")))
    names = {"score": "final_score", "vector_score": "vector_score", "keyword_score": "keyword_score", "rrf": "rrf_score", "vector_rank": "vector_rank", "keyword_rank": "keyword_rank", "combined_rank": "combined_rank"}
    return hits.withColumn("explanation", F.struct(*[F.col(c).alias(n) for c, n in names.items()], text.alias("breakdown")))


def diversified(hits: DataFrame, threshold: float = 0.85, head: int = HEAD) -> DataFrame:
    """The first ``head`` hits of each query, in order, without those whose words are more similar than ``threshold`` to ones that stay.  Reads ``content``."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    words = F.array_distinct(F.split(F.lower(F.coalesce("content", F.lit(""))), r"\s+", -1))
    top = hits.withColumn("pos", nth).where(F.col("pos") <= head).select("query_id", F.struct("pos", "id", words.alias("w")).alias("h"))
    rows = top.groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("hs"))  # at most ``head`` of them
    near = lambda a, b: F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    none = F.filter("hs", lambda h: F.lit(False))
    kept = F.aggregate("hs", none, lambda acc, h: F.when(F.exists(acc, lambda x: near(x["w"], h["w"]) > threshold), acc).otherwise(F.array_append(acc, h)))
    ids = rows.select("query_id", F.explode(F.transform(kept, lambda h: h["id"])).alias("id"))
    return hits.join(ids, ["query_id", "id"], "left_semi")


def task_alignment(content: Column, task: Column, vector: Column | None = None, task_vector: Column | None = None) -> Column:
    """How near a hit is to the task: half of one plus the cosine where both have vectors, else the share of common words."""
    shared = jaccard(tokens(content), tokens(task))
    if vector is None or task_vector is None:
        return shared
    return F.when((F.size(vector) > 0) & (F.size(vector) == F.size(task_vector)), (cosine(vector, task_vector) + 1) / 2).otherwise(shared)


def file_boost(hits: DataFrame, file: str, boosts: dict[str, float]) -> DataFrame:
    factor = F.lit(1.0)
    for name, x in boosts.items():
        factor = F.when(F.col(file) == name, x).otherwise(factor)
    return hits.withColumn("score", F.col("score") * factor)


def permuted(hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Hits in the order of a judge's ``query_id, id, position``; what it does not name follows in its old order."""
    first = verdicts.groupBy("query_id", "id").agg(F.min("position").alias("position"))
    out = hits.join(first, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("position").asc_nulls_last(), F.col("score").desc(), "id")
    return out.withColumn("rank", F.row_number().over(order)).drop("position")


def preview(content: Column, lines: int = 5) -> Column:
    return F.array_join(F.slice(F.split(F.coalesce(content, F.lit("")), "\n", -1), 1, lines), "\n")


def spectrum(hits: DataFrame, no_match: float = MIN_SCORE, low: float = 0.15, top: float = 0.8, gap: float = 0.2) -> DataFrame:
    """Per query: ``spread, mean, confidence`` of its scores and three flags."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    agg = hits.withColumn("nth", nth).groupBy("query_id").agg(
        (F.max("score") - F.min("score")).alias("spread"), F.avg("score").alias("mean"), F.max("score").alias("top"),
        F.coalesce(F.max(F.when(F.col("nth") == 2, F.col("score"))), F.lit(0.0)).alias("second"),
    )
    definitive = (F.col("top") >= top) & (F.round(F.col("top") - F.col("second"), 9) >= gap)
    none = ~definitive & (F.col("top") < no_match)
    confidence = F.col("spread") * F.col("mean")
    return agg.select(
        "query_id", F.round("spread", 6).alias("spread"), F.round("mean", 6).alias("mean"), F.round(confidence, 6).alias("confidence"),
        definitive.alias("definitive"), none.alias("no_strong_match"), (~definitive & ~none & (confidence < low)).alias("low_confidence"),
    )


def affinity(author_is_agent: Column, accesses: Column) -> Column:
    """0.6 for the agent's own, and up to 0.4 for what it has used."""
    return F.when(author_is_agent, 0.6).otherwise(0.0) + 0.4 * F.least(F.coalesce(accesses, F.lit(0)) / 10, F.lit(1.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct tokens; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9_]{2,})"), 1))


def attention(hits: DataFrame, now: Column, head: int = HEAD, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Rescores the first ``head`` hits of each query by a weighted sum of signals; the rest follow as they are.

    Reads ``created_at`` and ``access_count``, and ``task`` and ``affinity`` if there are such columns: weights are
    shared out anew among the signals that the query's head has.
    """
    per = Window.partitionBy("query_id")
    out = hits.withColumn("pos", F.row_number().over(per.orderBy(F.col("score").desc(), "id")))
    at_head = F.col("pos") <= head
    uses = F.coalesce(F.col("access_count"), F.lit(0))
    out = out.withColumn("most", F.max(F.when(at_head, uses)).over(per)).withColumn("dated", F.count(F.when(at_head, F.col("created_at"))).over(per) > 0)
    heat_on, semantic = F.col("most") > 0, clamp01(F.col("score"))
    age_days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(F.col("created_at"))) / 86_400_000_000.0)
    recency = F.when(F.col("created_at").isNotNull(), F.exp(-math.log(2) * age_days / half_life_days)).otherwise(0.0)
    heat = F.log1p(uses) / F.log1p("most")
    w = ATTENTION
    total, final = F.lit(w["semantic"] + w["confidence"]), (w["semantic"] + w["confidence"]) * semantic
    total = total + F.when(F.col("dated"), w["recency"]).otherwise(0.0) + F.when(heat_on, w["heat"]).otherwise(0.0)
    final = final + F.when(F.col("dated"), w["recency"] * recency).otherwise(0.0) + F.when(heat_on, w["heat"] * clamp01(heat)).otherwise(0.0)
    for name in ("task", "affinity"):
        if name in hits.columns:
            total, final = total + w[name], final + w[name] * clamp01(F.col(name))
    out = out.withColumn("score", F.when(at_head, F.round(final / total, 6)).otherwise(F.col("score")))
    order = per.orderBy(F.when(F.col("pos") <= head, 0).otherwise(1), F.when(F.col("pos") <= head, -F.col("score")).otherwise(F.col("pos")), "id")
    return out.withColumn("rank", F.row_number().over(order)).drop("pos", "most", "dated")


def diversity(hits: DataFrame, threshold: float = 0.85, strength: float = 0.4, same_path: float = 0.15, head: int = 4 * HEAD) -> DataFrame:
    """Scores times ``1 - strength * similarity`` for each earlier hit that is more similar than ``threshold``, and times
    ``1 - same_path`` for each earlier one of the same file.  Reads ``content`` and ``file``.

    Lists of hits are no longer than ``head``; what follows it in one keeps its score.
    """
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    out = hits.withColumn("pos", nth).withColumn("toks", tokens(F.col("content")))
    a = out.where(F.col("pos") <= head).select("query_id", "pos", "toks", "file")
    b = a.select("query_id", F.col("pos").alias("pos2"), F.col("toks").alias("toks2"), F.col("file").alias("file2"))
    sim = jaccard(F.col("toks"), F.col("toks2"))
    pairs = a.join(b, "query_id").where("pos2 < pos").withColumn("sim", sim)
    factor = F.when(F.col("sim") > threshold, 1 - strength * F.col("sim")).otherwise(1.0) * F.when((F.col("file") == F.col("file2")) & (F.col("file") != ""), 1 - same_path).otherwise(1.0)
    factors = pairs.groupBy("query_id", "pos").agg(F.product(factor).alias("factor"))
    return out.join(factors, ["query_id", "pos"], "left").withColumn("score", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6)).drop("pos", "toks", "factor")


# Words that ask for what is recent.
TEMPORAL = (
    "recent", "recente", "latest", "último", "ultima", "today", "hoje", "yesterday", "ontem", "now", "agora", "current", "atual", "just", "new", "novo",
    "this week", "this hour", "minute ago", "horas atrás", "this morning",
)


def is_temporal(query: Column) -> Column:
    low = F.lower(query)
    out = F.contains(low, F.lit(TEMPORAL[0]))
    for w in TEMPORAL[1:]:
        out = out | F.contains(low, F.lit(w))
    return out


def temporal_inhibition(hits: DataFrame, now: Column, query: Column, age_seconds: int = 3600, penalty: float = 0.15) -> DataFrame:
    """Takes ``penalty`` off hits younger than an hour, unless the query asks for what is recent."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("created_at"))) / 1e6
    young = (age >= 0) & (age < age_seconds) & ~is_temporal(query)
    return hits.withColumn("score", F.when(young, F.round(F.greatest(F.lit(0.0), F.col("score") - penalty), 6)).otherwise(F.col("score")))


# What makes a query specific, and the words that make it focused.
SPECIFIC = (
    r"(?i)\b[\w./-]+\.[a-z]{2,5}\b", r"\b[a-z]+[A-Z][A-Za-z0-9]+\b", r"\b[A-Z][a-z]+[A-Z][A-Za-z0-9]+\b", r"\b[a-z][a-z0-9]*_[a-z0-9_]+\b",
    r"\b[A-Za-z_][\w]*\s*\(", "[\"`'][^\"`']{2,}[\"`']",
)
TECHNICAL = (
    "function", "class", "interface", "type", "method", "module", "import", "export", "async", "await", "promise", "callback", "middleware", "handler", "service", "config", "schema", "migration", "query", "endpoint",
    "route", "controller", "repository", "factory", "provider", "adapter", "decorator", "hook", "store", "reducer", "selector", "component", "plugin",
)
GATES = {"specific": 0.55, "focused": 0.4, "broad": 0.25}


def query_class(query: Column) -> Column:
    text = F.trim(query)
    ws = F.split(F.lower(text), r"\s+")
    technical = F.size(F.array_intersect(ws, F.array(*[F.lit(w) for w in TECHNICAL]))) > 0
    return F.when(F.coalesce(text, F.lit("")) == "", "broad").when(any_match(text, SPECIFIC), "specific").when(technical & (F.size(ws) <= 8), "focused").otherwise("broad")


def class_gate(hits: DataFrame, query: Column, raw: str = "vector_score") -> DataFrame:
    """Drops hits whose raw score is below the gate of the query's class; those without a raw score stay."""
    kind = query_class(query)
    least = F.when(kind == "specific", GATES["specific"]).when(kind == "focused", GATES["focused"]).otherwise(GATES["broad"])
    return hits.where(F.col(raw).isNull() | (F.col(raw) >= least))


# Patterns of each intent, in the order in which they are tried, and factors by type.
INTENTS: dict[str, tuple[str, ...]] = {
    "pattern": (r"(?i)\bpattern\b", r"(?i)\bpadr(?:ã|a)o\b", r"(?i)\bidiom(?:atic)?\b", r"(?i)\bconvention\b", r"(?i)\bbest\s+practice", r"(?i)\bhow\s+(?:do|should)\s+(?:we|you)\s+(?:usually|typically|normally)"),
    "decision": (r"(?i)\bwhy\s+(?:did|do|are|is|we|they|the)\b", r"(?i)\bpor\s+que\s+(?:decid|escolh|usa)", r"(?i)\bdecision\b", r"(?i)\bdecid(?:ed|ing|imos|iu)\b", r"(?i)\brationale\b", r"(?i)\btrade[- ]?off", r"(?i)\bchose\b"),
    "symbol": (r"(?i)\bdefinition\s+of\b", r"(?i)\bsignature\s+of\b", r"(?i)\bo\s+que\s+(?:é|faz)\b", r"(?i)\bcomo\s+funciona\b", r"\bwhat\s+is\s+(?:the\s+)?[A-Z][A-Za-z0-9_]+\b"),
    "debug": (
        r"(?i)\b(?:error|exception|stack\s*trace|crash|panic|throw)", r"(?i)\b(?:erro|exce(?:ç|c)ão|falha)\b", r"(?i)\bhow\s+(?:do|can|to)\s+(?:i\s+|we\s+)?(?:fix|solve|resolve|debug)",
        r"(?i)\bcomo\s+(?:resolv|consert|corrig)", r"(?i)\b(?:fix|debug)\s+(?:the|this|that)\b", r"(?i)\bbroken\b", r"(?i)\bECONN(?:REFUSED|RESET|ABORTED|TIMEDOUT)\b", r"(?i)\bENO(?:ENT|TFOUND|MEM|TDIR)\b",
        r"(?i)\bcannot\s+connect\b", r"(?i)\bnão\s+(?:consegue|consigo)\s+conectar",
    ),
}
BOOSTS: dict[str, dict[str, float]] = {
    "decision": {"decision": 2.0, "critical": 1.5, "conversation": 0.6, "documentation": 1.2},
    "debug": {"conversation": 1.8, "code": 1.4, "code-test": 1.5, "documentation": 1.6, "decision": 0.6, "pattern": 0.7},
    "pattern": {"pattern": 2.0, "code": 1.3, "code-test": 1.4, "documentation": 1.1, "decision": 0.8},
    "symbol": {"code": 2.0, "pattern": 1.2, "code-test": 0.8},
}


def intent(query: Column) -> Column:
    out = F.lit("general")
    for name, patterns in reversed(INTENTS.items()):
        out = F.when(any_match(query, patterns), name).otherwise(out)
    return out


def intent_boost(hits: DataFrame, query: Column, kind: Column) -> DataFrame:
    """Scores times the factor of the query's intent for the hit's type."""
    what, factor = intent(query), F.lit(1.0)
    for name, by_type in BOOSTS.items():
        for t, x in by_type.items():
            factor = F.when((what == name) & (kind == t), x).otherwise(factor)
    return hits.withColumn("score", F.round(F.greatest(F.lit(0.0), F.col("score") * factor), 6))


# Types by path.
PATH_TYPES = (
    (r"(?i)(?:^|/)(?:__tests__|tests?|spec)/", "code-test"), (r"(?i)\.(?:test|spec)\.(?:ts|tsx|js|jsx|py|go|rs|java|dart)$", "code-test"),
    (r"(?i)(?:^|/)(?:docs?|documentation)/", "documentation"), (r"(?i)\.(?:md|mdx|rst|txt)$", "documentation"), (r"(?i)(?:^|/)README(?:\.|$)", "documentation"),
    (r"(?i)(?:^|/)CHANGELOG(?:\.|$)", "documentation"), (r"(?i)(?:^|/)migrations/", "code"),
    (r"(?i)\.(?:ts|tsx|js|jsx|py|go|rs|java|cpp|c|h|hpp|cs|rb|kt|swift|dart|scala|php|lua|sh|sql)$", "code"),
)


def type_of_path(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for pattern, name in reversed(PATH_TYPES):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def ramp(value: Column, threshold: float, boost: float) -> Column:
    """0 below half the threshold, up to ``boost`` at it, and half as much again at twice."""
    r = value / threshold
    return F.when(r < 0.5, 0.0).when(r <= 1, boost * (r - 0.5) * 2).otherwise(boost * (1 + 0.5 * F.least(r - 1, F.lit(1.0))))


def strengthened(stats: DataFrame) -> DataFrame:
    """``id, delta, new_importance`` of the memories whose use raises their importance.

    Reads ``importance, recent_access_count, edge_count, referenced_by_decision``.
    """
    delta = ramp(F.col("recent_access_count"), 3, 0.05) + ramp(F.col("edge_count"), 3, 0.03) + F.when(F.col("referenced_by_decision"), 0.08).otherwise(0.0)
    raised = F.least(F.lit(1.0), F.col("importance") + F.least(delta, F.lit(0.1)))
    out = stats.where(delta > 0).withColumn("new_importance", raised).where("new_importance > importance")
    return out.select("id", F.round(F.col("new_importance") - F.col("importance"), 6).alias("delta"), F.round("new_importance", 6).alias("new_importance"))


def working_set(hits: DataFrame, budget: int, schema: str = "query_id long, id long, file string, tokens long, pass int, used long") -> DataFrame:
    """A greedy choice under a token budget: the best hit of each file first, then the rest; what does not fit is passed over.

    Each query's hits are one group; they should be a bounded list, as search results are.
    """

    def pick(group):
        group = group.sort_values(["score", "id"], ascending=[False, True])
        first = ~group["file"].duplicated()
        used, out = 0, []
        for n, part in ((1, group[first]), (2, group[~first])):
            for r in part.itertuples():
                if used + r.tokens <= budget:
                    used += r.tokens
                    out.append((r.query_id, r.id, r.file, r.tokens, n, used))
        import pandas as pd

        return pd.DataFrame(out, columns=["query_id", "id", "file", "tokens", "pass", "used"])

    return hits.select("query_id", "id", "file", "score", F.col("tokens").cast("long").alias("tokens")).groupBy("query_id").applyInPandas(pick, schema)
