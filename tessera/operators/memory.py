"""Decay, ranking, merging and levels of memories.

A memory has ``id, importance, access_count, created_at, last_accessed, pinned``; the current time is an argument.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import clamp01, cosine
from tessera.session import cut, discard, stored

SALIENCE_RATE, ACCESS_WEIGHT, ACCESS_RATE, COLD = 0.02, 0.6, 0.04, 0.2
PERSISTENT, PROJECT, USER, SESSION = 0, 1, 2, 3
TYPE_BOOST = {"decision": 1.0, "pattern": 0.9, "critical": 0.85, "code": 0.8}


def days_since(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(then)) / 86_400_000_000.0)


def decay(now: Column) -> Column:
    """Importance and use, each fading at its own rate since the last access; pinned memories keep their importance."""
    days = days_since(now, F.coalesce("last_accessed", "created_at"))
    salience = F.coalesce(F.nanvl("importance", F.lit(0.0)), F.lit(0.0))
    uses = F.greatest(F.lit(0), F.coalesce("access_count", F.lit(0)))
    faded = salience * F.exp(-SALIENCE_RATE * days) + ACCESS_WEIGHT * F.log1p(uses) * F.exp(-ACCESS_RATE * days)
    return F.when(F.coalesce("pinned", F.lit(False)), clamp01(salience)).otherwise(clamp01(faded))


def decayed(memories: DataFrame, now: Column, idle_days: int = 7) -> DataFrame:
    """``id, importance, decayed`` of the memories whose importance changes, of those that are older than ``idle_days``."""
    stale = days_since(now, F.coalesce("last_accessed", "created_at")) > idle_days
    rows = memories.where(stale & ~F.coalesce("pinned", F.lit(False))).withColumn("decayed", decay(now))
    return rows.where(F.abs(F.col("decayed") - F.col("importance")) >= 1e-6).select("id", F.round("importance", 6).alias("importance"), F.round("decayed", 6).alias("decayed"))


def cold(memories: DataFrame, now: Column, min_days: int = 45, uses: int = 2) -> DataFrame:
    """Memories that may go: old, faded, hardly used and not pinned."""
    old = days_since(now, F.col("created_at")) > min_days
    return memories.where(old & ~F.coalesce("pinned", F.lit(False)) & (decay(now) < COLD) & (F.coalesce("access_count", F.lit(0)) < uses))


def promoted(memories: DataFrame, now: Column, uses: int = 3, step: float = 0.08, least: float = 0.7, limit: int = 120) -> DataFrame:
    """Session memories that matter, are used, older than a day and not deleted, raised to the user's level with more importance; the oldest ``limit``."""
    kinds = F.col("type").isin("conversation", "decision", "pattern")
    due = (F.col("level") == SESSION) & kinds & (days_since(now, F.col("created_at")) > 1) & (F.col("importance") >= least) & (F.col("access_count") >= uses) & F.col("deleted_at").isNull()
    return memories.where(due).orderBy("created_at", "id").limit(limit).select("id", F.lit(USER).cast("long").alias("level"), F.round(F.least(F.lit(1.0), F.col("importance") + step), 6).alias("importance"))


def type_boost(kind: Column) -> Column:
    out = F.lit(0.7)
    for name, x in TYPE_BOOST.items():
        out = F.when(kind == name, x).otherwise(out)
    return out


def ranked(memories: DataFrame, similarity: Column, now: Column, limit: int) -> DataFrame:
    """0.65 of the similarity (0.5 where it is null), 0.2 of decay, 0.1 of use and 0.05 of the type."""
    used = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0), F.coalesce("access_count", F.lit(0)))) / math.log(20)))
    score = 0.65 * F.coalesce(similarity, F.lit(0.5)) + 0.2 * decay(now) + 0.1 * used + 0.05 * type_boost(F.col("type"))
    return memories.select("id", F.round(score, 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def level(kind: Column, user: Column, session: Column, project: Column, agent: Column) -> Column:
    """Levels: what an agent decides of its own kind first, then the narrowest scope that is named, then the type."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return (
        F.when((agent == "orchestrator") & kind.isin("decision", "critical"), PERSISTENT)
        .when((agent == "architect") & kind.isin("pattern", "code", "critical"), PROJECT)
        .when((agent == "optimizer") & (kind == "critical"), USER)
        .when(has(project), PROJECT).when(has(user) & ~has(session), USER).when(has(session), SESSION)
        .when(kind == "critical", USER).when(kind.isin("code", "pattern"), PROJECT).when(kind == "decision", PERSISTENT).otherwise(SESSION)
    )


def salience(memories: DataFrame, verdicts: DataFrame | None = None, neutral: float = 0.5) -> DataFrame:
    """Memories with a judge's ``salience``, within 0 and 1; neutral where there is no verdict.  ``verdicts(id, salience)``."""
    if verdicts is None:
        return memories.withColumn("salience", F.lit(neutral))
    own = verdicts.groupBy(F.col("id").alias("_i")).agg(F.max("salience").alias("_s"))
    return memories.join(own, F.col("id") == F.col("_i"), "left").withColumn("salience", F.when(F.col("_s").isNull() | F.isnan("_s"), neutral).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_s"))))).drop("_i", "_s")


def keep_rule(pairs: DataFrame, memories: DataFrame) -> DataFrame:
    """``block, keep_id, remove_id, score``: of each pair ``block, a, b, score`` in order of ``a`` and ``b``, the less important goes, or else the less used;
    a memory that is gone takes no further part.

    A memory goes in the first pair that it would lose and whose other memory is still there. Each round narrows that pair down for all memories at once: it is
    not before the first that may still count, and not after the first that does for sure. What is settled early settles others, so the rounds are few unless the
    outcome is one long chain; it is that of one walk in order, and no block is gathered.
    """
    m = memories.select("id", "importance", F.col("access_count").cast("long").alias("uses"))
    left = m.select(F.col("id").alias("a"), F.col("importance").alias("ia"), F.col("uses").alias("ca"))
    right = m.select(F.col("id").alias("b"), F.col("importance").alias("ib"), F.col("uses").alias("cb"))
    first = F.coalesce(F.when(F.col("ia") != F.col("ib"), F.col("ia") > F.col("ib")).otherwise(F.col("ca") >= F.col("cb")), F.lit(False))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    whole = stored(pairs.join(left, "a").join(right, "b").select("block", "a", "b", "score", pick("a", "b").alias("keep_id"), pick("b", "a").alias("remove_id")), "keep-pairs")
    # each memory's pairs that it may go in, and the bounds of the pair that it goes in; no upper bound: it may stay
    open_ = stored(whole.select("block", F.col("remove_id").alias("id"), F.col("keep_id").alias("by"), F.struct("a", "b").alias("p")), "keep-open")
    bounds = stored(open_.groupBy("block", "id").agg(F.min("p").alias("lo")).select("block", "id", "lo", F.lit(None).cast(open_.schema["p"].dataType).alias("hi")), "keep-bounds")
    while not open_.isEmpty():
        other = bounds.select("block", F.col("id").alias("by"), F.lit(True).alias("_known"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        there = F.col("_known").isNull() | F.coalesce(F.col("_lo") >= F.col("p"), F.lit(True))
        maybe = open_.join(other, ["block", "by"], "left").where(F.col("_known").isNull() | F.col("_hi").isNull() | (F.col("_hi") >= F.col("p")))
        met = stored(maybe.select("block", "id", "by", "p", there.alias("sure")), "keep-met")
        found = met.groupBy("block", "id").agg(F.min("p").alias("_l"), F.min(F.when(F.col("sure"), F.col("p"))).alias("_h"))
        asked = open_.select("block", "id").distinct().withColumn("_asked", F.lit(True))
        new = bounds.join(asked, ["block", "id"], "left").join(found, ["block", "id"], "left")
        new = stored(new.select("block", "id", *[F.when(F.col("_asked"), F.col(f"_{c[0]}")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi")]), "keep-bounds")
        wide = new.where("lo is not null and not (lo <=> hi)").select("block", "id", "hi")
        rest = stored(met.join(wide, ["block", "id"]).where(F.col("hi").isNull() | (F.col("p") <= F.col("hi"))).select("block", "id", "by", "p"), "keep-open")
        for t in (open_, bounds, met):
            discard(t)
        open_, bounds = rest, new
    gone = bounds.where("hi is not null").select("block", F.col("hi.a").alias("a"), F.col("hi.b").alias("b"))
    return whole.join(gone, ["block", "a", "b"], "left_semi").select("block", "keep_id", "remove_id", "score")


def merged(memories: DataFrame, merges: DataFrame) -> DataFrame:
    """``id, importance, access_count`` after merging: the kept ones with the largest importance and all uses; the removed ones are gone."""
    m = merges.select(F.col("remove_id").alias("_r"), F.col("keep_id").alias("_k"))
    at = memories.join(m, F.col("id") == F.col("_r"), "left").select(F.coalesce("_k", "id").alias("to"), F.col("_r").isNull().alias("stays"), "importance", "access_count")
    whole = at.groupBy("to").agg(F.max("importance").alias("importance"), F.sum("access_count").alias("access_count"), F.max("stays").alias("stays"))
    return whole.where("stays").select(F.col("to").alias("id"), "importance", "access_count")


def merge_map(edges: DataFrame, merges: DataFrame) -> DataFrame:
    """Edges re-pointed from removed memories to the ones kept, without loops, the largest weight for each."""
    m = merges.select(F.col("remove_id").alias("_r"), F.col("keep_id").alias("_k"))
    out = edges.join(m, edges["from_id"] == m["_r"], "left").withColumn("from_id", F.coalesce("_k", "from_id")).drop("_r", "_k")
    out = out.join(m, out["to_id"] == m["_r"], "left").withColumn("to_id", F.coalesce("_k", "to_id")).drop("_r", "_k")
    return out.where("from_id <> to_id").groupBy("from_id", "to_id", "edge_type").agg(F.max("weight").alias("weight"))


def consolidation_window(memories: DataFrame, threshold: float = 0.65, most: int = 8) -> DataFrame:
    """``project, id, place``: of each project, its newest memory with a vector, and newer ones first those that are similar to all taken so far.

    Reads ``project, id, embedding, created_at``.  Each round takes one memory a project and keeps those similar to it, so
    no project is gathered; null projects are one.  A window has two memories at least.
    """
    order = F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("age"), F.col("id").alias("i"))
    rest = cut(memories.where(F.size("embedding") > 0).select(F.coalesce(F.col("project").cast("string"), F.lit("")).alias("p"), "project", "id", "embedding", order.alias("o")))
    chosen = rest.where("false").select("p", "project", "id", F.lit(0).alias("place"))
    for place in range(most):
        top = cut(rest.groupBy("p").agg(F.min_by(F.struct("project", "id", "embedding", "o"), "o").alias("t")).select("p", "t.*"))
        if top.isEmpty():
            break
        chosen = chosen.unionByName(top.select("p", "project", "id", F.lit(place).alias("place")))
        taken = top.select(F.col("p").alias("_p"), F.col("embedding").alias("_v"), F.col("o").alias("_o"))
        rest = cut(rest.join(taken, F.col("p") == F.col("_p")).where((F.col("o") > F.col("_o")) & (cosine(F.col("embedding"), F.col("_v")) >= threshold)).select(*rest.columns))
    sizes = chosen.groupBy(F.col("p").alias("_p")).agg(F.count("*").alias("n")).where("n > 1")
    return chosen.join(sizes, F.col("p") == F.col("_p"), "left_semi").select("project", "id", F.col("place").cast("long").alias("place"))


def largest_window(windows: DataFrame) -> DataFrame:
    """The largest of the projects' windows, ties to the first project."""
    best = windows.groupBy("project").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "project").limit(1).select(F.col("project").alias("_p"))
    return windows.join(F.broadcast(best), F.col("project").eqNullSafe(F.col("_p")), "left_semi")  # one row


def clusters(memories: DataFrame, seed: int = 42) -> DataFrame:
    """``id, cluster``: k-means with ``k`` near the root of half the memories, from 2 to 20."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = memories.count()
    k = int(min(20, max(2, round(math.sqrt(n / 2)))))
    rows = memories.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    if n < k:
        return rows.select("id", F.lit(0).alias("cluster"))
    return KMeans(k=k, seed=seed, maxIter=20).fit(rows).transform(rows).select("id", F.col("prediction").alias("cluster"))


def cluster_labels(members: DataFrame, terms: int = 3) -> DataFrame:
    """``cluster, label``: the words that most texts of a cluster have, ties by word.  ``members(id, cluster, text)``."""
    ws = members.select("id", "cluster", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z0-9_]{4,})"), 1))).alias("word"))
    counted = ws.groupBy("cluster", "word").agg(F.count("*").alias("df"))
    nth = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("df").desc(), "word"))
    top = counted.withColumn("n", nth).where(F.col("n") <= terms).groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ws"))
    return top.select("cluster", F.array_join("ws.word", " / ").alias("label"))


# What tells that a memory speaks against an earlier one, settles it, goes on from it, or bears it out.
CONTRADICTS = (
    "instead of", "no longer", "don't use", "deprecated", "replaced by", "wrong approach", "should not", "avoid", "changed from", "was incorrect",
    "não usar", "substituir", "evitar", "incorreto",
)
RESOLVES = ("fixed", "resolved", "solved", "workaround", "fix for", "solution", "corrected", "patched", "resolvido", "corrigido", "solução")
DERIVES = ("based on", "derived from", "building on", "extending", "following up", "as discussed", "per decision", "baseado em", "derivado de", "conforme")
SUPPORTS = ("confirms", "supports", "validates", "consistent with", "aligns with", "evidence for", "proves", "confirma", "valida", "consistente")


def _says(text: Column, signals: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.contains(low, F.lit(signals[0]))
    for x in signals[1:]:
        out = out | F.contains(low, F.lit(x))
    return out


def signals(text: Column) -> Column:
    """What a text says of earlier memories, four booleans: a memory's are the same in all its pairs, so texts need not go with pairs."""
    named = (("contradicts", CONTRADICTS), ("resolves", RESOLVES), ("derives", DERIVES), ("supports", SUPPORTS))
    return F.struct(*[_says(text, words).alias(name) for name, words in named])


def relation(pairs: DataFrame) -> DataFrame:
    """``relation, confidence`` for pairs of a newer and an older memory: the first rule that holds; pairs without a relation go.

    Reads ``similarity, new_type, old_type, newer`` (whether the new one was made later), ``shared_tags``, and ``says``, the :func:`signals` of the new
    one's text, or else ``new_text``.
    """
    s, new, old = F.col("similarity"), F.col("new_type"), F.col("old_type")
    says = F.col("says") if "says" in pairs.columns else signals(F.col("new_text"))
    same = new == old
    rules = [
        ("SUPERSEDES", same & (s >= 0.92) & F.col("newer"), F.least(F.lit(0.95), s)),
        ("CONTRADICTS", says["contradicts"] & ((s >= 0.5) | F.col("shared_tags")), 0.7 + s * 0.2),
        ("RESOLVES", says["resolves"] & old.isin("decision", "pattern"), 0.65 + s * 0.25),
        ("DERIVED_FROM", says["derives"], 0.6 + s * 0.3),
        ("DERIVED_FROM", (((new == "code") & (old == "decision")) | ((new == "pattern") & (old == "code"))) & (s >= 0.7), 0.55 + s * 0.3),
        ("SUPPORTS", says["supports"], 0.6 + s * 0.3),
        ("SUPPORTS", same & (s >= 0.8) & new.isin("pattern", "decision"), 0.5 + s * 0.3),
        ("RELATES_TO", s >= 0.75, s * 0.8),
    ]
    name, sure = F.lit(None).cast("string"), F.lit(None).cast("double")
    for rule, test, confidence in reversed(rules):
        name, sure = F.when(test, rule).otherwise(name), F.when(test, confidence).otherwise(sure)
    return pairs.withColumn("relation", name).withColumn("confidence", sure).where("relation is not null")
