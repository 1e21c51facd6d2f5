"""Event logs: validation, categories, deduplication over time, rates, snapshots and recurring patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ranking import jaccard, tokens

#: Words that a signature drops.
STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "to", "of", "in", "on", "for", "and", "or", "how", "do", "i", "what", "why", "when", "where", "with", "this", "that",
    "it", "my", "me", "please", "can", "you", "into", "from", "at", "as", "by", "if", "so",
)
MIN_QUERIES, MIN_FILES, MIN_FIXES = 3, 3, 2


def validated(events: DataFrame, kinds: list[str], max_payload: int = 65_536) -> DataFrame:
    """Events with ``valid`` and ``reject_code``: the first test that fails."""
    code = (
        F.when(F.col("event_type").isNull() | ~F.col("event_type").isin(kinds), "unknown_type")
        .when(F.col("user_id").isNull(), "no_session").when(F.col("ts").isNull(), "no_time")
        .when(F.octet_length(F.coalesce("props", F.lit(""))) > max_payload, "too_large").when(F.try_parse_json("props").isNull(), "bad_payload")
    )
    return events.withColumn("reject_code", code).withColumn("valid", F.col("reject_code").isNull())


def signature(text: Column) -> Column:
    """The three longest words that are no stop words, sorted; ties of length by place.  A text without such words is cut to 60 characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    ws = F.filter(F.split(F.regexp_replace(low, r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS))
    keyed = F.transform(ws, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    top = F.slice(F.array_sort(keyed), 1, 3)
    whole = F.substring(F.trim(F.regexp_replace(low, r"\s+", " ")), 1, 60)
    return F.when(F.size(ws) == 0, whole).otherwise(F.array_join(F.array_sort(F.transform(top, lambda s: s["w"])), " "))


def path_bucket(path: Column) -> Column:
    """The folder of a path; ``root`` for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("root")


def patterns(queries: DataFrame, files: DataFrame, fixes: DataFrame) -> DataFrame:
    """``signal, n`` of what recurs: query texts, file paths, and tools in folders (``tool, path``)."""
    q = queries.select(F.concat(F.lit("query::"), signature(F.col("text"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_QUERIES)
    f = files.select(F.concat(F.lit("file::"), F.trim(F.regexp_replace("path", r"^(\./+)+", ""))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_FILES)
    x = fixes.select(F.concat(F.lit("fix::"), "tool", F.lit(":"), path_bucket(F.col("path"))).alias("signal")).groupBy("signal").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_FIXES)
    return q.unionByName(f).unionByName(x)


def ttl_dedup(events: DataFrame, key: str, ttl_seconds: int = 60) -> DataFrame:
    """``key, event_id``: the first event of each key, and each that comes ``ttl_seconds`` or more after the last one kept.

    What is kept depends on what was kept before, so a key's events are walked in order; they are
    streamed in batches, with the time last kept as the only state.
    """

    def walk(batches):
        last: dict = {}
        for b in batches:
            keep = []
            for k, us in zip(b[key], b["us"], strict=True):
                ok = k not in last or us - last[k] >= ttl_seconds * 1_000_000
                if ok:
                    last = {k: us}
                keep.append(ok)
            yield b.loc[keep, [key, "event_id"]]

    rows = events.select(F.col(key).cast("string").alias(key), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where(F.col(key).isNotNull() & F.col("us").isNotNull())
    return rows.repartition(key).sortWithinPartitions(key, "us", "event_id").mapInPandas(walk, f"{key} string, event_id long")


def rate_limited(events: DataFrame, key: str, per_window: int, seconds: int = 60) -> DataFrame:
    """Events with ``recent``, those of the key in the window that ends with it, and whether it is ``allowed``."""
    w = Window.partitionBy(key).orderBy("us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    rows = events.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("recent", F.count("*").over(w))
    return rows.withColumn("allowed", F.col("recent") <= per_window).drop("us")


def recent(events: DataFrame, key: str, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return events.withColumn("nth", nth).where(F.col("nth") <= n)


def snapshot(events: DataFrame, most: int = 200, per_section: int = 5, max_bytes: int = 2048, line: int = 120) -> DataFrame:
    """``session, events, sections, snapshot``: a table of contents of each session's last ``most`` events ``session, id, ts, category, token``.

    Sections are categories, the most active first and then by name, each with its count and the tokens of its newest events; sections are
    dropped from the end until the text has ``max_bytes`` bytes at most, but for the first.
    """
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ts").desc(), F.col("id").desc()))
    last = events.withColumn("n", nth("session")).where(F.col("n") <= most).withColumn("k", nth("session", "category"))
    token = F.coalesce("token", F.concat(F.lit("["), F.col("id").cast("string"), F.lit("]")))
    short = F.when(F.length(token) > line, F.concat(F.substring(token, 1, line), F.lit("…"))).otherwise(token)
    found = last.groupBy("session", "category").agg(F.count("*").alias("count"), F.sort_array(F.collect_list(F.when(F.col("k") <= per_section, F.struct("k", short.alias("t"))))).alias("ts"))
    tokens = F.filter(F.transform("ts", lambda x: x["t"]), lambda x: x != "")
    body = F.concat(
        F.lit("  <"), "category", F.lit(' count="'), F.col("count").cast("string"), F.lit('">\n    '), F.col("count").cast("string"), F.lit(" event(s)"),
        F.array_join(F.transform(tokens, lambda x: F.concat(F.lit("\n      - "), escaped(x))), ""), F.lit("\n  </"), "category", F.lit(">"),
    )
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.col("count").desc(), "category"))
    rows = found.select("session", "count", "category", body.alias("body")).withColumn("place", place)
    head = lambda n: F.concat(F.lit('<session_resume events="'), n.cast("string"), F.lit('" session_id="'), F.col("session").cast("string"), F.lit('">'))
    foot = "</session_resume>"
    total = F.sum("count").over(Window.partitionBy("session"))
    upto = F.sum(F.octet_length("body") + 1).over(Window.partitionBy("session").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    fits = rows.withColumn("events", total).withColumn("size", upto + F.octet_length(head(F.col("events"))) + len(foot) + 1).where((F.col("size") <= max_bytes) | (F.col("place") == 1))
    whole = fits.groupBy("session", "events").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("bs"))
    return whole.select("session", "events", F.size("bs").alias("sections"), F.concat(head(F.col("events")), F.lit("\n"), F.array_join("bs.body", "\n"), F.lit(f"\n{foot}")).alias("snapshot"))


def escaped(text: Column) -> Column:
    """Text for XML."""
    for char, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "apos")):
        text = F.replace(text, F.lit(char), F.lit(f"&{name};"))
    return text


def stale_runs(runs: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Runs that are marked running and whose heartbeat is too old."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("heartbeat").cast("timestamp"))) / 1e6
    return runs.where((F.col("status") == "running") & (age > seconds))


def due_jobs(jobs: DataFrame, now: Column, tick_seconds: int = 60) -> DataFrame:
    """Enabled jobs ``id, kind, next_run, interval`` (seconds) with ``state``: waiting, due, or missed by more than a tick, and ``then``, when they run next.

    A missed job gets one run to catch up, whatever it has missed.
    """
    late = (F.unix_micros(now) - F.unix_micros(F.col("next_run").cast("timestamp"))) / 1e6
    state = F.when(late < 0, "waiting").when(late > tick_seconds, "missed").otherwise("due")
    after = F.timestamp_micros(F.unix_micros(now) + F.col("interval") * 1_000_000)
    return jobs.where("enabled").withColumn("state", state).withColumn("then", F.when(late < 0, F.col("next_run").cast("timestamp")).otherwise(after))


def failures(runs: DataFrame) -> DataFrame:
    """``kind, runs, failed, in_a_row``: of ``runs(kind, at, ok)``, all, those that failed, and those that failed since the last that did not."""
    last = F.max(F.when(F.col("ok"), F.col("at"))).over(Window.partitionBy("kind"))
    rows = runs.withColumn("last", last)
    return rows.groupBy("kind").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.col("ok") & (F.col("last").isNull() | (F.col("at") > F.col("last")))).alias("in_a_row"))


def consolidation_due(state: DataFrame, least_new: int, least_seconds: int) -> DataFrame:
    """Projects of ``new_events, idle_seconds`` for which a throttled consolidation is due."""
    return state.where((F.col("new_events") >= least_new) & (F.col("idle_seconds") >= least_seconds))


def sessions(log: DataFrame, ttl_seconds: int, history: int = 100) -> DataFrame:
    """``session, run, created_at, expires_at, accesses, recent``: runs of a session, which every access keeps alive for another ``ttl_seconds``.

    Reads ``session, id, at`` with ``at`` in seconds.  ``recent`` holds the ids accessed last in a run, newest first, at most
    ``history``, with their numbers of accesses.
    """
    by = Window.partitionBy("session").orderBy("at", "id")
    gap = F.col("at") - F.lag("at").over(by)
    runs = log.withColumn("run", F.sum(F.when(gap.isNull() | (gap >= ttl_seconds), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ids = runs.groupBy("session", "run", "id").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    nth = F.row_number().over(Window.partitionBy("session", "run").orderBy(F.col("last").desc(), F.col("id").desc()))
    kept = F.when(F.col("nth") <= history, F.struct("nth", "id", "n"))
    whole = ids.withColumn("nth", nth).groupBy("session", "run").agg(F.min("first").alias("created_at"), F.max("last").alias("last"), F.sum("n").alias("accesses"), F.sort_array(F.collect_list(kept)).alias("k"))
    return whole.select("session", "run", "created_at", (F.col("last") + ttl_seconds).alias("expires_at"), "accesses", F.transform("k", lambda x: F.struct(x["id"].alias("id"), x["n"].alias("n"))).alias("recent"))


def buffer_hits(entries: DataFrame, queries: DataFrame, least: float = 0.4, boost: float = 1.3, ttl_seconds: int = 900) -> DataFrame:
    """``session, query_id, id, score``: entries of a session's buffer that fit a query, with their first score boosted, at most 1.

    ``entries(session, id, query, content, baseline, at)``; an entry without a query is matched by its content.  ``queries(session, query_id, query, at)``.
    What was used ``ttl_seconds`` or longer before is gone.
    """
    asked = queries.select("session", "query_id", tokens(F.col("query")).alias("q"), F.col("at").alias("now"))
    own = tokens(F.when(F.coalesce("query", F.lit("")) == "", F.col("content")).otherwise(F.col("query")))
    met = entries.select("session", "id", own.alias("own"), "baseline", "at").join(asked, "session").where((F.col("now") - F.col("at") < ttl_seconds) & (F.col("at") <= F.col("now")))
    return met.where(jaccard(F.col("q"), F.col("own")) >= least).select("session", "query_id", "id", F.round(F.least(F.lit(1.0), F.col("baseline") * boost), 6).alias("score"))


def working_memory(hits: DataFrame, size: int = 20, ttl_seconds: int = 900) -> DataFrame:
    """Each session's buffer after its puts: what is younger than the TTL at the session's last put, and of that the ``size`` with the highest baselines.

    Reads ``session, id, at, score``; a later put of an id replaces the earlier one.
    """
    last = F.max("at").over(Window.partitionBy("session"))
    newest = F.row_number().over(Window.partitionBy("session", "id").orderBy(F.col("at").desc(), F.col("score").desc()))
    alive = hits.withColumn("end", last).withColumn("n", newest).where(f"n = 1 and at > end - {ttl_seconds}")
    nth = F.row_number().over(Window.partitionBy("session").orderBy(F.col("score").desc(), "id"))
    return alive.withColumn("place", nth).where(F.col("place") <= size).select("session", "id", "score", "place")
