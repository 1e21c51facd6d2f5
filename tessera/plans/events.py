"""Event log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import events
from tessera.plans.registry import Tables, query


@query("SELECT coalesce(CASE WHEN event_type NOT IN ('view', 'click', 'purchase') THEN 'unknown_type' WHEN user_id IS NULL THEN 'no_session' WHEN ts IS NULL THEN 'no_time' WHEN NOT json_valid(props) THEN 'bad_payload' END, 'ok') AS code, count(*) AS n FROM events GROUP BY 1")
def event_ingest(t: Tables) -> DataFrame:
    v = events.validated(t.events, ["view", "click", "purchase"])
    return v.groupBy(F.coalesce("reject_code", F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


_STOP = "(" + ", ".join(f"'{w}'" for w in events.STOP_WORDS) + ")"


@query(
    f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND x NOT IN {_STOP}) AS ws FROM conversations WHERE role = 'user'),
    u AS (SELECT conv_id, turn, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(word) DESC, i) AS n FROM u),
    s AS (SELECT conv_id, turn, string_agg(word, ' ' ORDER BY word) AS sig FROM r WHERE n <= 3 GROUP BY ALL),
    q AS (SELECT 'query::' || sig AS signal, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 3), f AS (SELECT 'file::' || url AS signal, count(*) AS n FROM pages GROUP BY 1 HAVING count(*) >= 3),
    x AS (SELECT 'fix::' || event_type || ':' || 'u' || (user_id % 5) || '/d' AS signal, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 2)
    SELECT * FROM q UNION ALL SELECT * FROM f UNION ALL SELECT * FROM x"""
)
def pattern_mining(t: Tables) -> DataFrame:
    fixes = t.events.select(F.col("event_type").alias("tool"), F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"), F.lit("/d/f"), F.col("event_id").cast("string")).alias("path"))
    return events.patterns(t.conversations.where("role = 'user'"), t.pages.select(F.col("url").alias("path")), fixes)


TTL_SQL = """WITH RECURSIVE o AS MATERIALIZED (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
    k AS (SELECT user_id, n, ts AS kept, event_id, true AS here FROM o WHERE n = 1 UNION ALL
      SELECT o.user_id, o.n, CASE WHEN o.ts - k.kept >= INTERVAL 3600 SECOND THEN o.ts ELSE k.kept END, o.event_id, o.ts - k.kept >= INTERVAL 3600 SECOND FROM k JOIN o ON o.user_id = k.user_id AND o.n = k.n + 1)
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_id FROM k WHERE here"""


@query(TTL_SQL)
def ttl_dedup(t: Tables) -> DataFrame:
    return events.ttl_dedup(t.events, "user_id", 3600)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '3599.999999' SECOND PRECEDING AND CURRENT ROW) AS recent FROM events")
def rate_limiter(t: Tables) -> DataFrame:
    return events.rate_limited(t.events, "user_id", 3, 3600).select("event_id", "recent")


@query("SELECT event_id, user_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 3")
def recent_by_session(t: Tables) -> DataFrame:
    return events.recent(t.events, "user_id", 3).select("event_id", "user_id", F.col("nth").cast("long").alias("nth"))


@query(
    """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 200),
    k AS (SELECT *, replace(CASE WHEN event_id % 4 = 0 THEN '[' || event_id || ']' ELSE props END, '"', '&quot;') AS token, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM l),
    s AS (SELECT user_id, event_type, count(*) AS c, '  <' || event_type || ' count="' || count(*) || '">' || chr(10) || '    ' || count(*) || ' event(s)' || string_agg(chr(10) || '      - ' || token, '' ORDER BY k) FILTER (WHERE k <= 5) || chr(10) || '  </' || event_type || '>' AS body FROM k GROUP BY user_id, event_type),
    p AS (SELECT *, row_number() OVER w AS place, sum(strlen(body) + 1) OVER w AS upto, sum(c) OVER (PARTITION BY user_id) AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY c DESC, event_type)),
    h AS (SELECT *, '<session_resume events="' || n || '" session_id="' || user_id || '">' AS head FROM p)
    SELECT user_id AS session, CAST(n AS BIGINT) AS events, count(*) AS sections, head || chr(10) || string_agg(body, chr(10) ORDER BY place) || chr(10) || '</session_resume>' AS snapshot FROM h
    WHERE upto + strlen(head) + 18 <= 600 OR place = 1 GROUP BY user_id, n, head"""
)
def compaction_snapshot(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("session"), F.col("event_id").alias("id"), "ts", F.col("event_type").alias("category"), F.when(F.col("event_id") % 4 != 0, F.col("props")).alias("token"))
    return events.snapshot(rows, max_bytes=600).withColumn("sections", F.col("sections").cast("long"))


@query(
    """WITH l AS (SELECT user_id AS session, event_id % 40 AS id, epoch_us(ts) // 1000000 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 86400 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY session ORDER BY t, id)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY session ORDER BY t, id ROWS UNBOUNDED PRECEDING) AS run FROM g), i AS (SELECT session, run, id, count(*) AS n, min(t) AS first, max(t) AS last FROM r GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY session, run ORDER BY last DESC, id DESC) AS nth FROM i)
    SELECT session, CAST(run AS BIGINT) AS run, min(first) AS created_at, max(last) + 86400 AS expires_at, CAST(sum(n) AS BIGINT) AS accesses, string_agg(id || ':' || n, ',' ORDER BY nth) FILTER (WHERE nth <= 5) AS recent FROM o GROUP BY session, run"""
)
def session_registry(t: Tables) -> DataFrame:
    log = t.events.select(F.col("user_id").alias("session"), (F.col("event_id") % 40).alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    out = events.sessions(log, 86_400, 5)
    shown = F.array_join(F.transform("recent", lambda x: F.concat_ws(":", x["id"].cast("string"), x["n"].cast("string"))), ",")
    return out.withColumn("recent", shown).withColumn("run", F.col("run").cast("long"))


@query(
    """WITH k AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')) AS k FROM conversations), q AS (SELECT conv_id, turn AS last, k AS q FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM k) WHERE n = 1),
    m AS (SELECT k.conv_id, turn, len(list_intersect(k, q)) AS i, len(k) AS a, len(q) AS b, last FROM k JOIN q ON k.conv_id = q.conv_id WHERE last - turn < 6)
    SELECT conv_id AS session, last AS query_id, turn AS id, round(least(1, (turn % 10) / 10.0::DOUBLE * 1.3), 6) AS score FROM m WHERE a > 0 AND b > 0 AND i / (a + b - i) >= 0.2"""
)
def buffer_hits(t: Tables) -> DataFrame:
    c = t.conversations.select(F.col("conv_id").alias("session"), "turn", "text")
    entries = c.select("session", F.col("turn").alias("id"), F.when(F.col("turn") % 2 == 0, F.col("text")).alias("query"), F.col("text").alias("content"), ((F.col("turn") % 10) / 10.0).alias("baseline"), F.col("turn").alias("at"))
    last = c.groupBy("session").agg(F.max("turn").alias("at"), F.max_by("text", "turn").alias("query"))
    return events.buffer_hits(entries, last.withColumn("query_id", F.col("at")), least=0.2, ttl_seconds=6)


@query("SELECT event_id FROM events WHERE event_type = 'view' AND epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) > 86400000000 * 10")
def stale_runs(t: Tables) -> DataFrame:
    runs = t.events.select("event_id", F.when(F.col("event_type") == "view", "running").otherwise("done").alias("status"), F.col("ts").alias("heartbeat"))
    return events.stale_runs(runs, F.lit("2024-01-31").cast("timestamp"), 864_000).select("event_id")


@query(
    """WITH p AS (SELECT user_id AS session, event_id % 50 AS id, epoch_us(ts) // 1000000 AS t, value AS score FROM events), e AS (SELECT *, max(t) OVER (PARTITION BY session) AS last, row_number() OVER (PARTITION BY session, id ORDER BY t DESC, score DESC) AS n FROM p),
    a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY score DESC, id) AS place FROM e WHERE n = 1 AND t > last - 864000) SELECT session, id, score, place FROM a WHERE place <= 20"""
)
def session_buffer(t: Tables) -> DataFrame:
    puts = t.events.select(F.col("user_id").alias("session"), (F.col("event_id") % 50).alias("id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at"), F.col("value").alias("score"))
    return events.working_memory(puts, 20, 864_000).withColumn("place", F.col("place").cast("long"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_rollup(t: Tables) -> DataFrame:
    ev = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = ev.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query(
    """WITH j AS (SELECT o_orderkey AS id, o_orderdate AS w, 3600 * (1 + o_orderkey % 5) AS i FROM orders WHERE o_orderstatus <> 'F'), l AS (SELECT *, epoch(TIMESTAMP '2001-06-01 00:00:30') - epoch(w) AS late FROM j)
    SELECT id, CASE WHEN late < 0 THEN 'waiting' WHEN late > 60 THEN 'missed' ELSE 'due' END AS state, CASE WHEN late < 0 THEN w ELSE TIMESTAMP '2001-06-01 00:00:30' + INTERVAL 1 SECOND * i END AS "then" FROM l"""
)
def scheduled_jobs(t: Tables) -> DataFrame:
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("next_run"), (3600 * (1 + F.col("o_orderkey") % 5)).alias("interval"), (F.col("o_orderstatus") != "F").alias("enabled"))
    return events.due_jobs(jobs, F.lit("2001-06-01 00:00:30").cast("timestamp")).select("id", "state", F.col("then").cast("timestamp_ntz").alias("then"))


@query(
    """WITH r AS (SELECT user_id AS kind, ts AS w, event_type NOT IN ('error', 'signup', 'view') AS ok FROM events), l AS (SELECT *, max(w) FILTER (WHERE ok) OVER (PARTITION BY kind) AS last FROM r)
    SELECT kind, count(*) AS runs, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE NOT ok AND (last IS NULL OR w > last)) AS in_a_row FROM l GROUP BY kind"""
)
def job_failures(t: Tables) -> DataFrame:
    return events.failures(t.events.select(F.col("user_id").alias("kind"), F.col("ts").alias("at"), (~F.col("event_type").isin("error", "signup", "view")).alias("ok")))
