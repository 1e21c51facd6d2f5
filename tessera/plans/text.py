"""Queries on single texts: chunks, estimates, hashes and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.plans.registry import Tables, query
from tessera.session import spread


@query(
    """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), s AS (SELECT doc_id, ls, unnest(range(0, len(ls), 50)) AS s FROM l)
    SELECT doc_id, s + 1 AS line_start, least(s + 50, len(ls)) AS line_end, array_to_string(ls[s + 1 : s + 50], chr(10)) AS content FROM s"""
)
def fixed_chunks(t: Tables) -> DataFrame:
    return text.fixed_chunks(t.documents, "doc_id", "text")


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    n AS (SELECT *, lower(trim(line)) AS norm, row_number() OVER (PARTITION BY doc_id, lower(trim(line)) ORDER BY pos) AS k FROM l)
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS content FROM n WHERE norm = '' OR k = 1 GROUP BY doc_id"""
)
def line_dedup(t: Tables) -> DataFrame:
    return text.line_dedup(t.documents, "doc_id", "text")


@query("SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 5) AS BIGINT) AS prose, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS code FROM documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.token_estimate(F.col("text")).alias("prose"), text.token_estimate(F.col("text"), True).alias("code"))


@query("SELECT page_id, list_last(string_split(url, '/')) AS base, array_to_string(string_split(url, '/')[1:3], '/') AS prefix FROM pages")
def path_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.basename(F.col("url")).alias("base"), text.path_prefix(F.col("url"), 3).alias("prefix"))


@query()
def markdown_chunks(t: Tables) -> DataFrame:
    md = t.pages.select("page_id", F.lit("page.md").alias("path"), text.markdown_column("html").alias("md"))
    return text.smart_chunks(md, "page_id", "path", "md")


@query()
def html_to_markdown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.markdown_column("html").alias("markdown"))


@query("SELECT event_id, 'k' AS path, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_keypaths(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.explode(text.json_paths_column("props")).alias("p")).select("event_id", "p.path", "p.value")


@query("SELECT p_partkey, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h::UBIGINT, c::UBIGINT)::HUGEINT * 16777619) % 4294967296)::BIGINT AS hash FROM part")
def fnv1a_hash(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.fnv1a(F.col("p_name")).alias("hash"))


@query("SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS hash FROM documents")
def signature_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.signature_hash(F.col("text")).alias("hash"))


_PREFIXES = ("", "Goal: ", "/plan ", "Let's go with ", "we must not ", "Rejected: ", "blocked on ", "act as ", "never ", "objective: ")


@query(
    f"""WITH c AS (SELECT conv_id, turn, lower([{", ".join("'" + x.replace("'", "''") + "'" for x in _PREFIXES)}][(conv_id + turn) % {len(_PREFIXES)} + 1] || coalesce(text, '')) AS p, (conv_id + turn) % {len(_PREFIXES)} AS k FROM conversations)
    SELECT conv_id, turn, CASE WHEN starts_with(p, '/goal') OR starts_with(p, 'goal:') OR starts_with(p, 'objective:') THEN 'goal' WHEN starts_with(p, '/plan') THEN 'plan-changes'
      WHEN regexp_matches(p, 'let''s go with|decide on|decision:|we''ll use|chosen approach') THEN 'decisions' WHEN regexp_matches(p, 'must not|constraint:|don''t touch|never |avoid ') THEN 'constraints'
      WHEN regexp_matches(p, 'not that|rejected|don''t do|instead of') THEN 'rejected-approaches' WHEN regexp_matches(p, 'blocked on|waiting on|can''t proceed|stuck on') THEN 'blocked-on'
      WHEN starts_with(p, '/persona') OR starts_with(p, 'act as') OR starts_with(p, 'you are a') THEN 'role' ELSE 'user-prompts' END AS category FROM c"""
)
def observation_category(t: Tables) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _PREFIXES)), ((F.col("conv_id") + F.col("turn")) % len(_PREFIXES) + 1).cast("int"))
    payload = F.to_json(F.struct(F.concat(said, F.coalesce("text", F.lit(""))).alias("prompt")))
    return t.conversations.select("conv_id", "turn", text.category(F.lit("user-prompt"), payload).alias("category"))


_TOOLS = ("read_file", "edit_file", "grep", "shell", "shell", "Task", "WebFetch", "recall", "store_memory", "mcp__x__y", "Skill", "other", "Read")


@query(
    f"""WITH e AS (SELECT event_id, event_id % {len(_TOOLS)} AS k, event_type = 'error' AS bad FROM events)
    SELECT event_id, {["Read", "Edit", "Grep", "Bash", "Bash", "Task", "WebFetch", "recall", "store_memory", "mcp__x__y", "Skill", "other", "Read"]!r}[k + 1] AS tool,
      CASE WHEN k = 12 THEN 'rules' WHEN bad THEN 'errors' ELSE ['files-read', 'files-written', 'file-search', 'tool-calls', 'git-changes', 'tasks', 'web-fetch', 'searches', 'memories-stored', 'mcp-calls', 'skills-invoked', 'lifecycle-raw'][k + 1] END AS category FROM e"""
)
def tool_categories(t: Tables) -> DataFrame:
    k = F.col("event_id") % len(_TOOLS)
    name = F.element_at(F.array(*map(F.lit, _TOOLS)), (k + 1).cast("int"))
    command = F.when(k == 3, "ls -l").when(k == 4, "git status")
    payload = F.to_json(
        F.struct(
            name.alias("tool_name"), F.struct(command.alias("command"), F.when(k == 12, "a/CLAUDE.md").alias("file_path")).alias("tool_input"),
            F.struct((F.col("event_type") == "error").alias("is_error")).alias("tool_response"),
        )
    )
    return t.events.select("event_id", text.tool_name(name).alias("tool"), text.category(F.lit("post-tool-use"), payload).alias("category"))


@query(
    """WITH r AS (SELECT user_id AS session, event_type AS key, event_id AS seq, props AS content, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS before FROM events)
    SELECT session, key, seq, CASE WHEN before IS NULL THEN 'new' WHEN before = content THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN before IS NULL OR before = content THEN 0 ELSE 1 END AS lines,
      CASE WHEN before = content THEN greatest(0, CAST(ceil(length(content) / 4) AS BIGINT) - 8) ELSE 0 END AS saved FROM r"""
)
def line_diff(t: Tables) -> DataFrame:
    return text.line_diff(t.events.select(F.col("user_id").alias("session"), F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("props").alias("content")))


_SOURCES = (
    "package a.b\nfun main() { val x = 1 }", "fun go(a: Int) = a", "import 'package:x/y.dart'; class A {}", "void main() {}", "import { a } from 'b'\nconst x: string = a", "import a from 'b'",
    "def go(x):\n  return x", "fn go() -> u8 { 1 }", "package main\nfunc main() {}", "mixin M on A {}", "plain words",
)


@query(
    f"""WITH s AS (SELECT 'd' || doc_id AS id, coalesce(text, '') AS c FROM documents UNION ALL SELECT 'p' || p_partkey, [{", ".join("'" + x.replace("'", "''") + "'" for x in _SOURCES)}][p_partkey % {len(_SOURCES)} + 1] || chr(10) || p_name FROM part)
    SELECT id, CASE WHEN (regexp_matches(c, '\\bfun\\s+\\w+\\s*\\(') OR regexp_matches(c, '\\b(?:val|var)\\s+\\w+\\s*(?::\\s*\\w+[?*<>]*\\s*)?(?:=)')
        OR regexp_matches(c, '\\b(?:data\\s+class|sealed\\s+class|object\\s+\\w+|companion\\s+object|expect\\s+(?:class|fun)|actual\\s+(?:class|fun))\\b')) AND regexp_matches(c, '(?m)^(package\\s+[\\w.]+|import\\s+[\\w.]+\\.\\w+)') THEN 'kotlin'
      WHEN regexp_matches(c, '\\bfun\\s+\\w+\\s*\\(') AND NOT contains(c, 'import ') AND NOT contains(c, 'from ') THEN 'kotlin'
      WHEN regexp_matches(c, '\\bvoid\\s+main\\s*\\(') OR regexp_matches(c, '\\bpart\\s+of\\s+[''"][^''"]+[''"]\\s*;') OR regexp_matches(c, '\\bimport\\s+[''"](dart:|package:)[^''"]+[''"]\\s*;')
        OR (regexp_matches(c, '\\blibrary\\s+[a-zA-Z_][\\w.]*\\s*;|\\bpart\\s+of\\s+[a-zA-Z_][\\w.]*\\s*;|\\bmixin\\s+\\w+') AND regexp_matches(c, '\\b(class|enum|mixin|extension)\\s+\\w+')) THEN 'dart'
      WHEN contains(c, 'import ') AND contains(c, 'from ') THEN CASE WHEN contains(c, ': ') OR contains(c, 'interface ') THEN 'typescript' ELSE 'javascript' END
      WHEN contains(c, 'def ') AND contains(c, ':') THEN 'python' WHEN contains(c, 'fn ') AND contains(c, '->') THEN 'rust' WHEN contains(c, 'package ') AND contains(c, 'func ') THEN 'go' ELSE 'unknown' END AS language FROM s"""
)
def language_votes(t: Tables) -> DataFrame:
    made = F.concat(F.element_at(F.array(*map(F.lit, _SOURCES)), (F.col("p_partkey") % len(_SOURCES) + 1).cast("int")), F.lit("\n"), "p_name")
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text").unionByName(t.part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), made.alias("text")))
    return rows.select("id", text.language(F.col("text")).alias("language"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN time_bucket(INTERVAL 5 MINUTE, w) + INTERVAL 5 MINUTE
      WHEN 1 THEN date_trunc('day', w) + INTERVAL 390 MINUTE + CASE WHEN w >= date_trunc('day', w) + INTERVAL 390 MINUTE THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END
      ELSE date_trunc('day', w) + INTERVAL 12 HOUR + INTERVAL 1 DAY * ((12 - isodow(w)) % 7 + CASE WHEN isodow(w) = 5 AND w >= date_trunc('day', w) + INTERVAL 12 HOUR THEN 7 ELSE 0 END) END AS next
    FROM (SELECT o_orderkey, o_orderdate + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS w FROM orders)"""
)
def next_runs(t: Tables) -> DataFrame:
    cron = F.element_at(F.array(F.lit("*/5 * * * *"), F.lit("30 6 * * *"), F.lit("0 12 * * 5")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    at = F.expr("o_orderdate + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int))")
    return t.orders.select("o_orderkey", text.next_run_column(cron, at.cast("timestamp")).cast("timestamp_ntz").alias("next"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'src/' || p_partkey || '.ts#' || p_name ELSE 'src/' || p_partkey || '.ts#' || 'Box.' || p_name || '~method~'
      || sha256('{"version":"1.0.0","language":"typescript","dialect":"tsx","qualifiedName":"Box.' || p_name || '","kind":"method","arity":' || p_size || ',"typeTokens":["a b"],"modifiers":["async","static"]}') END AS fqn,
      CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Box.' || p_name END AS qualified, CASE WHEN p_size % 2 = 1 THEN 'method' END AS kind FROM part"""
)
def symbol_names(t: Tables) -> DataFrame:
    file, name, own = F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(".ts")), F.col("p_name"), F.col("p_size") % 2 == 0
    qualified = F.when(own, name).otherwise(F.concat(F.lit("Box."), name))
    kind = F.when(own, "function").otherwise("method")
    signature = text.canonical_signature(F.lit(" TypeScript "), F.lit("TSX"), qualified, kind, F.col("p_size"), F.array(F.lit("a   b")), F.array(F.lit("Static"), F.lit("async"), F.lit("static")))
    named = t.part.select("p_partkey", text.fqn(file, name, qualified, kind, signature, own, own).alias("fqn"))
    parts = text.fqn_parts(F.col("fqn"))
    return named.select("p_partkey", "fqn", parts["qualified"].alias("qualified"), parts["kind"].alias("kind"))


@query(
    """SELECT p_partkey, concat_ws(chr(10), CASE WHEN p_size % 2 = 0 THEN 'import a' END, 'class P' || p_partkey, array_to_string(list_transform(range(p_size % 4), lambda i: '  def run_' || i || '(self):'), chr(10))) || CASE WHEN p_size % 3 = 0 THEN chr(10) || 'export function f' || p_size || '()' ELSE '' END AS code
    FROM part WHERE p_size % 4 > 0"""
)
def code_compression(t: Tables) -> DataFrame:
    """What is left of classes with one to three methods, of which some have an import before them and a function behind."""
    size = F.col("p_size")
    methods = F.array_join(F.transform(F.sequence(F.lit(0), size % 4 - 1), lambda i: F.concat(F.lit("  def run_"), i.cast("string"), F.lit("(self):\n    return 1\n"))), "\n")
    head, tail = F.when(size % 2 == 0, "import a\n\n").otherwise("# no import\n"), F.when(size % 3 == 0, F.concat(F.lit("export function f"), size.cast("string"), F.lit("() {\n  g()\n}\n"))).otherwise("x = 1\n")
    source = F.concat(head, F.lit("class P"), F.col("p_partkey").cast("string"), F.lit(" {\n"), methods, F.lit("}\n"), tail)
    return spread(t.part.where(size % 4 > 0).select("p_partkey", "p_size")).select("p_partkey", text.compressed_column(source).alias("code"))


@query(
    """SELECT p_partkey, 1::BIGINT AS line_start, 'p_partkey' AS label, concat_ws(chr(10), '// File: data/part.json', '// Section: p_partkey', '// p_partkey', '// p_partkey', '{"p_partkey": ' || p_partkey || '}', '{"p_name": "' || p_name || '"}',
    '{"p_brand": "' || p_brand || '"}', '{"p_type": "' || p_type || '"}', '{"p_size": ' || p_size || '}') AS content FROM part"""
)
def json_chunks(t: Tables) -> DataFrame:
    """Chunks of JSON objects by their keys, short ones together."""
    made = spread(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size")).select("p_partkey", F.lit("data/part.json").alias("path"), F.to_json(F.struct("p_partkey", "p_name", "p_brand", "p_type", "p_size")).alias("body"))
    return text.smart_chunks(made, "p_partkey", "path", "body").select("p_partkey", "line_start", "label", "content")
