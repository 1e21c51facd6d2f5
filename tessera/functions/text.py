"""Chunking, token estimates, and other functions of single texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_LINES = 50


def token_estimate(text: Column, code: bool = False) -> Column:
    """Characters over four for code and five for prose, rounded up."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / (4 if code else 5))


def fixed_chunks(files: DataFrame, key: str, text: str, lines: int = CHUNK_LINES) -> DataFrame:
    """``key, line_start, line_end, content`` of every ``lines`` lines."""
    ls = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    starts = F.sequence(F.lit(0), F.size("ls") - 1, F.lit(lines))
    out = files.select(key, ls.alias("ls")).select(key, "ls", F.explode(starts).alias("s"))
    return out.select(
        key, (F.col("s") + 1).cast("long").alias("line_start"), F.least(F.col("s") + lines, F.size("ls")).cast("long").alias("line_end"), F.array_join(F.slice("ls", F.col("s") + 1, lines), "\n").alias("content")
    )


def line_dedup(files: DataFrame, key: str, text: str) -> DataFrame:
    """``key, content`` without lines that an earlier one equals but for case and outer spaces; blank lines stay."""
    rows = files.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))
    norm = F.lower(F.trim("line"))
    first = F.row_number().over(Window.partitionBy(key, "norm").orderBy("pos")) == 1
    kept = rows.withColumn("norm", norm).withColumn("first", first).where((F.col("norm") == "") | F.col("first"))
    return kept.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("content"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"\.([A-Za-z0-9]+)$", 1))


def path_prefix(path: Column, segments: int = 2) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, segments), "/")


def markdown_sections(text: str | None) -> list[tuple[int, int, str, str]]:
    """``line_start, line_end, breadcrumb, content`` by heading; headings in fenced blocks are text."""
    lines = (text or "").split("\n")
    out, trail, start, fence = [], [], 0, None

    def close(end: int) -> None:
        body = "\n".join(lines[start:end])
        if body.strip():
            out.append((start + 1, end, " > ".join(t for _, t in trail), body))

    for i, line in enumerate(lines):
        mark = re.match(r"\s*(```+|~~~+)", line)
        if mark:
            fence = None if fence and mark[1].startswith(fence) else fence or mark[1]
        head = None if fence or mark else re.match(r"(#{1,6})\s+(.*)", line)
        if head:
            close(i)
            trail = [(n, t) for n, t in trail if n < len(head[1])] + [(len(head[1]), head[2].strip())]
            start = i
    close(len(lines))
    return out


def json_paths(text: str | None) -> list[tuple[str, str]]:
    """``path, value`` of every leaf; nothing for what is no JSON."""
    try:
        root = json.loads(text or "")
    except ValueError:
        return []
    out, stack = [], [("", root)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict) and v:
            stack += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list) and v:
            stack += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        else:
            out.append((at, v if isinstance(v, str) else json.dumps(v)))
    return out


#: Rows of a batch that are Python objects at once.
SLICE = 128


def by_slices(one: Callable[..., object], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``one`` of each row, as Arrow; a batch has thousands of rows, and as Python objects they take many times their size."""
    n = len(columns[0])
    parts = [pa.array([one(*row) for row in zip(*(c.slice(at, SLICE).to_pylist() for c in columns), strict=True)], kind) for at in range(0, n, SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


class _Markdown(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.links, self.lists = [], 0, [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("p", "div", "section", "article", "table", "blockquote", "pre"):
            self.out.append("\n\n")
        elif tag in ("br", "tr"):
            self.out.append("\n")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            self.out.append("\n" + (f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "))
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "code":
            self.out.append("`")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str:
    parser = _Markdown()
    parser.feed(html or "")
    parser.close()
    lines = [x.strip() for x in "".join(parser.out).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


#: Kinds of files that are cut at declarations; Python is not, as braces tell depth.
CODE_FILES = ("ts", "js", "tsx", "jsx", "vue", "dart", "php", "java", "go", "rs", "cpp", "c", "h", "hpp", "cs", "rb", "swift", "kt", "kts", "scala", "lua", "zig")
_HOLDER = re.compile(r"(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(?:class|interface|enum|namespace|trait|impl)\s+(\w+)")
_TOP = re.compile(r"(?:export\s+(?:default\s+)?)?(?:async\s+)?(?:function|const|let|var|type|struct|fn|def|func)\s+(\w+)")
_MEMBER = re.compile(r"(?:(?:public|private|protected|static|readonly|override|async|abstract|get|set)\s+)*(\w+)\s*[(<]")
_NO_NAMES = {"if", "for", "while", "switch", "return", "throw", "catch", "do", "try", "else", "case", "with", "yield", "await"}
_NO_BRACES = re.compile(r"""/\*.*?\*/|//.*$|'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`(?:\\.|[^`\\])*`""")
OVERLAP = 6


def declarations(lines: list[str]) -> list[tuple[int, str]]:
    """``line, name`` of declarations at the left margin and of the members of the containers there, by the depth of braces."""
    out, open_, depth, comment = [], [], 0, False
    for i, line in enumerate(lines):
        bare = line.lstrip()
        if comment:
            comment = "*/" not in line
            continue
        if bare.startswith("/*") and "*/" not in bare:
            comment = True
            continue
        if not bare or bare.startswith(("//", "*")):
            continue
        if depth == 0:
            holder = _HOLDER.match(bare)
            found = holder or _TOP.match(bare)
            if found:
                out.append((i, found[1]))
            if holder:
                open_.append((holder[1], 0))
        elif open_ and depth == open_[-1][1] + 1:
            member = _MEMBER.match(bare)
            if member and member[1] not in _NO_NAMES:
                out.append((i, f"{open_[-1][0]}.{member[1]}"))
        code = _NO_BRACES.sub("", line)
        depth += code.count("{") - code.count("}")
        while open_ and depth <= open_[-1][1]:
            open_.pop()
    return out


def code_chunks(text: str | None, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """``line_start, line_end, label, content``: cut before declarations and the comments above them; each goes on for some lines into the next's comments."""
    lines = (text or "").split("\n")
    found = declarations(lines)
    if not found:
        return [(a + 1, min(len(lines), a + CHUNK_LINES), "", "\n".join(lines[a : a + CHUNK_LINES])) for a in range(0, len(lines), CHUNK_LINES)]
    starts, floor = [], 0
    for at, _ in found:
        s = at
        while s > floor and lines[s - 1].lstrip().startswith(("//", "/*", "*", "@", '"""')):
            s -= 1
        starts.append(s)
        floor = at + 1
    out = [(1, starts[0], "imports", "\n".join(lines[: starts[0]]))] if "".join(lines[: starts[0]]).strip() else []
    for n, ((_, label), s) in enumerate(zip(found, starts, strict=True)):
        end = len(lines) if n + 1 == len(found) else min(starts[n + 1] + overlap, found[n + 1][0])
        if "".join(lines[s:end]).strip():
            out.append((s + 1, end, label, "\n".join(lines[s:end])))
    return out


_IMPORTS = re.compile(r"""^\s*(?:import\s+(?:[^'"]*?\sfrom\s+)?['"]([^'"]+)['"]|(?:const|let|var)\s+[^=]+=\s*require\(\s*['"]([^'"]+)['"]|from\s+([\w.]+)\s+import\b|import\s+([\w.]+)\s*;?$|use\s+([\w:]+))""")
_CALL = re.compile(r"([A-Za-z_$][\w$]*(?:\??\.[A-Za-z_$][\w$]*)*)\s*\(\s*(?:['\"`]([^'\"`]*)['\"`])?")


def structure(text: str | None) -> list[tuple[str, str, int, str | None]]:
    """``kind, name, line, literal`` of the declarations, imports and calls of a source text, found by patterns and the depth of braces."""
    lines = (text or "").split("\n")
    named = dict(declarations(lines))
    out: list[tuple[str, str, int, str | None]] = []
    for i, line in enumerate(lines):
        if i in named:
            out.append(("declaration", named[i], i + 1, None))
        found = _IMPORTS.match(line)
        if found:
            out.append(("import", next(x for x in found.groups() if x), i + 1, None))
            continue
        if line.lstrip().startswith(("//", "*", "#")):
            continue
        own = named.get(i, "").rsplit(".", 1)[-1]
        out += [("call", m[1], i + 1, m[2]) for m in _CALL.finditer(line) if m[1] not in _NO_NAMES and m[1] not in ("function", own)]
    return out


_PARTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("line", T.LongType()), T.StructField("literal", T.StringType())]))


@F.arrow_udf(_PARTS)
def structure_column(text: pa.Array) -> pa.Array:
    names = ("kind", "name", "line", "literal")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("literal", pa.string())]))
    return by_slices(lambda t: [dict(zip(names, x, strict=True)) for x in structure(t)], kind, text)


def chunk_of(path: str, text: str | None) -> list[tuple[int, int, str, str]]:
    """``line_start, line_end, label, content`` by the kind of file."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if ext in ("md", "mdx"):
        return markdown_sections(text)
    if ext == "json":
        try:
            root = json.loads(text or "")
        except ValueError:
            root = None
        if isinstance(root, dict) and len(root) >= 5:
            return [(1, 1, k, json.dumps({k: v}, ensure_ascii=False)) for k, v in root.items()]
    if ext in ("yaml", "yml"):
        lines = (text or "").split("\n")
        cuts = [i for i, x in enumerate(lines) if x.strip() == "---" or re.match(r"[\w\"'-]+\s*:", x)]
        edges = [0, *[c for c in cuts if c], len(lines)]
        return [(a + 1, b, lines[a].split(":")[0].strip(), "\n".join(lines[a:b])) for a, b in zip(edges, edges[1:], strict=False) if "".join(lines[a:b]).strip()]
    if ext in CODE_FILES:
        return code_chunks(text)
    lines = (text or "").split("\n")
    return [(a + 1, min(len(lines), a + CHUNK_LINES), "", "\n".join(lines[a : a + CHUNK_LINES])) for a in range(0, len(lines), CHUNK_LINES)]


def finished_chunks(path: str, text: str | None) -> list[tuple[int, int, str, str]]:
    code = path.rsplit(".", 1)[-1].lower() in CODE_FILES if "." in path else False
    cut = bounded_chunks([c for c in chunk_of(path, text) if c[3].strip()], code, MOST_CHARS - HEADER)
    return [(a, b, label, headed(path, label, body)) for a, b, label, body in cut]


_CHUNKS = T.ArrayType(T.StructType([T.StructField("line_start", T.LongType()), T.StructField("line_end", T.LongType()), T.StructField("label", T.StringType()), T.StructField("content", T.StringType())]))


@F.arrow_udf(_CHUNKS)
def chunks_column(path: pa.Array, text: pa.Array) -> pa.Array:
    names = ("line_start", "line_end", "label", "content")
    kind = pa.list_(pa.struct([("line_start", pa.int64()), ("line_end", pa.int64()), ("label", pa.string()), ("content", pa.string())]))
    return by_slices(lambda p, t: [dict(zip(names, c, strict=True)) for c in finished_chunks(p or "", t)], kind, path, text)


def smart_chunks(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """``key, line_start, line_end, label, content``: chunks by the kind of file that the path tells, within the bounds and below a header."""
    return files.select(key, F.explode(chunks_column(path, text)).alias("c")).select(key, "c.*")


@F.arrow_udf(T.StringType())
def markdown_column(html: pa.Array) -> pa.Array:
    return by_slices(html_to_markdown, pa.string(), html)


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])))
def json_paths_column(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())]))
    return by_slices(lambda x: [{"path": p, "value": v} for p, v in json_paths(x)], kind, text)


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long; null as the empty text."""
    hexed = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    codes = F.transform(places, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    # the product of two 32-bit numbers, modulo 2 ** 32, from the prime's two parts
    step = lambda h, b: ((h.bitwiseXOR(b) * 0x193) + F.shiftleft(h.bitwiseXOR(b).bitwiseAND(F.lit(0xFF)), 24)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), step)


def _field(spec: str, low: int, high: int) -> set[int]:
    out: set[int] = set()
    for part in spec.split(","):
        body, _, step = part.partition("/")
        a, dash, b = body.partition("-")
        first, last = (low, high) if body == "*" else (int(a), int(b) if dash else (high if step else int(a)))
        out |= set(range(first, last + 1, int(step or 1)))
    if not out or min(out) < low or max(out) > high:
        raise ValueError(f"{spec} is out of range")
    return out


def next_run(cron: str, after: datetime) -> datetime:
    """The next minute, in UTC, that a five-field schedule names; day of month and of week must both fit."""
    minute, hour, day, month, weekday = (_field(s, a, b) for s, (a, b) in zip(cron.split(), ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    days = {d % 7 for d in weekday}
    t = after.astimezone(UTC).replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(366 * 5):
        if t.month in month and t.day in day and t.isoweekday() % 7 in days:
            for h in sorted(h for h in hour if h >= t.hour):
                for m in sorted(minute):
                    if h > t.hour or m >= t.minute:
                        return t.replace(hour=h, minute=m)
        t = t.replace(hour=0, minute=0) + timedelta(days=1)
    raise ValueError(f"{cron} never runs")


@F.arrow_udf(T.TimestampType())
def next_run_column(cron: pa.Array, after: pa.Array) -> pa.Array:
    """:func:`next_run` of each row; null where an argument is null or the schedule is none."""

    def one(spec: str | None, at: datetime | None) -> datetime | None:
        try:
            return None if spec is None or at is None else next_run(spec, at)
        except ValueError:
            return None

    return pa.array([one(c.as_py(), a.as_py()) for c, a in zip(cron, after, strict=True)], pa.timestamp("us", "UTC"))


# What tells a language.
KOTLIN_FUN = r"\bfun\s+\w+\s*\("
KOTLIN_VALUE = r"\b(?:val|var)\s+\w+\s*(?::\s*\w+[?*<>]*\s*)?(?:=)"
KOTLIN_PACKAGE = r"(?m)^package\s+[\w.]+"
KOTLIN_IMPORT = r"(?m)^import\s+[\w.]+\.\w+"
KOTLIN_CLASS = r"\b(?:data\s+class|sealed\s+class|object\s+\w+|companion\s+object|expect\s+(?:class|fun)|actual\s+(?:class|fun))\b"
DART_DIRECTIVE = r"(\blibrary\s+[a-zA-Z_][\w.]*\s*;|\bpart\s+of\s+[a-zA-Z_][\w.]*\s*;)"
DART_TYPE = r"\b(class|enum|mixin|extension)\s+\w+"
DART_MAIN = r"\bvoid\s+main\s*\("
DART_PART = r"""\bpart\s+of\s+['"][^'"]+['"]\s*;"""
DART_IMPORT = r"""\bimport\s+['"](dart:|package:)[^'"]+['"]\s*;"""
DART_MIXIN = r"\bmixin\s+\w+"


def language(text: Column) -> Column:
    """The language of a source text by the first rule that holds; ``unknown`` if none does."""
    c = F.coalesce(text, F.lit(""))
    has = lambda *parts: sum_and([F.contains(c, F.lit(x)) for x in parts])
    kotlin = (c.rlike(KOTLIN_FUN) | c.rlike(KOTLIN_VALUE) | c.rlike(KOTLIN_CLASS)) & (c.rlike(KOTLIN_PACKAGE) | c.rlike(KOTLIN_IMPORT))
    bare = c.rlike(KOTLIN_FUN) & ~has("import ") & ~has("from ")
    dart = c.rlike(DART_MAIN) | c.rlike(DART_PART) | c.rlike(DART_IMPORT) | (c.rlike(DART_DIRECTIVE) & c.rlike(DART_TYPE)) | (c.rlike(DART_MIXIN) & c.rlike(DART_TYPE))
    script = has("import ", "from ")
    return (
        F.when(kotlin | bare, "kotlin").when(dart, "dart").when(script & (has(": ") | has("interface ")), "typescript").when(script, "javascript")
        .when(has("def ", ":"), "python").when(has("fn ", "->"), "rust").when(has("package ", "func "), "go").otherwise("unknown")
    )


def sum_and(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


# Names that hosts give to tools, and the common names.
TOOL_NAMES = {
    "Read": "Read",
    "Write": "Write",
    "Edit": "Edit",
    "MultiEdit": "MultiEdit",
    "Glob": "Glob",
    "Grep": "Grep",
    "Bash": "Bash",
    "Task": "Task",
    "TodoWrite": "TodoWrite",
    "WebFetch": "WebFetch",
    "WebSearch": "WebSearch",
    "run_shell_command": "Bash",
    "shell": "Bash",
    "write_file": "Write",
    "edit_file": "Edit",
    "list_files": "Glob",
    "search_files": "Grep",
    "grep": "Grep",
    "glob": "Glob",
    "search": "search",
    "recall": "recall",
    "store_memory": "store_memory",
    "search_definitions": "search_definitions",
    "get_references": "get_references",
    "read_file": "Read",
    "compact_snapshot": "compact_snapshot",
}
# What the calls of tools are, and what prompts that begin with or contain a phrase are, in order.
TOOL_CATEGORIES = {
    "Read": "files-read", "Write": "files-written", "Edit": "files-written", "MultiEdit": "files-written", "Glob": "file-search", "Grep": "file-search", "Bash": "tool-calls", "TodoWrite": "tasks", "Task": "tasks",
    "WebFetch": "web-fetch", "WebSearch": "searches", "search": "searches", "search_definitions": "searches", "get_references": "searches", "recall": "searches", "store_memory": "memories-stored",
    "compact_snapshot": "compaction-snapshots",
}
PROMPTS = (
    ("goal", True, ("/goal", "goal:", "objective:")),
    ("plan-changes", True, ("/plan",)),
    ("decisions", False, ("let's go with", "decide on", "decision:", "we'll use", "chosen approach")),
    ("constraints", False, ("must not", "constraint:", "don't touch", "never ", "avoid ")),
    ("rejected-approaches", False, ("not that", "rejected", "don't do", "instead of")),
    ("blocked-on", False, ("blocked on", "waiting on", "can't proceed", "stuck on")),
    ("role", True, ("/persona", "act as", "you are a")),
)
RULE_FILES = ("claude.md", "agents.md", "cursorrules", ".clinerules", "rtk.md")
RULE_PART = "claudemd"


def tool_name(name: Column) -> Column:
    """A tool's common name; unknown names stay, and a missing one is empty."""
    known = F.create_map(*[F.lit(x) for pair in TOOL_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(known, F.coalesce(name, F.lit(""))), name, F.lit(""))


def category(source: Column, payload: Column) -> Column:
    """What an observation is, from its source and its payload, a JSON object: the first rule that holds, ``lifecycle-raw`` if none does."""
    at = lambda *paths: F.coalesce(*[F.get_json_object(payload, f"$.{p}") for p in paths])
    true = lambda c: F.coalesce(~c.isin("", "false", "0"), F.lit(False))  # noqa: E731  as scripts take values
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    any_ = lambda tests: sum_or(list(tests))
    tool = tool_name(at("tool_name", "toolName"))
    named = tool_name(at("tool_name"))
    path = low(at("file_path", "path", "tool_input.file_path"))
    rules = (named == "Read") & (any_(path.endswith(x) for x in RULE_FILES) | F.contains(path, F.lit(RULE_PART)))
    out_ = low(at("stdout"))
    error = (source == "post-tool-use") & (
        (at("tool_response.is_error", "toolResponse.is_error") == "true") | true(at("tool_response.error", "toolResponse.error")) | F.contains(out_, F.lit("error:")) | F.contains(out_, F.lit("failed:"))
    )
    command = low(at("command"))
    git = (command.startswith("git ") & any_(F.contains(command, F.lit(x)) for x in ("commit", "merge", "rebase", "checkout", "reset"))) | true(at("diff", "git_diff"))
    typed = low(at("command", "tool_input.command"))
    shell_git = (tool == "Bash") & (typed.startswith("git ") | F.contains(typed, F.lit(" git ")))
    calls = F.element_at(F.create_map(*[F.lit(x) for pair in TOOL_CATEGORIES.items() for x in pair]), tool)
    prompt = low(at("prompt", "message", "text"))
    asked = F.lit("user-prompts")
    for name, starts, phrases in reversed(PROMPTS):
        asked = F.when(any_(prompt.startswith(x) if starts else F.contains(prompt, F.lit(x)) for x in phrases), name).otherwise(asked)
    start = F.when(true(at("settings")) | true(at("model")), "session-settings").when(true(at("cwd")) | true(at("workingDirectory")), "cwd-changes").when(true(at("env")) | true(at("environment")), "env-changes").otherwise("session-settings")
    known = F.coalesce
    return (
        F.when(known(rules, F.lit(False)), "rules").when(known(error, F.lit(False)), "errors").when(known(git, F.lit(False)), "git-changes").when(at("tool_name").isin("Skill", "skill"), "skills-invoked")
        .when(shell_git, "git-changes").when(calls.isNotNull(), calls).when(tool.startswith("mcp__"), "mcp-calls")
        .when(source == "user-prompt", asked).when(source == "session-start", start).when(source == "pre-compact", "compaction-snapshots").otherwise("lifecycle-raw")
    )


def sum_or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# Names of calls that listen, and of clients and their methods.
LISTENS = ("on", "once", "addListener", "addEventListener", "off", "removeListener")
HTTP_CLIENTS = ("axios", "http", "https", "got", "superagent", "request")
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "request", "head", "options")


def call_kind(target: Column, literal: Column) -> Column:
    """What a call is (``emit``, ``listen``, ``http_call`` or ``call``), from what is called and its first literal."""
    bare = F.replace(F.regexp_replace(F.coalesce(target, F.lit("")), r"\s+", ""), F.lit("?."), F.lit("."))
    parts = F.filter(F.split(bare, r"[.:/]", -1), lambda x: x != "")
    name, root = F.coalesce(F.try_element_at(parts, F.lit(-1)), bare), F.when(F.size(parts) > 1, F.element_at(parts, 1))
    text = F.regexp_replace(F.coalesce(literal, F.lit("")), "^[\"'`]|[\"'`]$", "")
    client = (root.isin(*HTTP_CLIENTS) & name.isin(*HTTP_METHODS)) | ((root == "trpc") & name.isin("query", "mutate", "subscribe"))
    return (
        F.when(name == "emit", "emit").when(name.isin(*LISTENS), "listen").when(name.isin("fetch", "graphql", "gql"), "http_call")
        .when(client, "http_call").when(text.rlike(r"^(?:https?://|/api(?:/|$))"), "http_call").otherwise("call")
    )


def line_diff(reads: DataFrame, ref_cost: int = 8) -> DataFrame:
    """Each read of a file in a session against the one before: ``state`` (new, unchanged, changed), lines that differ by position, and tokens saved by a reference.

    Reads ``session, key, seq, content``.
    """
    before = F.lag("content").over(Window.partitionBy("session", "key").orderBy("seq"))
    rows = reads.withColumn("before", before)
    a, b = F.split(F.coalesce("before", F.lit("")), "\n", -1), F.split(F.coalesce("content", F.lit("")), "\n", -1)
    differ = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    state = F.when(F.col("before").isNull(), "new").when(F.col("before") == F.col("content"), "unchanged").otherwise("changed")
    saved = F.when(state == "unchanged", F.greatest(F.lit(0).cast("long"), token_estimate(F.col("content"), True) - ref_cost)).otherwise(0)
    return rows.select("session", "key", "seq", state.alias("state"), F.when(state == "new", 0).otherwise(differ).cast("long").alias("lines"), saved.cast("long").alias("saved"))


def signature_hash(text: Column) -> Column:
    """SHA-256 of a signature with its white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), 256)


def topics(path: Column, symbols: Column | None = None) -> Column:
    """Words of a path's segments and of symbol names, cut before capitals; at least three letters, each once in order, without common ones."""
    stop = "src lib test tests spec index main ts tsx js jsx py rs go java dart".split()
    named = path if symbols is None else F.concat_ws(" ", path, F.array_join(symbols, " "))
    parts = F.split(F.regexp_replace(named, r"(?=[A-Z])|[^A-Za-z0-9]+", " "), " +")
    return F.array_distinct(F.filter(F.transform(parts, lambda w: F.lower(w)), lambda w: (F.length(w) >= 3) & ~w.isin(stop)))


# Kinds of symbols that a qualified name may carry.
FQN_VERSION = "1.0.0"


def canonical_signature(language: Column, dialect: Column, qualified: Column, kind: Column, arity: Column, types: Column, modifiers: Column) -> Column:
    """A symbol's signature as JSON with its white space collapsed; modifiers in lower case, sorted, each once."""
    tight = lambda c: F.regexp_replace(F.trim(c), r"\s+", " ")
    fields = F.struct(
        F.lit(FQN_VERSION).alias("version"), F.lower(tight(language)).alias("language"), F.lower(tight(dialect)).alias("dialect"), F.trim(qualified).alias("qualifiedName"), kind.alias("kind"), arity.alias("arity"),
        F.transform(types, tight).alias("typeTokens"), F.array_sort(F.array_distinct(F.transform(modifiers, lambda m: F.lower(tight(m))))).alias("modifiers"),
    )
    return F.to_json(fields, {"ignoreNullFields": "false"})


def fqn(file: Column, name: Column, qualified: Column, kind: Column, signature: Column, top_level: Column, unique: Column) -> Column:
    """``file#name`` for a single top-level symbol, else ``file#qualified~kind~hash``."""
    plain = top_level & unique & ~name.rlike(r"(?i)~[^~]+~[0-9a-f]+$")
    return F.concat(file, F.lit("#"), F.when(plain, name).otherwise(F.concat(qualified, F.lit("~"), kind, F.lit("~"), F.sha2(signature, 256))))


def fqn_parts(name: Column) -> Column:
    """``file, qualified, kind, hash`` of a symbol's full name; kind and hash are null for a plain one, and all for what is no name."""
    symbol = F.substring_index(name, "#", -1)
    whole = symbol.rlike("^.*~[^~]+~[0-9a-f]{64}$")
    part = lambda i: F.regexp_extract(symbol, "^(.*)~([^~]+)~([0-9a-f]{64})$", i)
    ok = name.rlike("^[^#]+#[^#]+$")
    return F.when(ok, F.struct(F.substring_index(name, "#", 1).alias("file"), F.when(whole, part(1)).otherwise(symbol).alias("qualified"), F.when(whole, part(2)).alias("kind"), F.when(whole, part(3)).alias("hash")))


#: Lines of a chunk at most, of a code chunk at most, and fewer than which a chunk joins the one before; characters at most.
MOST_LINES, MOST_CODE, LEAST_LINES, MOST_CHARS = 200, 100, 5, 7500
#: Characters of a chunk that are left for its header.
HEADER = 250


def line_pieces(line: str, most: int) -> list[str]:
    """A long line in pieces of ``most`` characters at most, cut after the last ``;``, ``,``, ``}`` or space of the last fifth, the first of these that is there."""
    out = []
    while len(line) > most:
        low = int(most * 0.8)
        cuts = [at for at in (line.rfind(c, low, most) for c in ";,} ") if at >= 0]
        cut = cuts[0] + 1 if cuts else most
        out.append(line[:cut])
        line = line[cut:]
    return [*out, line] if line else out


def bounded_chunks(chunks: list[tuple[int, int, str, str]], code: bool = False, most_chars: int = MOST_CHARS) -> list[tuple[int, int, str, str]]:
    """Chunks ``start, end, label, content`` within the bounds: large ones cut, at a blank line in their second half where there is one; small ones joined to the chunk before."""
    most, out = MOST_CODE if code else MOST_LINES, []
    for a, b, label, body in chunks:
        lines = body.split("\n")
        if len(lines) > most or len(body) > most_chars:
            parts = []
            at = 0
            while at < len(lines):
                if len(lines[at]) > most_chars:
                    parts += [(a + at, a + at, x) for x in line_pieces(lines[at], most_chars)]
                    at += 1
                    continue
                end, size = at, -1
                while end < min(at + most, len(lines)) and (end == at or size + 1 + len(lines[end]) <= most_chars):
                    size += 1 + len(lines[end])
                    end += 1
                if end < len(lines):
                    half = at + max(1, (end - at) // 2)
                    end = next((i for i in range(end, half, -1) if not lines[i].strip()), end)
                if "".join(lines[at:end]).strip():
                    parts.append((a + at, a + end - 1, "\n".join(lines[at:end])))
                at = end
            out += [(x, y, f"{label} (part {i})" if label else label, text) for i, (x, y, text) in enumerate(parts, 1)]
            continue
        if len(lines) < LEAST_LINES and out and not (label and code):
            x, y, name, before = out[-1]
            if before.count("\n") + 1 + len(lines) <= MOST_LINES and len(before) + 1 + len(body) <= most_chars:
                out[-1] = (x, b, name, f"{before}\n{body}")
                continue
        out.append((a, b, label, body))
    return out


def headed(path: str, label: str, body: str) -> str:
    """A chunk's content below the name of its file and of its section, which long chunks repeat."""
    section = f"// Section: {label}\n" if label else ""
    if label and body.count("\n") + 1 >= LEAST_LINES:
        section += f"// {label}\n" * 2
    return f"// File: {path}\n{section}{body}"


def compressed_code(text: str | None) -> str:
    """The declarations of a source text, without bodies."""
    return "\n".join(x.rstrip().removesuffix("{").rstrip() for x in (text or "").split("\n") if re.match(r"\s*(import|from|export|class|interface|enum|type|def|func|fn|function|struct|impl|trait|async def|public|private|protected)\b", x))


@F.arrow_udf(T.StringType())
def compressed_column(text: pa.Array) -> pa.Array:
    return pa.array([compressed_code(x.as_py()) for x in text], pa.string())
