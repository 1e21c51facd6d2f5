"""Predicates and projections on files, memories and texts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PATTERNS = 32
# Paths that must not be shown, and paths that are not captured.
SECRET_PATHS = (r"(?i)\.env", r"(?i)\.key$", r"(?i)\.pem$", r"(?i)\.p12$", r"(?i)\.pfx$", r"(?i)^secrets?\.", r"(?i)\.keystore$", r"(?i)^id_rsa", r"(?i)\.asc$")
IGNORED = (
    "**/node_modules/**", "**/.git/**", "**/dist/**", "**/build/**", "**/coverage/**", ".env", ".env.*", "**/generated/**", "**/*.generated.*", "**/*.d.ts",
    "**/__tests__/**", "**/tests/**", "**/*.test.ts", "**/*.test.tsx", "**/*.test.js", "**/*.test.jsx", "**/*.spec.ts", "**/*.spec.tsx", "**/*.spec.js", "**/*.spec.jsx",
    "**/benchmarks/**", "**/fixtures/**", "**/*.wasm*", "**/*.min.*", "**/*.map", "**/lock.yaml", "**/pnpm-lock.yaml", "**/package-lock.json", "**/bun.lockb", "**/yarn.lock",
)


def all_of(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def conjunction(least: dict[str, float] | None = None, **equal: object) -> Column:
    """Equality with each value that is given (a list: with one of them), and lower bounds; None leaves a column out."""
    tests = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(c) == v for c, v in equal.items() if v is not None]
    return all_of(tests + [F.col(c) >= v for c, v in (least or {}).items()])


def any_token(text: Column, query: str) -> Column:
    """Whether a text contains one of the query's words, in any case; no words: true."""
    ws = re.sub(r"[^\w\s]", " ", query).split()
    return any_of([F.contains(F.lower(text), F.lit(w.lower())) for w in ws]) if ws else F.lit(True)


def glob_regex(glob: str) -> str:
    """A regular expression for a path pattern with ``*``, ``**``, ``?`` and ``{a,b}``."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            depth += (c == "{") - (c == "}")
            out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c, re.escape(c))
            i += 1
    return f"^{out}$"


def checked_patterns(include: Sequence[str], exclude: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """``(include, exclude, downgrades)``: a pattern in both lists is included, and reported; raises on too many or empty patterns."""
    if len(include) + len(exclude) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns")
    if not all((*include, *exclude)):
        raise ValueError("a pattern is empty")
    both = [g for g in exclude if g in include]
    return list(include), [g for g in exclude if g not in include], both


def globbed(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Paths that match a pattern of ``include`` and none of ``exclude``, one in both lists counting as included; rows without a path pass if all is included."""
    include, exclude, _ = checked_patterns(include, exclude)
    within = any_of([path.rlike(glob_regex(g)) for g in include]) if include else F.lit(True)
    out = within & ~any_of([path.rlike(glob_regex(g)) for g in exclude])
    return F.when(path.isNull(), F.lit(not include)).otherwise(out)


def is_secret_path(path: Column) -> Column:
    """Paths, relative to the project, that look like secrets."""
    return any_of([path.rlike(p) for p in SECRET_PATHS])


def is_ignored(path: Column, extra: Sequence[str] = (), tests: bool = False) -> Column:
    """Paths that are not captured: a pattern without a slash holds in any folder, as in ignore files.  With ``tests`` those of tests are captured."""
    built_in = [g for g in IGNORED if not (tests and re.search(r"tests|\.test\.|\.spec\.", g))]
    anywhere = [g if "/" in g else f"**/{g}" for g in (*built_in, *extra)]
    return any_of([path.rlike(glob_regex(g)) for g in anywhere])


def tagged(rows: DataFrame, tags: Sequence[str], every: bool = False) -> DataFrame:
    """Rows whose array ``tags`` holds one of ``tags``, or with ``every`` all of them."""
    tests = [F.array_contains("tags", x) for x in tags]
    return rows.where(all_of(tests) if every else any_of(tests))


def recent_by_tag(rows: DataFrame, tag: str, since: Column, limit: int, exclude: object | None = None, **scope: object) -> DataFrame:
    """``id`` of rows with a tag from ``since`` on, newest first, without ``exclude`` and within the sessions or projects of ``scope``."""
    out = tagged(rows, [tag]).where((F.col("created_at") >= since) & conjunction(**scope))
    if exclude is not None:
        out = out.where(F.col("id") != F.lit(exclude))
    return out.orderBy(F.col("created_at").desc(), "id").select("id").limit(limit)


def by_id(rows: DataFrame, id_: str, value: object) -> DataFrame:
    """The row with an id; the filter reaches the scan."""
    return rows.where(F.col(id_) == F.lit(value)).limit(1)


def is_test_file(path: Column) -> Column:
    return path.rlike(r"(?i)(?:^|/)(?:__tests__|tests?|spec)/|\.(?:test|spec)\.[a-z]+$")


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of rows with the ``total`` that there are.

    The total is a second, aggregated pass; a window over all rows would put them in one task.
    """
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # the total is one row


def line_range(files: DataFrame, key: str, text: str, start: int, end: int) -> DataFrame:
    """``key, line_no, line`` of the lines from ``start`` to ``end``, counted from 1."""
    part = F.slice(F.split(text, "\n", -1), start, max(0, end - start + 1))
    return files.where(F.col(text).isNotNull()).select(key, F.posexplode(part).alias("n", "line")).select(key, (F.col("n") + start).cast("long").alias("line_no"), "line")


def compression_candidates(memories: DataFrame, age_days: Column, limit: int = 50) -> DataFrame:
    """Long, old memories of middling importance, oldest first."""
    some = memories.where((F.col("importance") > 0.3) & (F.col("importance") < 0.5) & (age_days >= 14) & (F.length("content") >= 200))
    return some.orderBy(age_days.desc(), "id").limit(limit)


def projected(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Dotted fields of ``df``, mapped through arrays of structs; those that are not there are left out.

    Each column is named by its dotted path.  A string column that holds JSON is read by path too.
    """
    found = []
    for f in fields:
        head, _, rest = f.partition(".")
        kind = {c.name: c.dataType for c in df.schema}.get(head)
        col = None if kind is None else _field(F.col(f"`{head}`"), kind, rest.split(".") if rest else [])
        if col is not None:
            found.append(col.alias(f))
    return df.select(*found)


def _field(col: Column, kind: T.DataType, path: list[str]) -> Column | None:
    if not path:
        return col
    if isinstance(kind, T.ArrayType):
        if _field(F.lit(None).cast(kind.elementType), kind.elementType, path) is None:
            return None
        return F.transform(col, lambda x: _field(x, kind.elementType, path))
    if isinstance(kind, T.StructType):
        inner = {c.name: c.dataType for c in kind}.get(path[0])
        return None if inner is None else _field(col.getField(path[0]), inner, path[1:])
    if isinstance(kind, T.StringType):
        return F.get_json_object(col, "$." + ".".join(path))
    return None
