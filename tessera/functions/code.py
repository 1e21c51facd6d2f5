"""Calls and data flow of source texts with braces: a lexer that masks what is no code, scopes, and chains from definitions to uses."""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import call_kind

_NAME = r"[A-Za-z_$][\w$]*"
_CALLED = re.compile(rf"({_NAME}(?:\s*\??\.\s*{_NAME})*)\s*\(")
_BOUND = re.compile(rf"\b(?:const|let|var)\s+({_NAME})|(?<![\w$.])({_NAME})\s*(?:[-+*/%|&^]|\*\*|<<|>>|&&|\|\||\?\?)?=(?![=>])")
_ARROW = re.compile(rf"(?:\(([^()]*)\)\s*(?::[^=;{{}}()]*)?|(?<![\w$.])({_NAME})\s*)=>")
_WHOLE = re.compile(_NAME)
#: Words before a parenthesis that are no calls, and words that are no variables.
_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "new", "super", "require", "import", "with", "do", "else", "in", "of", "delete", "void", "yield", "case", "throw"))
_CONSTANT = frozenset(("true", "false", "null", "undefined", "this", "NaN", "Infinity"))


def masked(text: str) -> str:
    """``text`` with spaces in place of comments, regular expressions and the insides of strings; lines and places stay, and so does the code inside templates."""
    out, i, n = list(text), 0, len(text)
    nested: list[int] = []  # depth of braces in each open template expression
    last = ""  # the last character of code

    def blank(a: int, b: int) -> None:
        for j in range(a, min(b, n)):
            if out[j] != "\n":
                out[j] = " "

    def template(at: int) -> int:
        """The place after a template's text from ``at``: behind its end, or behind ``${``."""
        j = at
        while j < n and text[j] != "`":
            if text[j] == "\\":
                j += 1
            elif text.startswith("${", j):
                blank(at, j)
                nested.append(0)
                return j + 2
            j += 1
        blank(at, j)
        return j + 1

    while i < n:
        c = text[i]
        if text.startswith("//", i):
            end = text.find("\n", i)
            end = n if end < 0 else end
            blank(i, end)
            i = end
        elif text.startswith("/*", i):
            end = text.find("*/", i + 2)
            end = n if end < 0 else end + 2
            blank(i, end)
            i = end
        elif c in "'\"":
            j = i + 1
            while j < n and text[j] != c and text[j] != "\n":
                j += 1 + (text[j] == "\\")
            blank(i + 1, j)
            i, last = j + 1, c
        elif c == "`":
            i, last = template(i + 1), c
        elif c == "/" and (not last or last in "(,=:[!&|?{};+-*%<>~^"):
            j, within = i + 1, False
            while j < n and text[j] != "\n" and (within or text[j] != "/"):
                within = (within or text[j] == "[") and text[j] != "]"
                j += 1 + (text[j] == "\\")
            blank(i, j + 1)
            i, last = j + 1, "/"
        elif c == "}" and nested and not nested[-1]:
            nested.pop()
            i, last = template(i + 1), "`"
        else:
            if nested and c in "{}":
                nested[-1] += 1 if c == "{" else -1
            if not c.isspace():
                last = c
            i += 1
    return "".join(out)


def _closing(code: str, start: int) -> int:
    """The place of the bracket that closes the one at ``start``, or the end."""
    depth = 0
    for i in range(start, len(code)):
        depth += (code[i] in "([{") - (code[i] in ")]}")
        if not depth:
            return i
    return len(code)


def _split(code: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts between commas that lie in no inner bracket."""
    out, at, depth = [], start, 0
    for i in range(start, end):
        depth += (code[i] in "([{") - (code[i] in ")]}")
        if code[i] == "," and not depth:
            out.append((at, i))
            at = i + 1
    return [*out, (at, end)] if out or code[start:end].strip() else []


def _names(code: str, start: int, end: int) -> list[tuple[str, int]]:
    """Parameters: the first name of each part."""
    found = [(_WHOLE.search(code, a, b)) for a, b in _split(code, start, end)]
    return [(m[0], m.start()) for m in found if m]


Edge = tuple[str, str, int, str | None, int | None, str | None, int | None]


def flows(text: str | None) -> list[Edge]:
    """``target, qualifier, line, literal, param_index, argument, defined``: a row for each call, and one more for each argument that is a variable.

    ``defined`` is the line of the definition that reaches the argument: the last one before it in the innermost scope that has the name, a
    parameter, a declaration or a later assignment; null if there is none.
    """
    text = text or ""
    code = masked(text)
    lines = [i for i, c in enumerate(code) if c == "\n"]
    line = lambda at: bisect_right(lines, at - 1) + 1
    scopes: list[tuple[int, int]] = []
    stack = []
    for i, c in enumerate(code):
        if c == "{":
            stack.append(i)
        elif c == "}" and stack:
            scopes.append((stack.pop(), i))
    scopes += [(i, len(code)) for i in stack]
    scopes.sort()

    def around(at: int) -> list[tuple[int, int]]:
        """Scopes of a place, innermost first, and the whole text last."""
        return [s for s in reversed(scopes[: bisect_right(scopes, (at, len(code) + 1))]) if s[0] < at <= s[1]] + [(-1, len(code))]

    known: dict[tuple[tuple[int, int], str], list[int]] = {}

    def bind(scope: tuple[int, int], name: str, at: int) -> None:
        known.setdefault((scope, name), []).append(at)

    def body(after: int) -> tuple[int, int] | None:
        """The scope that opens behind a parameter list, past a type."""
        m = re.compile(r"\s*(?::[^={};()]*)?(?:=>)?\s*\{").match(code, after)
        return next((s for s in scopes if m and s[0] == m.end() - 1), None)

    calls, heads = [], set()
    for m in _CALLED.finditer(code):
        close = _closing(code, m.end() - 1)
        inner = body(close + 1)
        name = re.sub(r"\s+", "", m[1]).replace("?.", ".")
        made = code[: m.start()].rstrip().endswith("function")
        if inner and "." not in name and (name not in _CONTROL or name in ("function", "catch")) and not re.match(r"\s*=>", code[close + 1 :]):
            heads.add(m.start())
            for p, at in _names(code, m.end(), close):
                bind(inner, p, at)
        elif not made and name not in _CONTROL:
            calls.append((m, name, close))
    for m in _ARROW.finditer(code):
        inner = body(m.end())
        # without braces the expression that follows is the scope, up to what closes around it
        end = inner[1] if inner else next((i for i in range(m.end(), len(code)) if code[i] in ";\n" or _depth(code, m.end(), i) < 0), len(code))
        scope = inner or (m.start() - 1, end)
        if not inner:
            scopes.append(scope)
        for p, at in _names(code, m.start(1), m.end(1)) if m[1] is not None else [(m[2], m.start(2))]:
            bind(scope, p, at)
    scopes.sort()
    for m in _BOUND.finditer(code):
        if m[1]:
            bind(around(m.start())[0], m[1], m.start(1))
        elif m[2] not in _CONSTANT:
            home = next((s for s in around(m.start()) if (s, m[2]) in known), None)
            if home and m.start(2) not in known[home, m[2]]:
                bind(home, m[2], m.start(2))

    def defined(name: str, at: int) -> int | None:
        for scope in around(at):
            before = [d for d in known.get((scope, name), ()) if d < at]
            if before:
                return line(max(before))
        return None

    out: list[Edge] = []
    for m, name, close in calls:
        target, qualifier = name.rsplit(".", 1)[-1], name.rsplit(".", 1)[0] if "." in name else ""
        args = _split(code, m.end(), close)
        first = text[args[0][0] : args[0][1]].strip() if args else ""
        literal = first[1:-1] if len(first) > 1 and first[0] in "'\"`" and first[-1] == first[0] else None
        out.append((target, qualifier, line(m.start()), literal, None, None, None))
        for i, (a, b) in enumerate(args):
            arg = code[a:b].strip()
            if _WHOLE.fullmatch(arg) and arg not in _CONSTANT:
                at = a + len(code[a:b]) - len(code[a:b].lstrip())
                out.append((target, qualifier, line(at), None, i, arg, defined(arg, at)))
    return out


def _depth(code: str, start: int, end: int) -> int:
    part = code[start : end + 1]
    return sum(c in "([{" for c in part) - sum(c in ")]}" for c in part)


_FIELDS = ("target", "qualifier", "line", "literal", "param_index", "argument", "defined")
_KINDS = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())


_EDGES = T.ArrayType(T.StructType([T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(_FIELDS, _KINDS, strict=True)]))


@F.arrow_udf(_EDGES)
def flows_column(text: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct(list(zip(_FIELDS, _KINDS, strict=True))))
    return pa.array([[dict(zip(_FIELDS, e, strict=True)) for e in flows(t)] for t in text.to_pylist()], kind)


def edges(files: DataFrame, key: str, text: Column) -> DataFrame:
    """``key, kind, target, qualifier, line, param_index, argument, defined``: calls by their kind, and ``data_flow`` from variables to the parameters they are passed to.

    An ``emit`` or ``listen`` is to the event that it names.  Strings and comments hold no code; a text is one row's, of any length.
    """
    rows = files.select(key, F.explode(flows_column(text)).alias("e")).select(key, "e.*")
    whole = F.when(F.col("qualifier") == "", F.col("target")).otherwise(F.concat_ws(".", "qualifier", "target"))
    kind = F.when(F.col("param_index").isNotNull(), "data_flow").otherwise(call_kind(whole, F.col("literal")))
    named = F.when(kind.isin("emit", "listen"), F.coalesce("literal", "target")).otherwise(F.col("target"))
    return rows.select(key, kind.alias("kind"), named.alias("target"), "qualifier", "line", "param_index", "argument", "defined")
