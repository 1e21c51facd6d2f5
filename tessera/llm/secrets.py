"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

A candidate is a long run of key characters.  For each character class a window slides
along the candidate; its Shannon entropy follows from character counts that change by one
character in and one out.  Windows over the class's threshold, joined where they overlap, are
spans, unless the allow-list knows the candidate or the class calls for a mix that it lacks.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")

_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # a shorter run fails whole, so the bound changes no match
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")  # ``LEAST`` or more
ASSIGN_CHARS, ACCESS_CHARS = 12, 18


@dataclass(frozen=True)
class CharClass:
    """Windows of ``width`` characters of ``alphabet`` with at least ``bits`` of entropy a character."""

    name: str
    alphabet: frozenset[str]
    width: int
    bits: float
    needs: tuple[str, ...]


_DIGIT, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    CharClass("hex", frozenset(_DIGIT + "abcdefABCDEF"), 24, 3.2, (_DIGIT, "abcdefABCDEF")),
    CharClass("alnum", frozenset(_DIGIT + _LOW + _UP), 20, 3.7, (_DIGIT, _LOW, _UP)),
    CharClass("lower", frozenset(_DIGIT + _LOW), 20, 3.7, (_DIGIT, _LOW)),
    CharClass("upper", frozenset(_DIGIT + _UP), 20, 3.7, (_DIGIT, _UP)),
    CharClass("base64", frozenset(_DIGIT + _LOW + _UP + "+/_-="), 24, 4.0, (_DIGIT, _LOW, _UP)),
)
#: A candidate, or a part of a path as long as one, that matches one of these whole is no secret.
ALLOW = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"sha(1|256|384|512)-[A-Za-z0-9+/_-]{27,86}={0,2}",  # integrity hash
    r"\d[\d/_=-]*",  # numbers and dates
    r"([A-Za-z]+[/_-])+[A-Za-z]+\d*",  # paths and names in words
)
#: Marks of made-up keys: what lies within ``REACH`` characters of one, in the same part of a path, is no secret.
MARKS, REACH = re.compile(r"EXAMPLE|example|placeholder|x{4,}|X{4,}"), 64
LEAST = 20


def dense_windows(text: str, width: int, bits: float) -> list[tuple[int, int]]:
    """Joined ``(start, end)`` of the windows with at least ``bits`` of entropy a character."""
    if len(text) < width:
        return []
    counts: dict[str, int] = {}
    weight = 0.0  # sum of c * log2(c) over the counts; the entropy is log2(width) - weight / width
    gain = [0.0] + [c * log2(c) for c in range(1, width + 2)]  # a character that comes in before one goes out
    most = (log2(width) - bits) * width + 1e-9
    spans: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        counts[c] = n + 1
        weight += gain[n + 1] - gain[n]
        if i >= width:
            n = counts[text[i - width]]
            counts[text[i - width]] = n - 1
            weight += gain[n - 1] - gain[n]
        if i >= width - 1 and weight <= most:
            start = i - width + 1
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((start, i + 1))
    return spans


def _allowed(word: str, allow: re.Pattern[str]) -> str:
    """A candidate with spaces in place of what the allow-list covers: no window reaches over a space."""
    gone = [m.span() for m in re.finditer("[^/]+", word) if m.end() - m.start() >= LEAST and allow.fullmatch(m.group())]
    for m in MARKS.finditer(word):
        end = word.find("/", m.end())
        gone.append((max(word.rfind("/", 0, m.start()) + 1, m.start() - REACH), min(end if end >= 0 else len(word), m.end() + REACH)))
    for a, b in gone:
        word = word[:a] + " " * (b - a) + word[b:]
    return word


def _entropy_spans(text: str, allow: re.Pattern[str]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        if word.isalpha() or allow.fullmatch(word):
            continue
        word = _allowed(word, allow)
        for c in CLASSES:
            at = 0
            while at < len(word):
                if word[at] not in c.alphabet:
                    at += 1
                    continue
                end = at
                while end < len(word) and word[end] in c.alphabet:
                    end += 1
                run = word[at:end]
                for a, b in dense_windows(run, c.width, c.bits):
                    if all(set(need).intersection(run[a:b]) for need in c.needs):
                        found.append((m.start() + at + a, m.start() + at + b))
                at = end
    joined: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
        else:
            joined.append((a, b))
    return joined


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each fixed kind; those that are too short go after matching."""
    return {
        "assign": [m.span() for m in _ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_CHARS],
        "access": [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS],
        "hex": [m.span() for m in _HEX.finditer(text)],
    }


def _outside(spans: list[tuple[int, int]], covered: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What is left of ``spans``, which are in order and apart, where none of ``covered``, in any order, lies."""
    out, covered, at = [], sorted(covered), 0
    for a, b in spans:
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        i = at
        while i < len(covered) and covered[i][0] < b:
            if a < covered[i][0]:
                out.append((a, covered[i][0]))
            a = max(a, covered[i][1])
            i += 1
        if a < b:
            out.append((a, b))
    return out


def _join(spans: dict[str, list[tuple[int, int]]]) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    rows = sorted((a, rank[k], k, b) for k, at in spans.items() for a, b in at)
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in rows)


def scan(text: str | None, allow: re.Pattern[str]) -> tuple[int, int, int, str, str]:
    """``n_assign, n_access, n_hex``, the base spans' SHA-256 and all spans of one text."""
    text = text or ""
    base = base_spans(text)
    extra = _outside(_entropy_spans(text, allow), [s for at in base.values() for s in at])
    digest = hashlib.sha256(_join(base).encode()).hexdigest()
    return len(base["assign"]), len(base["access"]), len(base["hex"]), digest, _join(base | {"entropy": extra})


_FOUND = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex")] + [T.StructField(n, T.StringType()) for n in ("base_sha256", "spans")]
)


def scan_column(text: Column, allow: tuple[str, ...] = ALLOW) -> Column:
    @F.arrow_udf(_FOUND)
    def run(batch: pa.Array) -> pa.Array:
        known = re.compile("|".join(f"(?:{p})" for p in allow) or r"(?!)")
        rows = [scan(x.as_py(), known) for x in batch]
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], _FOUND.names)

    return run.asNondeterministic()(text)


def secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """``docs`` with a struct ``found``: ``n_assign, n_access, n_hex, base_sha256, spans``.

    Spans are in code points, the end exclusive.  What a fixed span covers of an entropy span
    is left to it; the rest is given.  Rows are independent; null and empty texts have no spans; time and memory follow a
    text's length; an empty table stays empty.  A column named ``found`` is replaced, others pass through.
    """
    return docs.withColumn("found", scan_column(F.col("text"), allow))


def redacted(docs: DataFrame, allow: tuple[str, ...] = ALLOW, mark: str = "[secret]") -> DataFrame:
    """``docs`` with each span of ``text`` replaced by ``mark``; null texts stay null."""
    known = re.compile("|".join(f"(?:{p})" for p in allow) or r"(?!)")

    @F.arrow_udf(T.StringType())
    def run(batch: pa.Array) -> pa.Array:
        def clean(text: str | None) -> str | None:
            if text is None:
                return None
            spans = sorted({s for at in base_spans(text).values() for s in at} | set(_entropy_spans(text, known)))
            out, done = [], 0
            for a, b in spans:
                if b > done:
                    out += [text[done:a], mark] if a >= done else []
                    done = b
            return "".join(out) + text[done:]

        return pa.array([clean(x.as_py()) for x in batch], pa.string())

    return docs.withColumn("text", run(F.col("text")))


def op8_secrets(docs: DataFrame) -> DataFrame:
    """The counts, digest and spans of :func:`secrets` for each row."""
    return secrets(docs.select("doc_id", "text")).select("doc_id", "found.*")
