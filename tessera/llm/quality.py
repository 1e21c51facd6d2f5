"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document.  The ledger keeps the measured
values and one failure bit for each rule; a policy is a named, versioned mask over
these bits.  Changing a policy or asking what a rule costs reads the ledger alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 8
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_stutters")

#: Bit of each rule in the ledger; a rule keeps its bit for good.
RULES: dict[str, int] = {
    "too_short": 0,
    "repeated_windows": 1,
    "symbols": 2,
    "duplicate_lines": 3,
    "word_length": 4,
    "capitals": 5,
    "exclamations": 6,
    "stutters": 7,
}
BASE = ("too_short", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """Rejects a document that fails any of its rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return reduce(lambda m, r: m | 1 << RULES[r], self.rules, 0)


POLICIES = {p.version: p for p in (Policy("base", BASE), Policy("v1", tuple(RULES)))}


def _predicates(m: Column) -> dict[str, Column]:
    words = m["n_words"]
    return {
        "too_short": words < 20,
        "repeated_windows": 100 * m["n_repeat_words"] > 30 * words,
        "symbols": 10 * m["n_symbols"] > words,
        "duplicate_lines": 2 * m["n_dup_lines"] > m["n_lines"],
        "word_length": (m["word_chars"] < 2 * words) | (m["word_chars"] > 20 * words),
        "capitals": 2 * m["n_upper"] > m["n_letters"],
        "exclamations": 10 * m["n_bangs"] > 3 * words,
        "stutters": 2 * m["n_stutters"] > words,
    }


def _repeated(ids: np.ndarray) -> int:
    """Words that lie in a window of eight words found twice or more.

    Windows get exact ranks by doubling: pairs, then fours, then eights.
    """
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < WINDOW:
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(rank)[rank] > 1
    if not twice.any():
        return 0
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The values of :data:`MEASURES` for one text; null and empty give zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    first: dict[bytes, int] = {}
    ids = np.fromiter((first.setdefault(w, len(first)) for w in words), np.int64, len(words))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    joined = b"".join(words)
    codes = np.frombuffer(joined, np.uint8)
    counts = np.bincount(codes, minlength=256)
    upper = int(counts[65:91].sum())
    return (
        len(words),
        int(len(joined) - counts[0x80:0xC0].sum()),  # continuation bytes start no code point
        int(sum(counts[ord(c)] for c in SYMBOLS)),
        len(lines) - len(set(lines)),
        _repeated(ids),
        len(lines),
        upper,
        upper + int(counts[97:123].sum()),
        int(counts[ord("!")]),
        int((ids[1:] == ids[:-1]).sum()),
    )


_SCHEMA = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


def _measure_column(text: Column) -> Column:
    @F.arrow_udf(_SCHEMA)
    def run(batch: pa.Array) -> pa.Array:
        rows = np.array([measure(x.as_py()) for x in batch], np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(MEASURES))

    return run.asNondeterministic()(text)  # else a filter on the ledger runs it twice


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``measures`` and a long ``fail_bits``.

    Rows are independent: repeated rows each get the same ledger entry, null and
    empty texts measure as zero and fail ``too_short``, texts of any length are measured whole, an empty table stays empty.  Other columns pass
    through, but for columns named ``measures`` or ``fail_bits``, which are replaced.
    """
    out = docs.withColumn("measures", _measure_column(F.col(text)))
    tests = _predicates(F.col("measures"))
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(tests[r], F.lit(1 << b)).otherwise(0) for r, b in RULES.items()))
    return out.withColumn("fail_bits", bits.cast("long"))


def verdict(policy: Policy | str, bits: str = "fail_bits") -> Column:
    """True where the policy keeps a document."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) == 0


def sole_rule(policy: Policy | str, bits: str = "fail_bits") -> Column:
    """The rule of a policy without which it would keep a document that it rejects; null where there is none."""
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    failed = F.col(bits).bitwiseAND(F.lit(policy.mask))
    return F.coalesce(*[F.when(failed == 1 << RULES[r], F.lit(r)) for r in policy.rules])


def ablations(ledger_df: DataFrame, policy: Policy | str) -> DataFrame:
    """For each rule of a policy: ``rule, failed, only_this``.

    ``only_this`` counts the documents that would be kept without the rule.  The
    ledger is first reduced to its distinct bit patterns, at most two to the number
    of rules, so that the rest costs nothing.
    """
    policy = POLICIES[policy] if isinstance(policy, str) else policy
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r]).cast("long").alias("bit")) for r in policy.rules])
    rules = ledger_df.sparkSession.range(1).select(F.inline(pairs))
    return (
        rules.hint("broadcast").join(patterns, F.col("bits").bitwiseAND(F.col("bit")) != 0, "left")
        .groupBy("rule")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("only_this"),
        )
    )


def op4_quality(docs: DataFrame, policy: Policy | str = "v1") -> DataFrame:
    """The ledger's digest: one row for each row of ``docs``; nulls, repeats and empty tables as in :func:`ledger`.

    ``sole_rule`` is what an ablation of the policy counts: see :func:`sole_rule`.
    """
    base = POLICIES["base"]
    return (
        ledger(docs.select("doc_id", "text"))
        .select("doc_id", "measures.*", "fail_bits", (~verdict(base)).alias("base_failed"), (verdict(base) & verdict(policy)).alias("kept"), sole_rule(policy).alias("sole_rule"))
    )


OP4_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, unnest(range(len(ws) - 7)) AS i, unnest(list_transform(range(len(ws) - 7), lambda k: array_to_string(ws[k + 1 : k + 8], ' '))) AS win FROM w WHERE len(ws) >= 8),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS c FROM i) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, ws, text FROM w),
m AS (SELECT l.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_upper,
  CAST(len(regexp_extract_all(text, '[A-Za-z]')) AS BIGINT) AS n_letters, CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_bangs, CAST(len(list_filter(range(1, len(ws)), lambda k: ws[k] = ws[k + 1])) AS BIGINT) AS n_stutters FROM l LEFT JOIN r ON r.doc_id = l.doc_id),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT
  + 32 * (2 * n_upper > n_letters)::INT + 64 * (10 * n_bangs > 3 * n_words)::INT + 128 * (2 * n_stutters > n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT *, fail_bits & 3 > 0 AS base_failed, fail_bits = 0 AS kept,
  CASE fail_bits WHEN 1 THEN 'too_short' WHEN 2 THEN 'repeated_windows' WHEN 4 THEN 'symbols' WHEN 8 THEN 'duplicate_lines' WHEN 16 THEN 'word_length' WHEN 32 THEN 'capitals' WHEN 64 THEN 'exclamations' WHEN 128 THEN 'stutters' END AS sole_rule FROM b
"""
