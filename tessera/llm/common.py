"""Helpers that the corpus operators share: scratch tables, keys and text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import discard, release, scope, scratch_path, stored, sweep

__all__ = ["ascii_lower", "bounded", "discard", "fresh", "release", "scope", "scratch_path", "stored", "sweep", "text_key"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Separators of white-space words, ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"

def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have at most ``rows`` rows.

    A larger one is returned as it is: the planner then shuffles both sides and
    adaptive execution splits hot keys.  ``df`` should be cheap to count.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_key(text: str = "text") -> Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.col(text))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` with underscores before them until no column of ``df`` has them, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
