"""Chat formatting of logged conversations, without snapshots of longer ones.

Logs often hold a conversation several times, as it grew.  A rolling hash of the
turns so far identifies every prefix; a conversation whose whole hash is a proper prefix of
another goes, and of equal conversations the one with the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, scope, stored

TURN = "<|{role}|>\n{text}<|end|>\n"
#: Pieces of conversations that span partitions, up to which they are broadcast.
BROADCAST_ROWS = 500_000
#: Turns in one part of a rendered conversation.
PART = 4096


def prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id, nth, last, role, text, h, g``: the turns in order, with the hash of all up to them, as a stored table.

    ``h, g`` are exclusive-ors of hashes of ``(nth, role, text)``, 128 bits in all.  Turns with
    equal numbers follow by role and text.

    Turns are range-partitioned, so that a conversation with a great part of all turns is spread over many
    tasks: each partition numbers and sums its own piece, and the pieces before it are added.
    """
    ranged = turns.select("conv_id", "turn", "role", "text").repartitionByRange("conv_id", "turn", "role", "text")
    ranged = stored(ranged.withColumn("p", F.spark_partition_id()), "turns")
    pieces = ranged.groupBy("conv_id", "p").agg(F.count("*").alias("n"))
    wide = pieces.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("conv_id").alias("_c"))
    before = Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    later = F.max("p").over(Window.partitionBy("conv_id")) > F.col("p")
    split = pieces.join(wide, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    split = split.select("conv_id", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), later.alias("goes_on"))
    split = bounded(stored(split.select(F.col("conv_id").alias("_c"), F.col("p").alias("_p"), "base", "goes_on"), "turn-pieces", 1), BROADCAST_ROWS)
    piece = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("p") == F.col("_p"))
    order = Window.partitionBy("p", "conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = ranged.join(split, piece, "left").select(
        "conv_id", "p", "turn", "role", "text",
        (F.coalesce("base", F.lit(0)) + F.row_number().over(order)).alias("nth"),
        (F.lead(F.lit(1)).over(order).isNull() & ~F.coalesce("goes_on", F.lit(False))).alias("last"),
    )
    # a null must not hash as its neighbour's empty string does
    fields = ["nth", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    hashed = numbered.withColumn("h1", F.xxhash64(F.lit(1), *fields)).withColumn("g1", F.xxhash64(F.lit(2), *fields))
    rolled = hashed.select("conv_id", "p", "nth", "last", "role", "text", F.bit_xor("h1").over(so_far).alias("h"), F.bit_xor("g1").over(so_far).alias("g"))
    rolled = stored(rolled, "piece-prefixes")
    ends = rolled.join(split, piece, "left_semi").groupBy("conv_id", "p").agg(F.max_by(F.struct("h", "g"), "nth").alias("e"))
    ends = ends.select(F.col("conv_id").alias("_c"), F.col("p").alias("_p"), *[F.coalesce(F.bit_xor(f"e.{c}").over(before), F.lit(0)).alias(f"{c}0") for c in "hg"])
    ends = bounded(stored(ends, "piece-ends", 1), BROADCAST_ROWS)
    whole = [F.col(c).bitwiseXOR(F.coalesce(f"{c}0", F.lit(0))).alias(c) for c in "hg"]
    return rolled.join(ends, piece, "left").select("conv_id", "nth", "last", "role", "text", *whole)


def maximal(rolled: DataFrame) -> DataFrame:
    """``conv_id, n_turns, n_copies`` of the conversations of :func:`prefixes` that prefix no longer one, each once."""
    inner = rolled.where("not last").select("nth", "h", "g").distinct()
    whole = rolled.where("last").groupBy("nth", "h", "g").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    kept = whole.join(inner, ["nth", "h", "g"], "left_anti")
    return kept.select("conv_id", F.col("nth").cast("long").alias("n_turns"), "n_copies")


def rendered_turn(role: Column, text: Column, template: str = TURN) -> Column:
    before, between, after = template.replace("{role}", "\0").replace("{text}", "\0").split("\0")
    return F.concat(F.lit(before), F.coalesce(role, F.lit("")), F.lit(between), F.coalesce(text, F.lit("")), F.lit(after))


def render(turns: DataFrame, template: str = TURN, part: int = PART) -> DataFrame:
    """``conv_id, part, n_turns, n_copies, rendered``: maximal conversations as text.

    A conversation of more than ``part`` turns is rendered in as many rows as it takes.  Null
    roles and texts render as empty; turns with a null conv_id are one conversation; repeated rows are
    turns of their own; extra columns are ignored; an empty table gives no rows.  A text of any length is one turn.
    """
    with scope(turns.sparkSession) as keep:
        rolled = keep(stored(prefixes(turns), "prefixes"))
        kept = keep(stored(maximal(rolled), "maximal"))
    one = rolled["conv_id"].eqNullSafe(kept["conv_id"])
    lines = rolled.join(kept, one).select(
        rolled["conv_id"], "n_turns", "n_copies", "nth", F.floor((F.col("nth") - 1) / part).alias("part"), rendered_turn(F.col("role"), F.col("text"), template).alias("line")
    )
    parts = lines.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("nth", "line"))).alias("ls"))
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("ls.line"), "").alias("rendered"))


def op7_chat(turns: DataFrame) -> DataFrame:
    """:func:`render` with the default template."""
    return render(turns)


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS nth, role, text FROM conversations
), s AS (
  SELECT conv_id, nth, string_agg(coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n'), '')
    OVER (PARTITION BY conv_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre, count(*) OVER (PARTITION BY conv_id) AS n FROM t
), w AS (SELECT pre, n, min(conv_id) AS conv_id, count(*) AS n_copies FROM s WHERE nth = n GROUP BY pre, n),
k AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.pre = w.pre AND s.nth < s.n))
SELECT k.conv_id, CAST((t.nth - 1) // 4096 AS BIGINT) AS part, k.n AS n_turns, k.n_copies,
  string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY t.nth) AS rendered
FROM k JOIN t ON k.conv_id IS NOT DISTINCT FROM t.conv_id GROUP BY ALL
"""
