"""Joins that are not plain equalities, each by way of an equality that shuffles well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import scope, stored


def path_prefixes(path: Column) -> Column:
    """The path itself and all its parent folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(rows: DataFrame, path: str, key: str, roots: DataFrame) -> DataFrame:
    """``key, project_id``: the project with the longest root that the path is in; a tie of two projects drops the row.

    ``roots(root, project_id)``.  Every parent folder of a path is looked up by equality.
    """
    at = rows.select(key, F.explode(F.array_distinct(path_prefixes(F.col(path)))).alias("root"))
    found = at.join(roots.distinct(), "root").select(key, "project_id", F.length("root").alias("n"))
    best = found.groupBy(key, "n").agg(F.min("project_id").alias("project_id"), F.count_distinct("project_id").alias("projects"))
    top = best.groupBy(key).agg(F.max(F.struct("n", "projects", "project_id")).alias("b"))
    return top.where("b.projects = 1").select(key, F.col("b.project_id").alias("project_id"))


def carried(rows: DataFrame, by: str, order: list[str], value: str, first: str = "_before", last: str = "_after") -> DataFrame:
    """``rows`` with the last ``value`` that is not null at or before each row of its ``by``, and the first at or after it.

    Rows are range-partitioned by ``by`` and ``order`` into pieces, each of which is one window; what a piece has first and last is carried over
    the pieces, which are few.  So a key with a large part of all rows is spread over many tasks.
    """
    pieces = rows.repartitionByRange(by, *order).withColumn("_piece", F.spark_partition_id())
    with scope(rows.sparkSession) as keep:
        pieces = keep(stored(pieces, "pieces"))
        some = F.when(F.col(value).isNotNull(), F.struct(F.col(by).alias("k"), F.col(value).alias("v")))
        place = F.struct(by, *order)
        ends = pieces.where(F.col(value).isNotNull()).groupBy("_piece").agg(F.min_by(some, place).alias("head"), F.max_by(some, place).alias("tail"))
        ends = stored(ends, "piece-ends", 1)
        whole = stored(pieces.groupBy("_piece").agg(F.lit(1).alias("_one")).join(ends, "_piece", "left"), "piece-ends", 1)
        over = Window.orderBy("_piece")  # as many rows as there are pieces
        back = F.last("tail", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
        on = F.last("head", ignorenulls=True).over(Window.orderBy(F.desc("_piece")).rowsBetween(Window.unboundedPreceding, -1))
        carry = keep(stored(whole.select(F.col("_piece").alias("_p"), back.alias("_back"), on.alias("_on")), "carried", 1))
    # both look back, from either end: a frame that ends with the piece is gone through anew for each row
    inside, turned = (Window.partitionBy("_piece").orderBy(*[c(x) for x in (by, *order)]).rowsBetween(Window.unboundedPreceding, 0) for c in (F.asc, F.desc))
    before, after = F.last(some, ignorenulls=True).over(inside), F.last(some, ignorenulls=True).over(turned)
    out = pieces.withColumn("_b", before).withColumn("_a", after).join(F.broadcast(carry), F.col("_piece") == F.col("_p"))
    mine = lambda c, other: F.when(F.col(f"{c}.k").eqNullSafe(F.col(by)) & F.col(c).isNotNull(), F.col(f"{c}.v")).when(F.col(f"{other}.k").eqNullSafe(F.col(by)) & F.col(other).isNotNull(), F.col(f"{other}.v"))
    return out.withColumn(first, mine("_b", "_back")).withColumn(last, mine("_a", "_on")).drop("_b", "_a", "_p", "_back", "_on", "_piece")


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` at or before it, or else of the first after it.

    Both sides are merged in order and the value carried on by :func:`carried`, so no pairs are made and no key is one task.  ``value`` must not be null.
    Of rows of ``right`` with one time the largest value counts before, and the smallest after.
    """
    cols = left.columns
    l_ = left.withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_left", F.lit(1))
    r_ = right.select(by, at, F.col(value).alias("_v")).withColumn("_left", F.lit(0))
    both = carried(l_.unionByName(r_, allowMissingColumns=True), by, [at, "_left", "_v"], "_v")
    return both.where("_left = 1").withColumn("anchor", F.coalesce("_before", "_after")).select(*cols, "anchor")


def co_occurring(rows: DataFrame, key: str, id_: str, at: str, seconds: int, most: int) -> DataFrame:
    """``id, peer, n``: up to ``most`` latest earlier rows of the same key within ``seconds``.

    These are the rows just before each in order of time and id, so that a window looks back and nothing is joined.
    """
    w = Window.partitionBy(key).orderBy("us", id_)
    base = rows.select(F.col(key), F.col(id_), F.unix_micros(at).alias("us")).where(F.col(key).isNotNull())
    back = F.array(*[F.struct(F.lag(id_, i).over(w).alias("peer"), F.lag("us", i).over(w).alias("peer_us"), F.lit(i).alias("n")) for i in range(1, most + 1)])
    near = base.select(key, id_, "us", back.alias("back")).select(key, id_, "us", F.explode("back").alias("b"))
    return near.where(F.col("us") - F.col("b.peer_us") <= seconds * 1_000_000).select(key, id_, "b.peer", "b.n")


def overlapping(a: DataFrame, b: DataFrame, by: str, slack: int, width: int = 64) -> DataFrame:
    """Pairs ``a_id, b_id`` of one file whose line ranges, ``b``'s widened by ``slack``, meet.

    Ranges are cut into tiles of ``width`` lines and a pair is kept in the first tile that both are in.
    """
    tiles = lambda lo, hi: F.sequence(F.floor(lo / width), F.floor(hi / width))
    x = a.select(by, F.col("id").alias("a_id"), F.col("line_start").alias("s"), F.col("line_end").alias("e"), F.explode(tiles(F.col("line_start"), F.col("line_end"))).alias("tile"))
    lo, hi = F.col("line_start") - slack, F.col("line_end") + slack
    y = b.select(by, F.col("id").alias("b_id"), lo.alias("s2"), hi.alias("e2"), F.explode(tiles(lo, hi)).alias("tile"))
    met = x.join(y, [by, "tile"]).where("s <= e2 and s2 <= e")
    return met.where(F.col("tile") == F.floor(F.greatest("s", "s2") / width)).select(by, "a_id", "b_id")


def latest(df: DataFrame, id_: str, order: list[Column]) -> DataFrame:
    """The last version of each id."""
    nth = F.row_number().over(Window.partitionBy(id_).orderBy(*order))
    return df.withColumn("_n", nth).where("_n = 1").drop("_n")


def upserted(table: DataFrame, changes: DataFrame, id_: str) -> DataFrame:
    """``table`` with rows of ``changes``, one for each id, in place of those with the same id."""
    return table.join(changes.select(id_), id_, "left_anti").unionByName(changes)


def merged_edges(edges: DataFrame) -> DataFrame:
    """One edge for each ends and type: the largest weight, and the last evidence that is not null; loops go."""
    return edges.where("from_id <> to_id").groupBy("from_id", "to_id", "edge_type").agg(
        F.max("weight").alias("weight"), F.max(F.when(F.col("evidence").isNotNull(), F.struct("seq", "evidence")))["evidence"].alias("evidence")
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, state``: new, deleted or modified (a later time or another size) between two listings ``path, mtime, size``."""
    o = old.select("path", F.col("mtime").alias("om"), F.col("size").alias("os"))
    both = new.select("path", "mtime", "size").join(o, "path", "full_outer")
    state = F.when(F.col("os").isNull(), "new").when(F.col("size").isNull(), "deleted").when((F.col("mtime") > F.col("om")) | (F.col("size") != F.col("os")), "modified")
    return both.select("path", state.alias("state")).where("state is not null")


def renamed_projects(df: DataFrame, aliases: DataFrame, column: str = "project_id") -> DataFrame:
    """``df`` with retired project ids replaced by those that ``aliases(retired, target)`` gives."""
    a = aliases.select(F.col("retired").alias("_r"), F.col("target").alias("_t")).dropDuplicates(["_r"])
    return df.join(a, F.col(column) == F.col("_r"), "left").withColumn(column, F.coalesce("_t", column)).drop("_r", "_t")


def rename_conflicts(df: DataFrame, aliases: DataFrame, key: str, column: str = "project_id") -> DataFrame:
    """Keys that more than one row would have after renaming."""
    return renamed_projects(df, aliases, column).groupBy(column, key).agg(F.count("*").alias("n")).where("n > 1")


def generation_cleanup(rows: DataFrame, active: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows of generations that are neither active nor kept: what a cleanup deletes."""
    return rows.join(active, ["project_id", "generation_id"], "left_anti").join(kept, ["project_id", "generation_id"], "left_anti")


GENERATION = ("project_id", "generation_id")


def copied_forward(rows: DataFrame, source: DataFrame, target: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of ``files(project_id, path)`` in each project's ``source`` generation, as rows of its ``target`` generation."""
    old = rows.join(source.select(*GENERATION), list(GENERATION), "left_semi").join(files.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")
    new = target.select("project_id", F.col("generation_id").alias("_g"))
    return old.join(new, "project_id").withColumn("generation_id", F.col("_g")).select(*rows.columns)


def written(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """``rows`` with those of ``changed`` in place of all rows of the same project, generation and path."""
    key = [*GENERATION, "path"]
    return rows.join(changed.select(*key).distinct(), key, "left_anti").unionByName(changed)


def marked_stale(files: DataFrame, failed: DataFrame, good: DataFrame) -> DataFrame:
    """``files`` with ``is_stale`` and ``last_good``: those of ``failed(project_id, path)`` keep the project's last good generation, ``good``."""
    bad = failed.select("project_id", "path", F.lit(True).alias("_bad")).distinct()
    at = good.select("project_id", F.col("generation_id").alias("_good"))
    out = files.join(bad, ["project_id", "path"], "left").join(at, "project_id", "left")
    stale = F.coalesce("_bad", F.lit(False))
    return out.withColumn("is_stale", stale).withColumn("last_good", F.when(stale, F.col("_good")).otherwise(F.col("generation_id"))).drop("_bad", "_good")


def activated(pointers: DataFrame, generations: DataFrame) -> DataFrame:
    """``project_id, generation_id``: each project's pointer moved to its newest complete generation that was built on the one it points to.

    ``generations(project_id, generation_id, status, expected)``; a generation whose ``expected`` is no longer active is lost.
    """
    now = pointers.select("project_id", F.col("generation_id").alias("_now"))
    ready = generations.join(now, "project_id").where((F.col("status") == "complete") & F.col("expected").eqNullSafe(F.col("_now")))
    best = ready.groupBy("project_id").agg(F.max("generation_id").alias("_new"))
    return pointers.join(best, "project_id", "left").select("project_id", F.coalesce("_new", "generation_id").alias("generation_id"))


def orphans(tables: list[DataFrame], generations: DataFrame) -> DataFrame:
    """``project_id, generation_id`` of rows of any table whose generation is not known."""
    rows = tables[0].select(*GENERATION)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(*GENERATION))
    known = generations.select(*GENERATION, F.lit(1).alias("_known"))
    return rows.distinct().join(known, list(GENERATION), "left").where("_known is null").select(*GENERATION)


def appended(log: DataFrame, more: DataFrame) -> DataFrame:
    """A log with more entries; actors that are not named are unknown."""
    return log.unionByName(more.withColumn("actor", F.coalesce("actor", F.lit("unknown"))))


def logged(log: DataFrame, project: object, limit: int = 100) -> DataFrame:
    """A project's newest entries."""
    return log.where(F.col("project_id") == F.lit(project)).orderBy(F.col("at").desc(), F.col("id").desc()).limit(limit)


def decided(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals with the first decision (approved or rejected) on each that is pending; others stay as they are.  ``decisions(id, status, at)``."""
    first = decisions.where(F.col("status").isin("approved", "rejected")).groupBy(F.col("id").alias("_i")).agg(F.min(F.struct("at", "status")).alias("d"))
    out = proposals.join(first, F.col("id") == F.col("_i"), "left")
    due = (F.col("status") == "pending") & F.col("d").isNotNull()
    return out.withColumn("decided_at", F.when(due, F.col("d.at")).otherwise(F.col("decided_at"))).withColumn("status", F.when(due, F.col("d.status")).otherwise(F.col("status"))).drop("_i", "d")


def pending(proposals: DataFrame, project: object) -> DataFrame:
    """A project's open proposals, newest first."""
    return proposals.where((F.col("status") == "pending") & (F.col("project_id") == F.lit(project))).orderBy(F.col("created_at").desc(), F.col("id").desc())


def handed_over(handoffs: DataFrame, accepts: DataFrame, now: Column) -> DataFrame:
    """Open handoffs accepted by their target, or by anyone where they name none; those that are past their time have expired.  ``accepts(id, agent)``."""
    own = handoffs.join(accepts.select(F.col("id").alias("_i"), "agent"), F.col("id") == F.col("_i"), "left")
    fit = F.col("agent").isNotNull() & (F.col("target").isNull() | (F.col("target") == F.col("agent")))
    best = own.withColumn("_by", F.when(fit, F.col("agent"))).groupBy(*handoffs.columns).agg(F.min("_by").alias("_by"))
    status = F.when(F.col("status") != "open", F.col("status")).when(F.col("expires_at") <= now, "expired").when(F.col("_by").isNotNull(), "accepted").otherwise("open")
    return best.select(*[c for c in handoffs.columns if c != "status"], status.alias("status"), F.when(status == "accepted", F.col("_by")).alias("accepted_by"))


def cache_stats(cache: DataFrame, log: DataFrame) -> DataFrame:
    """One row ``entries, bytes, hit_rate, avg_dimensions`` of a cache ``key, size`` in bytes of 4-byte floats, and of the keys asked for."""
    kept = cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    asked = log.select("key").join(cache.select("key", F.lit(1).alias("hit")).dropDuplicates(["key"]), "key", "left").agg(F.count("*").alias("asked"), F.count("hit").alias("hits"))
    rate = F.when(F.col("asked") > 0, F.col("hits") / F.col("asked")).otherwise(0.0)
    return kept.crossJoin(asked).select("entries", "bytes", F.round(rate, 6).alias("hit_rate"), F.when(F.col("entries") > 0, F.col("bytes") / F.col("entries") / 4).otherwise(0.0).alias("avg_dimensions"))  # both are one row


def active_only(rows: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of each project's active generation."""
    return rows.join(active.select("project_id", "generation_id"), ["project_id", "generation_id"], "left_semi")


def invalidated(cache: DataFrame, changed: list[str]) -> DataFrame:
    """Cached searches none of whose results are in a changed file."""
    def within(part: str) -> Column:
        return F.exists("files", lambda f: F.contains(f, F.lit(part)))

    hit = F.lit(False)
    for c in changed:
        hit = hit | within(c)
    return cache.where(~hit)


def alive(cache: DataFrame, since: Column) -> DataFrame:
    """Entries that were used after ``since``: what a time to live leaves."""
    return cache.where(F.col("last_accessed") > since)


def evicted(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries that were used last."""
    return cache.orderBy(F.col("last_accessed").desc(), "key").limit(most)
