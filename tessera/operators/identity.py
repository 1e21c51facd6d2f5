"""Renaming and merging projects over all tables: a plan with a hash, and an application that only carries out that plan.

The tables of a set are folders that one manifest names.  An application writes new folders for the tables it touches and
swaps the manifest last, so that readers see all tables before or all after, and a failure leaves everything as it was.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.manifest import Manifest


class IdentityError(ValueError):
    """Why a plan is refused; the message is one of the codes below."""


@dataclass(frozen=True)
class Store:
    """A table's column of project ids, and the columns that are unique within a project; none if rows can't collide."""

    column: str
    key: tuple[str, ...] = ()


class TableSet:
    """Versioned tables at ``path``, with ``workspaces(project_id, root)`` and ``aliases(retired, target)`` among them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Put ``tables`` in place, beside those that are there."""
        number, folders = self.manifest.read({})
        self.manifest.commit(number, folders | self.staged(tables))

    def staged(self, tables: dict[str, DataFrame]) -> dict[str, str]:
        """Write ``tables`` to new folders that no manifest names yet."""
        folders = {name: f"{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folders[name]}")
        return folders

    def at(self, folders: dict[str, str]) -> dict[str, DataFrame]:
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in folders.items()}

    def tables(self) -> dict[str, DataFrame]:
        return self.at(self.manifest.read({})[1])


@dataclass(frozen=True)
class Plan:
    """What a rename or a merge would do: rows and conflicts of each store, and a hash of these and of all rows of both projects."""

    mode: str
    source: str
    target: str
    counts: tuple[tuple[str, int], ...]
    conflicts: tuple[tuple[str, int], ...]
    hash: str


def _roots(workspaces: DataFrame, aliases: DataFrame, mode: str, source: str, target: str) -> None:
    """Refuse what cannot be; a workspace is one row."""
    retired = {r.retired for r in aliases.where(F.col("retired").isin(source, target)).select("retired").distinct().collect()}
    roots = {r.project_id: r.root for r in workspaces.where(F.col("project_id").isin(source, target)).collect()}
    if mode not in ("rename", "merge"):
        raise IdentityError("UNKNOWN_MODE")
    if source in retired:
        raise IdentityError("SOURCE_RETIRED")
    if source not in roots:
        raise IdentityError("SOURCE_NOT_FOUND")
    if target in retired:
        raise IdentityError("TARGET_RETIRED")
    if mode == "rename" and target in roots:
        raise IdentityError("TARGET_EXISTS")
    if mode == "merge" and target not in roots:
        raise IdentityError("TARGET_NOT_FOUND")
    if mode == "merge" and roots[source].rstrip("/") != roots[target].rstrip("/"):
        raise IdentityError("ROOT_MISMATCH")


def _material(df: DataFrame, store: Store) -> list[str]:
    return [c for c in df.columns if c != store.column and c not in store.key]


def _met(df: DataFrame, store: Store, source: str, target: str) -> DataFrame:
    """Rows of the source whose key the target has too: the key, and whether ``same`` holds for all else."""
    values = F.struct(*(_material(df, store) or store.key))
    mine = df.where(F.col(store.column) == source).select(F.struct(*store.key).alias("key"), values.alias("mine"))
    theirs = df.where(F.col(store.column) == target).select(F.struct(*store.key).alias("key"), values.alias("theirs"))
    return mine.join(theirs, "key").select("key.*", F.col("mine").eqNullSafe(F.col("theirs")).alias("same"))


def counted(stores: dict[str, Store], tables: dict[str, DataFrame], mode: str, source: str, target: str) -> DataFrame:
    """``store, rows, conflicts, mark``: one row a store; ``mark`` changes with any row of either project, and not with their order."""
    parts = []
    for name in sorted(stores):
        store, df = stores[name], tables[name]
        both = df.where(F.col(store.column).isin(source, target))
        columns = sorted(df.columns)
        marks = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
        rows = both.agg(F.count_if(F.col(store.column) == source).alias("rows"), F.concat_ws("/", F.count("*").cast("string"), *marks).alias("mark"))
        clashes = _met(df, store, source, target).where("not same").agg(F.count("*").alias("conflicts")) if mode == "merge" and store.key else df.sparkSession.range(1).select(F.lit(0).cast("long").alias("conflicts"))
        parts.append(rows.crossJoin(clashes).select(F.lit(name).alias("store"), "rows", "conflicts", "mark"))  # one row each
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def planned(stores: dict[str, Store], tables: dict[str, DataFrame], mode: str, source: str, target: str) -> Plan:
    """The plan for the tables as they are; :class:`IdentityError` if there can be none."""
    _roots(tables["workspaces"], tables["aliases"], mode, source, target)
    found = sorted(counted(stores, tables, mode, source, target).collect())
    counts, conflicts = tuple((r.store, r.rows) for r in found), tuple((r.store, r.conflicts) for r in found if r.conflicts)
    text = json.dumps([1, mode, source, target, counts, conflicts, [r.mark for r in found]])
    return Plan(mode, source, target, counts, conflicts, hashlib.sha256(text.encode()).hexdigest())


def moved(df: DataFrame, store: Store, mode: str, source: str, target: str) -> DataFrame:
    """``df`` with the source's rows under the target; of rows that both have alike, one."""
    if mode == "merge" and store.key:
        same = _met(df, store, source, target).where("same").select(*[F.col(k).alias(f"_{k}") for k in store.key])
        gone = F.col(store.column) == source
        for k in store.key:
            gone = gone & F.col(k).eqNullSafe(F.col(f"_{k}"))
        df = df.join(same, gone, "left_anti")
    return df.withColumn(store.column, F.when(F.col(store.column) == source, target).otherwise(F.col(store.column)))


def applied(tables: TableSet, stores: dict[str, Store], plan: Plan) -> None:
    """Carry out ``plan``: refused if it has conflicts or if the tables no longer give the same one; all tables change at once or none does."""
    number, folders = tables.manifest.read({})
    now = tables.at(folders)
    if planned(stores, now, plan.mode, plan.source, plan.target).hash != plan.hash:
        raise IdentityError("PLAN_CHANGED")
    if plan.conflicts:
        raise IdentityError("CONFLICTS")
    touched = {name for name, n in plan.counts if n}
    new = {name: moved(now[name], stores[name], plan.mode, plan.source, plan.target) for name in sorted(touched)}
    workspaces, aliases = now["workspaces"], now["aliases"]
    if plan.mode == "rename":
        new["workspaces"] = workspaces.withColumn("project_id", F.when(F.col("project_id") == plan.source, plan.target).otherwise(F.col("project_id")))
    else:
        new["workspaces"] = workspaces.where(F.col("project_id") != plan.source)
    # what was retired for the source leads to the target from now on
    led = aliases.withColumn("target", F.when(F.col("target") == plan.source, plan.target).otherwise(F.col("target")))
    new["aliases"] = led.unionByName(tables.spark.createDataFrame([(plan.source, plan.target)], "retired string, target string"))
    tables.manifest.commit(number, folders | tables.staged(new))
