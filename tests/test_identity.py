"""Plans of renames and merges over several tables: counts, conflicts, refusals and a failure halfway."""

import uuid

import pytest
from tessera import session
from tessera.operators import identity
from tessera.operators.identity import IdentityError, Store

STORES = {"files": Store("project_id", ("path",)), "notes": Store("owner"), "edges": Store("project_id", ("a", "b"))}


@pytest.fixture
def tables(spark):
    made = identity.TableSet(spark, f"{session.shared_folder(spark)}/identity-{uuid.uuid4().hex}")
    made.write({
        "workspaces": spark.createDataFrame([("p", "/a/"), ("q", "/a"), ("r", "/b")], "project_id string, root string"),
        "aliases": spark.createDataFrame([("old", "p"), ("gone", "r")], "retired string, target string"),
        "files": spark.createDataFrame([("p", "x", 1), ("p", "y", 2), ("q", "y", 2), ("q", "z", 3), ("r", "x", 9)], "project_id string, path string, size long"),
        "notes": spark.createDataFrame([("p", 1), ("p", 1), ("r", 2)], "owner string, n long"),
        "edges": spark.createDataFrame([("r", 1, 2, 0.5)], "project_id string, a long, b long, w double"),
        "other": spark.createDataFrame([("p",)], "project_id string"),
    })
    return made


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_merge_moves_all_tables_at_once(spark, tables):
    before = {n: rows(d) for n, d in tables.tables().items()}
    plan = identity.planned(STORES, tables.tables(), "merge", "p", "q")
    assert plan.counts == (("edges", 0), ("files", 2), ("notes", 2)) and plan.conflicts == ()
    assert {n: rows(d) for n, d in tables.tables().items()} == before  # a plan changes nothing
    number, folders = tables.manifest.read()
    identity.applied(tables, STORES, plan)
    after = tables.tables()
    assert rows(after["files"]) == [("q", "x", 1), ("q", "y", 2), ("q", "z", 3), ("r", "x", 9)]
    assert rows(after["notes"]) == [("q", 1), ("q", 1), ("r", 2)] and rows(after["other"]) == [("p",)]
    assert rows(after["workspaces"]) == [("q", "/a"), ("r", "/b")]
    assert rows(after["aliases"]) == [("gone", "r"), ("old", "q"), ("p", "q")]
    assert tables.manifest.read()[0] == number + 1 and tables.manifest.read()[1]["edges"] == folders["edges"]  # what isn't touched stays
    with pytest.raises(IdentityError, match="SOURCE_RETIRED"):
        identity.planned(STORES, after, "merge", "p", "q")


def test_a_rename(spark, tables):
    identity.applied(tables, STORES, identity.planned(STORES, tables.tables(), "rename", "r", "s"))
    after = tables.tables()
    assert ("s", "x", 9) in rows(after["files"]) and rows(after["edges"]) == [("s", 1, 2, 0.5)] and ("s", "/b") in rows(after["workspaces"]) and ("r", "s") in rows(after["aliases"])


@pytest.mark.parametrize("mode, source, target, why", [
    ("rename", "nobody", "t", "SOURCE_NOT_FOUND"), ("rename", "p", "q", "TARGET_EXISTS"), ("merge", "p", "nobody", "TARGET_NOT_FOUND"), ("merge", "p", "r", "ROOT_MISMATCH"),
    ("merge", "old", "p", "SOURCE_RETIRED"), ("rename", "p", "gone", "TARGET_RETIRED"), ("move", "p", "q", "UNKNOWN_MODE"),
])
def test_refusals(tables, mode, source, target, why):
    with pytest.raises(IdentityError, match=why):
        identity.planned(STORES, tables.tables(), mode, source, target)


def test_conflicts_and_changed_plans_are_refused(spark, tables):
    plan = identity.planned(STORES, tables.tables(), "merge", "p", "q")
    again = identity.planned(STORES, {n: d.repartition(3) for n, d in tables.tables().items()}, "merge", "p", "q")
    assert again == plan  # whatever the order of rows
    tables.write({"files": spark.createDataFrame([("p", "y", 2), ("q", "y", 7), (None, "y", 1)], "project_id string, path string, size long")})
    with pytest.raises(IdentityError, match="PLAN_CHANGED"):
        identity.applied(tables, STORES, plan)
    now = identity.planned(STORES, tables.tables(), "merge", "p", "q")
    assert now.conflicts == (("files", 1),)
    before = {n: rows(d) for n, d in tables.tables().items()}
    with pytest.raises(IdentityError, match="CONFLICTS"):
        identity.applied(tables, STORES, now)
    assert {n: rows(d) for n, d in tables.tables().items()} == before


def test_a_failure_halfway_leaves_all_as_it_was(tables, monkeypatch):
    plan = identity.planned(STORES, tables.tables(), "merge", "p", "q")
    before, number = {n: rows(d) for n, d in tables.tables().items()}, tables.manifest.read()[0]
    whole = identity.moved

    def broken(df, store, *rest):
        if store.column == "owner":
            raise OSError("lost")
        return whole(df, store, *rest)

    monkeypatch.setattr(identity, "moved", broken)  # read in the driver
    with pytest.raises(OSError):
        identity.applied(tables, STORES, plan)
    staged = tables.staged

    def torn(new):
        staged({"files": new["files"]})
        raise OSError("lost")

    monkeypatch.setattr(identity, "moved", whole)
    monkeypatch.setattr(tables, "staged", torn)
    with pytest.raises(OSError):
        identity.applied(tables, STORES, plan)
    assert {n: rows(d) for n, d in tables.tables().items()} == before and tables.manifest.read()[0] == number
    monkeypatch.setattr(tables, "staged", staged)
    identity.applied(tables, STORES, plan)
