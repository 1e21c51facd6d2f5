"""Every query that has SQL gives the SQL's rows; the others run, and other modules hold what they do against plain Python."""

import math

import duckdb
import pytest
from tessera import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    try:
        x = float(v)
    except (TypeError, ValueError):
        return str(v)
    return "nan" if math.isnan(x) else f"{x:.9g}"


def test_no_sql_is_empty():
    """On the tables that results are compared on, every SQL has rows, so that none agrees on nothing."""
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    assert [n for n, sql in core.oracle_sql().items() if con.execute(f"SELECT count(*) FROM ({sql})").fetchone()[0] == 0] == []


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, duck, sf, name):
    df = core.queries()[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert want
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, sf, name):
    df = core.queries()[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
