"""Every registered query against its DuckDB counterpart on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
ORACLE = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def simple(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if v != v else round(float(v), 9) + 0.0
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLE])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([simple(r[c]) for c in columns] for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = sorted(([simple(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=repr)
    assert got == expected


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_all_rules_occur_and_the_bridge_is_exact(spark):
    from triledger.catalog import run_of

    r = run_of(spark, FOLDER)
    assert {g.rule for g in r.groups.select("rule").distinct().collect()} == set(range(1, 24))
    assert r.bridge.filter("unexplained <> 0").count() == 0
    # Every ledger row with a ticket is in exactly one group.
    assert r.groups.agg({"ledger_rows": "sum"}).first()[0] == r.ledger.filter("gid is not null").count()
