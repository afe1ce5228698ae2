"""Every registered query against its SQL on the smallest fixture."""

import decimal
import os

import pytest

import __spark_entry__ as entry
from leafmill import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no fixture tables")


def plain(v):
    if isinstance(v, list):
        return str([plain(x) for x in v])
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return str(int(v)) if isinstance(v, int) and not isinstance(v, bool) else str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DIR}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    mine, theirs = plans.QUERIES[name](spark, DIR), duck.execute(plans.ORACLE_SQL[name])
    names = [d[0] for d in theirs.description]
    assert sorted(mine.columns) == sorted(names)
    assert rows_of(mine.columns, mine.collect()) == rows_of(names, theirs.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(plans.QUERIES) <= set(entry.queries())
