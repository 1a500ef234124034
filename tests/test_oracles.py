"""Every query that has an oracle gives the rows of its SQL, over the smallest tables."""

from __future__ import annotations

import decimal

import duckdb
import pytest

from tallyweave.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, decimal.Decimal):
        return format(v, "f")
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rows = [[plain(r[c]) for c in cols] for r in df.collect()]
    found = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    expected = [[plain(r[names.index(c)]) for c in cols] for r in found.fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES) and len(catalog.QUERIES) > 150
