"""Every query against its SQL in another engine, row by row."""

import math
import os

import duckdb
import pytest

from graphloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return repr(v + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [[plain(v) for v in (row[c] for c in sorted(df.columns))] for row in df.collect()]
    found = db.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    place = [columns.index(c) for c in sorted(columns)]
    expected = [[plain(row[i]) for i in place] for row in found.fetchall()]
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_localize_has_provenance(spark):
    rows = catalog.QUERIES["localize"](spark, SF).collect()
    assert rows and all(r["lists"] for r in rows)
    for r in rows:
        score = sum(1 / (40 + int(x.split(":")[1])) for x in r["lists"].split(","))
        assert abs(score - r["score"]) < 1e-8
