"""Every library query against its SQL, on the small driver tables."""

import math
import os

import pytest

import __spark_entry__
from kilnwork import queries as library

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows, columns):
    def value(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(repr([value(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got = library.QUERIES[name](spark, SF)
    want = duck.sql(library.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert plain([r.asDict() for r in got.collect()], got.columns) == plain(rows, want.columns)


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_runs_the_same_twice(spark, name):
    a, b = (sorted(map(repr, library.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
