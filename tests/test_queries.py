"""Every query that has SQL gives the rows of that SQL."""

import math

import duckdb
import pytest

from treelake.plans import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _sorted(rows, columns, order):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    out = [tuple(clean(r[columns.index(c)]) for c in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, db, name):
    df, want = QUERIES[name](spark, SF), db.sql(ORACLE[name])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    got = _sorted([tuple(r) for r in df.collect()], df.columns, order)
    assert got == _sorted(want.fetchall(), want.columns, order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
