"""Every catalogue query with SQL against DuckDB on the smallest tables; the others for their invariants."""

import math

import duckdb
import pytest

from scenequarry import catalogue

TABLES = "lineitem events documents embeddings pages benchmark labels conversations orders part customer supplier nation region".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


def plain(rows):
    clean = lambda x: "~" if x is None or isinstance(x, float) and math.isnan(x) else float(x) if isinstance(x, (int, float)) else x
    return sorted(tuple(map(clean, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    want = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.select(*columns).collect()) == plain(want.fetchall())
    spark.catalog.clearCache()


ROWS_ONLY = sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_same_rows_again(spark, sf, name):
    run = lambda: plain(catalogue.queries()[name](spark, sf).collect())
    first = run()
    spark.catalog.clearCache()
    assert first and first == run()
    spark.catalog.clearCache()
