"""Every query of the engine against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from bandwright import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (bool, str)) else round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)

    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, duck, name):
    ours = catalog.queries()[name](spark, DATA)
    theirs = duck.sql(catalog.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours.columns, [tuple(r) for r in ours.collect()]) == rows(theirs.columns, theirs.fetchall())


def test_every_query_with_sql_is_registered():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
