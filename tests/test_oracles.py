"""Every registered query of the drawing engine against its SQL, run by DuckDB on the same tables."""

import duckdb
import pytest

from roomwright.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    return con


def same_form(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if isinstance(v, float):
            return round(v, 9) + 0.0
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    found = duck.sql(catalog.ORACLE_SQL[name])
    columns = list(found.columns)
    assert sorted(got.columns) == sorted(columns)
    assert same_form(got.columns, [tuple(r) for r in got.collect()]) == same_form(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
