"""Every query with a twin gives DuckDB's rows; the others give rows."""

import os

import duckdb
import pytest

from strandline.plans import catalog

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("part", "lineitem", "pages", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(v[i]) for i in order) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    want = duck.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    kinds = {d[0]: str(d[1]) for d in want.description}
    assert sorted(columns) == sorted(df.columns)
    for column, kind in df.dtypes:
        assert {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN"}[kind] == kinds[column], (column, kind, kinds[column])
    values = want.fetchall()
    assert values and rows(df.columns, got) == rows(columns, values)
