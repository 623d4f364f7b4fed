"""Every query of the catalogue against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from textloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if type(v).__name__ in ("bool", "bool_"):
        return bool(v)
    if hasattr(v, "item") or isinstance(v, int | float):
        return f"{float(v):.9g}"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_oracle(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(got) > 0
        return
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted((tuple(canon(v) for v in r) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
