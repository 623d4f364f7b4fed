"""The registered queries that have SQL, against it in DuckDB."""

import os

import duckdb
import pytest

from tests.llm.helpers import SCHEMA
from textloom.llm import registry

DATA = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "One", "two words", "ab\r\ncd\x0bef gh ij", "Quoted 'MIT License' text, and more", "x" * 200, "x" * 49, "y" * 50 + "x" * 70, "é日本 " * 40,
    "Permission is hereby granted, free of charge,\nto any person obtaining a copy\n\nof this software and associated documentation files",
    "Licensed under CC BY 4.0.\nLicensed under CC BY-SA 4.0.", "licensed under the\n" + "gnu " * 3 + "\nLesser General Public License.", "All rights\n- - -\nreserved. THE GENERAL PUBLIC LICENSE",
    "same words here " * 30, "same words here " * 30, "Same words here " * 30 + "tail", "head " + "same words here " * 5 + "tail", "0123456789" * 9, "z" + "0123456789" * 9 + "q",
]


def compare(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda df: sorted(tuple(None if v != v or v is None else str(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    as_number = lambda df: df.assign(**{c: df[c].astype("float64") for c in columns if c in ("first_word", "last_word")})
    assert sorted(rows(as_number(got)), key=repr) == sorted(rows(as_number(want)), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    compare(registry.queries()[name](spark, DATA).toPandas(), con.sql(registry.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_odd_texts(spark, name, tmp_path):
    rows = [(7 * i % 101, t, None, "s", None) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    compare(registry.queries()[name](spark, str(tmp_path)).toPandas(), con.sql(registry.oracle_sql()[name]).df())
