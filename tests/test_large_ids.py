"""Identifiers of more digits than a name of a shard has."""

import duckdb

from textloom.plans import catalogue


def test_padding_is_that_of_sql_for_long_ids(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "src1") for i in (0, 7, 99_999, 100_000, 256_409, 1_234_567)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.preview, r.padded, r.key) for r in catalogue.queries()["previews_and_padding"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(catalogue.oracle_sql()["previews_and_padding"]).fetchall())
