import json

import pytest
from pyspark.sql import functions as F

from textloom.sources import http, readers, sinks


def test_csv_encodings_and_headers(spark, tmp_path):
    for name, data in (("a", "Surah No,text\n1,é\n".encode("utf-8-sig")), ("b", "Surah_No,text\n1,é\n".encode("latin1")), ("c", b"surah-no,text\n1,\xc3\xa9\n")):
        p = tmp_path / f"{name}.csv"
        p.write_bytes(data)
        df = readers.resolve(readers.read_csv(spark, str(p), "latin1" if name == "b" else None), {"group": ["surah no"], "text": ["Text"], "more": ["x"]}, optional=("more",))
        assert [tuple(r) for r in df.collect()] == [("1", "é")]
    with pytest.raises(ValueError, match="no column for missing"):
        readers.resolve(df, {"missing": ["nothing"]})


def test_json_shards(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"1:1": "x", "1:2": "y"}).encode())
    (tmp_path / "b.json").write_text(json.dumps({"1:2": "z"}))
    (tmp_path / "c.json").write_text("{}")
    paths = [str(tmp_path / f"{n}.json") for n in "abc"]
    assert {(r.id, r.text) for r in readers.read_all_shards(spark, paths).collect()} == {("1:1", "x"), ("1:2", "z")}
    (tmp_path / "d.json").write_text(json.dumps([{"id": "1:1", "n": 1}, {"id": "1:2"}]))
    assert [tuple(r) for r in readers.read_json_array(spark, str(tmp_path / "d.json"), "id string, n int").orderBy("id").collect()] == [("1:1", 1), ("1:2", None)]


def test_line_list_and_guards(spark, tmp_path):
    p = tmp_path / "w.txt"
    p.write_text("# words\n\na\n b \na\n")
    assert {r.word for r in readers.read_line_list(spark, str(p)).collect()} == {"a", "b"}
    assert readers.first_existing(spark, str(tmp_path / "none"), str(p)) == str(p)
    with pytest.raises(FileNotFoundError):
        readers.required(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    df = spark.range(1, 2501).select(F.col("id").alias("serial"), (F.col("id") % 3).alias("k"))
    assert [tuple(r) for r in sinks.shard_by_range(df, "serial", str(tmp_path / "r")).orderBy("start").collect()] == [(1, 1000, "shard_00001.json"), (1001, 2000, "shard_00002.json"), (2001, 2500, "shard_00003.json")]
    sinks.shard_by_key(df, F.col("k"), str(tmp_path / "k"))
    assert sorted(p.name for p in (tmp_path / "k").glob("shard=*")) == ["shard=000", "shard=001", "shard=002"]
    out = str(tmp_path / "once")
    assert [sinks.write_idempotent(df, out, dry_run=True), sinks.write_idempotent(df, out), sinks.write_idempotent(df, out), sinks.write_idempotent(df, out, force=True)] == ["planned", "written", "skipped", "written"]
    sinks.vector_table(df.select(F.col("serial").alias("point_id"), F.array(F.lit(0.5)).alias("v"), "k"), {"en": "v"}, ["k"], str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).select("payload.k", "en").count() == 2500
    pairs = spark.createDataFrame([("1:1", "semantic", "2:1", 90, "a|b", 1), ("1:1", "semantic", "2:2", 80, "a", 2), ("1:1", "lexical", "3:1", 70, "", 1)], "anchor_id string, pair_type string, cand_id string, score int, shared string, rank int")
    assert {k: [x["id"] for x in v] for k, v in sinks.nested_pairs(pairs).first()["pairs"].items()} == {"semantic": ["2:1", "2:2"], "lexical": ["3:1"]}


def test_encoding_is_judged_by_the_whole_file(spark, tmp_path):
    p = tmp_path / "late.csv"
    p.write_bytes(b"id,text\n" + b"1,plain words\n" * 120_000 + "2,“é”\n".encode("cp1256"))
    assert readers.decoding_of(spark, str(p)) == "cp1256"
    assert readers.read_csv(spark, str(p)).where("id = '2'").first()["text"] == "“é”"
    p.write_bytes(b"\xef\xbb\xbfid,text\n1,\xc3\xa9\n")
    assert readers.decoding_of(spark, str(p)) == "utf-8-sig"


def test_defaults_lists_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([("1", "x")], "id string, text string")
    assert readers.resolve(df, {"id": ["id"], "book": ["book"]}, defaults={"book": "Unknown"}).first() == ("1", "Unknown")
    path = str(tmp_path / "words")
    assert {r.word for r in readers.bootstrap_list(spark, path, ["b", "a", "b"]).collect()} == {"a", "b"}
    assert {r.word for r in readers.bootstrap_list(spark, path, ["c"]).collect()} == {"a", "b"}
    rows = spark.createDataFrame([("x <a>old</a> y",), ("no marks",), ("<a>open",), (None,)], "t string")
    assert [r[0] for r in rows.select(readers.replace_block("t", "<a>", "</a>", F.lit("new"))).collect()] == ["x <a>new</a> y", "no marks", "<a>open", None]


def test_http_retries_pages_and_falls_back():
    asked = []

    def opener(url):
        asked.append(url)
        if "bad" in url or len(asked) < 3:
            raise OSError("down")
        page = int(url.split("page=")[-1])
        return json.dumps({"rows": [page], "pagination": {"next_page": page + 1 if page < 3 else None}}).encode()

    assert [p["rows"] for p in http.pages("http://x/rows", opener, 2, delay=0.0)] == [[1], [2], [3]]
    assert len(asked) == 5 and asked[-1] == "http://x/rows?per_page=2&page=3"
    assert http.fetch_json("http://bad", opener, delay=0.0, fallback="http://x?page=3")["rows"] == [3]
    with pytest.raises(OSError, match="http://bad"):
        http.fetch_json("http://bad", opener, delay=0.0)


def test_strict_numbers_name_what_is_none(spark):
    from textloom.operators.relations import numeric_strict

    df = spark.createDataFrame([("1",), (None,)], "n string")
    assert [r.n for r in numeric_strict(df, ["n"]).collect()] == [1, None]
    with pytest.raises(Exception, match="n is no number: x"):
        numeric_strict(spark.createDataFrame([("x",)], "n string"), ["n"]).collect()


def test_worksheet(spark):
    import pandas as pd

    got = readers.worksheet(spark, pd.DataFrame({"id": ["2:13", None, "total"], "w": ["a", "b", "c"]})).collect()
    assert [(r.group, r.number, r.w) for r in got] == [(2, 13, "a")]


def test_a_store_keeps_a_record_of_every_item(spark, tmp_path):
    store = sinks.ItemStore(spark, f"{tmp_path}/store")
    put = lambda rows, **k: sorted((r.item, r.status) for r in store.put(spark.createDataFrame(rows, "item string, content string"), **k).collect())
    assert put([("a", "one"), ("b", " "), ("c", None), ("d", "x"), ("d", "w")]) == [("a", "written"), ("b", "failed"), ("c", "failed"), ("d", "written")]
    assert put([("a", "two"), ("b", "now")]) == [("a", "skipped"), ("b", "written")]
    assert put([("a", "two")], force=True) == [("a", "written")]
    assert sorted(map(tuple, store.items().collect())) == [("a", "two"), ("b", "now"), ("d", "w")]
    assert sorted(map(tuple, store.counts().collect())) == [(1, 2, 0, 2), (2, 1, 1, 0), (3, 1, 0, 0)]


def test_a_run_that_fails_leaves_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert sinks.write_idempotent(spark.range(3), path) == "written"
    broken = spark.range(5).selectExpr("raise_error('no') AS id")
    with pytest.raises(Exception, match="no"):
        sinks.write_idempotent(broken, path, force=True)
    assert spark.read.parquet(path).count() == 3
    assert sinks.write_idempotent(spark.range(4), path, force=True) == "written" and spark.read.parquet(path).count() == 4
    assert sinks.write_idempotent(spark.range(9), path) == "skipped" and spark.read.parquet(path).count() == 4
