import datetime as dt

from textloom.streaming import requests


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def stream(spark, rows, schema, path):
    for i, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(path / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path / "b*"))


def test_debounce_and_ttl(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [[("u", "m", at(0)), ("u", "me", at(0.2)), ("u", "mercy", at(0.4)), ("u", "grace", at(5))], [("u", "end", at(100))], [("u", "last", at(200))]]
    got = run(spark, requests.debounced(stream(spark, rows, "user string, query string, ts timestamp", tmp_path / "d")), "debounced", tmp_path)
    assert {r.query for r in got} >= {"mercy", "grace"} and "me" not in {r.query for r in got}
    keys = [[("k1", at(0)), ("k1", at(1)), ("k2", at(2))], [("k1", at(3))]]
    got = run(spark, requests.first_asked(stream(spark, keys, "cache_key string, ts timestamp", tmp_path / "k")), "first_asked", tmp_path)
    assert sorted(r.cache_key for r in got) == ["k1", "k2"]


def test_batches_replace_themselves(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    s = stream(spark, [[("k", "a", at)], [("j", "b", at)]], "cache_key string, answer string, stored_at timestamp", tmp_path / "a")
    requests.upsert_answers(s, str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.answer for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
