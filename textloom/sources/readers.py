"""Readers: CSV of unknown encoding and headers, JSON arrays and maps in shards, line lists, nested JSON, tables of a worksheet, HTML."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import strip_html_inline

#: Tried in this order.  Fixed values.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1256", "latin1")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, else the first."""
    return next((p for p in paths if exists(spark, p)), paths[0])


def required(spark: SparkSession, *paths: str) -> str:
    """The first path that exists; an error names all places."""
    found = first_existing(spark, *paths)
    if not exists(spark, found):
        raise FileNotFoundError("none of these exists: " + ", ".join(paths))
    return found


def header_key(name: str) -> str:
    return re.sub(r"[\s_-]+", " ", (name or "").strip().lower())


def resolve(df: DataFrame, aliases: dict[str, list[str]], optional: tuple[str, ...] = (), defaults: dict[str, str] | None = None) -> DataFrame:
    """Columns by any of their names; one that is missing is filled with its default, or left out if it is optional."""
    have, defaults = {header_key(c): c for c in df.columns}, defaults or {}
    out = []
    for name, names in aliases.items():
        hit = next((have[k] for k in map(header_key, names) if k in have), None)
        if hit is not None:
            out.append(F.col(f"`{hit}`").alias(name))
        elif name in defaults:
            out.append(F.lit(defaults[name]).alias(name))
        elif name not in optional:
            raise ValueError(f"no column for {name}: expected one of {names}, found {df.columns}")
    return df.select(*out)


def _decodes(batches):
    """Of each whole file whether it starts with a byte order mark, and how many of ENCODINGS come before the first that decodes it."""
    import codecs

    import pyarrow as pa

    for b in batches:
        rows = []
        for content in b.column(0).to_pylist():
            for i, e in enumerate(ENCODINGS):
                decoder = codecs.getincrementaldecoder(e)()
                try:
                    for low in range(0, len(content), 1 << 20):
                        decoder.decode(content[low : low + (1 << 20)])
                    decoder.decode(b"", final=True)
                except UnicodeDecodeError:
                    continue
                break
            rows.append((content.startswith(codecs.BOM_UTF8), i))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.int32())], ["marked", "place"])


def decoding_of(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes all files, each as a whole: UTF-8, with or without a byte order mark, or single bytes."""
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_decodes, "marked boolean, place int")
    marked, place = found.agg(F.bool_or("marked"), F.max("place")).first()
    if place == 0 and marked:
        return "utf-8-sig"
    return ENCODINGS[place or 0]


def all_charsets(spark: SparkSession) -> None:
    """Lets the session's CSV reader and writer have every character set of the JVM, of which windows-1256 is one."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV with a header, all columns as text unless a schema is given. Quoted values may hold line ends."""
    e = encoding or decoding_of(spark, path)
    if e == "cp1256":
        all_charsets(spark)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", {"utf-8-sig": "utf-8", "cp1256": "windows-1256", "latin1": "iso-8859-1"}.get(e, e))
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def _whole(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path and text of whole files, without a byte order mark."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^\\x{FEFF}", "").alias("text"))


def read_json_array(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Records of files that are JSON arrays."""
    return _whole(spark, path).select(F.inline(F.from_json("text", f"array<struct<{schema}>>")))


def read_json_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, text and path of files that are one JSON object each."""
    return _whole(spark, path).select("path", F.explode(F.from_json("text", "map<string,string>")).alias("id", "text"))


def read_all_shards(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, text of JSON objects in shards; of an id that stands in several the last shard wins."""
    order = spark.createDataFrame([(re.sub("^[a-z]+:/*", "/", p), i) for i, p in enumerate(paths)], "file string, pos int")
    rows = read_json_map(spark, paths).withColumn("file", F.regexp_replace("path", "^[a-z]+:/*", "/")).join(F.broadcast(order), "file", "left")
    return rows.groupBy("id").agg(F.max_by("text", F.coalesce("pos", F.lit(-1))).alias("text"))


def read_line_list(spark: SparkSession, path: str) -> DataFrame:
    """word: different lines, without blank lines and those that start with #."""
    line = F.trim("value")
    return spark.read.text(path).select(line.alias("word")).where("word <> '' and not startswith(word, '#')").distinct()


def flatten_groups(df: DataFrame, json: str) -> DataFrame:
    """id, text from {"surahs": [{"number", "ayahs": [{"numberInSurah", "text"}]}]}: ids by the number within the group."""
    schema = "struct<surahs: array<struct<number: int, ayahs: array<struct<number: int, numberInSurah: int, text: string>>>>>"
    groups = df.select(F.from_json(json, schema).alias("j")).select(F.explode("j.surahs").alias("g")).select("g.number", F.explode("g.ayahs").alias("a"))
    return groups.select(F.concat_ws(":", "number", "a.numberInSurah").alias("id"), F.col("a.text").alias("text"))


def worksheet(spark: SparkSession, frame) -> DataFrame:
    """Rows of a worksheet that pandas has read whose first column is an id group:number; the id is split."""
    key = frame.columns[0]
    good = frame.dropna(subset=[key])
    df = spark.createDataFrame(good.astype(str))
    return df.where(F.regexp_like(key, F.lit(r"^\d+:\d+$"))).withColumn("group", F.split_part(key, F.lit(":"), F.lit(1)).cast("int")).withColumn("number", F.split_part(key, F.lit(":"), F.lit(2)).cast("int"))


def tagged_notes(pages: DataFrame, key: str, html: str, least: int = 15) -> DataFrame:
    """key, ref, pos and note: paragraphs of class nt with the reference of the last paragraph of class tr before them.

    Notes of up to ``least`` characters are left out; so are those before any reference."""
    pattern = F.lit(r'<p class="(tr|nt)">([\s\S]*?)</p>')
    parts = F.arrays_zip(F.regexp_extract_all(html, pattern, F.lit(1)).alias("kind"), F.regexp_extract_all(html, pattern, F.lit(2)).alias("raw"))
    rows = pages.select(key, F.posexplode(parts).alias("pos", "p")).select(key, "pos", "p.kind", "p.raw")
    ref = F.nullif(F.regexp_extract("raw", r"[(\[](\d+:\d+)[)\]]", 1), F.lit(""))
    from textloom.operators.relations import running_last

    rows = running_last(rows.withColumn("own", F.when(F.col("kind") == "tr", ref)), key, "pos", "own", "ref")
    notes = rows.where("kind = 'nt' and ref is not null").select(key, "ref", "pos", strip_html_inline("raw").alias("note"))
    return notes.where(F.length("note") > least)


def links(pages: DataFrame, key: str, html: str, pattern: str = r"/surah-([^/]+)/ayat-(\d+)/") -> DataFrame:
    """key, slug, number of links, each once, in the order of their first place."""
    found = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("slug"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("number"))
    return pages.select(key, F.posexplode(F.array_distinct(found)).alias("pos", "l")).select(key, "pos", "l.slug", F.col("l.number").try_cast("int").alias("number"))


def bootstrap_list(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """word: the list at a path. Where nothing is there, the default words are written first, different ones in order."""
    if not exists(spark, path):
        lines = spark.createDataFrame([(i, w) for i, w in enumerate(sorted(set(words))) if w], "place int, value string")
        lines.coalesce(1).sortWithinPartitions("place").select("value").write.text(path)
    return read_line_list(spark, path)


def replace_block(text, start: str, end: str, body):
    """A text whose part between two markers is another one; the markers stay, and a text without them is as it was."""
    text, body = (F.col(x) if isinstance(x, str) else x for x in (text, body))
    low = F.locate(start, text)
    inner = low + len(start)
    high = F.when(low > 0, F.instr(F.substring(text, inner, F.length(text)), end))
    return F.when(high > 0, F.concat(F.substring(text, F.lit(1), inner - 1), body, F.substring(text, inner + high - 1, F.length(text)))).otherwise(text)
