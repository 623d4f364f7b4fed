"""Queries over literal fixtures: normalisers, identifiers, scores and small functions on their edge cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.functions import scores as sc
from textloom.functions import text as tx
from textloom.operators import quality, ranges, relations
from textloom.plans.catalogue import query
from textloom.sources import readers


def values(rows: list[str]) -> str:
    """SQL for rows (i, x)."""
    return "(VALUES " + ", ".join("({}, {})".format(i, "NULL" if r is None else "'" + r.replace("'", "''") + "'") for i, r in enumerate(rows)) + ") v(i, x)"


def frame(spark, rows: list):
    return spark.createDataFrame(list(enumerate(rows)), "i int, x string")


AR = ["إنَّمَا ٱلْأَعْمَالُ بِالنِّيَّاتِ", "قَالَ رَسُولُ ٱللَّهِ ﷺ", "رحمـــة، هؤلاء! شيئ", "آية 12 ١٢٣ abc", "", None, "على مسؤول", "ة ى"]
AR_SQL = r"trim(regexp_replace(regexp_replace(translate(regexp_replace(coalesce(x, ''), '[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]', '', 'g'), 'أإآىؤئ', 'ااايءء'), '[^\x{0600}-\x{06FF}0-9]', ' ', 'g'), ' +', ' ', 'g'))"


@query("norm_ar", f"SELECT i, {AR_SQL} AS y FROM {values(AR)}")
def norm_ar(spark, sf_dir):
    return frame(spark, AR).select("i", tx.normalize_ar("x").alias("y"))


@query("norm_ar_mobile", rf"""
SELECT i, trim(regexp_replace(translate(regexp_replace(coalesce(x, ''), '[\x{{064B}}-\x{{065F}}\x{{0670}}]', '', 'g'), 'آأإةى', 'اااهي'), ' +', ' ', 'g')) AS y,
 trim(translate(regexp_replace(coalesce(x, ''), '[\x{{064B}}-\x{{0670}}]', '', 'g'), 'آأإ', 'ااا')) AS z FROM {values(AR)}""")  # fmt: skip
def norm_ar_mobile(spark, sf_dir):
    return frame(spark, AR).select("i", tx.normalize_ar_mobile("x").alias("y"), tx.normalize_ar_query("x").alias("z"))


STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOPWORDS_AR) + "]"


@query("tokenize_ar", rf"""
WITH s AS (SELECT DISTINCT {AR_SQL} AS w FROM (SELECT unnest({STOP}) AS x)), t AS (SELECT i, string_split({AR_SQL}, ' ') AS t FROM {values(AR)})
SELECT i, array_to_string(list_filter(t, lambda a: length(a) >= 2 AND NOT regexp_full_match(a, '[0-9\x{{0660}}-\x{{0669}}\x{{06F0}}-\x{{06F9}}]+') AND NOT list_contains(ws, a)), '|') AS y FROM t, (SELECT list(w) AS ws FROM s)""")  # fmt: skip
def tokenize_ar(spark, sf_dir):
    return frame(spark, AR).select("i", F.array_join(tx.lemma_tokens(tx.tokenize_ar("x")), "|").alias("y"))


BODY = ["حدثنا فلان عن فلان قال رسول الله صلى الله عليه وسلم كلام طويل جدا هنا نص آخر", "نص طويل بلا علامة", "سند سند سند سند سند سند سند سند سند سند سند قال النبي", "عن أن النبي قال ثم قال رسول الله كذا وكذا وكذا وكذا وكذا", "", None]
BODY_SQL = "CASE " + " ".join(f"WHEN strpos(t, '{m}') > 0 AND strpos(t, '{m}') - 1 < floor(length(t) * 0.65) THEN substring(t, strpos(t, '{m}'))" for m in tx.BODY_MARKERS) + " ELSE t END"


@query("extract_body", f"SELECT i, {BODY_SQL} AS y FROM (SELECT i, coalesce(x, '') AS t FROM {values(BODY)})")
def extract_body(spark, sf_dir):
    return frame(spark, BODY).select("i", tx.extract_body("x").alias("y"))


ASKED = ["2:255", "02:5", "2 : 5", "2.255", "2-255", "10:1", "mercy and grace", "رحمة", "", "  ", None, "7:", ":7", "1:2:3"]


@query("intent_route", rf"""
SELECT i, CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^\d+\s*[:.\-]\s*\d+') THEN 'id' WHEN regexp_matches(t, '[\x{{0600}}-\x{{06FF}}]') THEN 'ar' ELSE 'en' END AS intent,
 CASE WHEN regexp_full_match(t, '\d+\s*:\s*\d+') THEN CAST(CAST(regexp_extract(t, '^(\d+)\s*:\s*(\d+)$', 1) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(regexp_extract(t, '^(\d+)\s*:\s*(\d+)$', 2) AS BIGINT) AS VARCHAR) END AS id
FROM (SELECT i, trim(coalesce(x, '')) AS t FROM {values(ASKED)})""")  # fmt: skip
def intent_route(spark, sf_dir):
    return frame(spark, ASKED).select("i", ids.query_intent(F.col("x")).alias("intent"), F.when(F.regexp_like(F.trim("x"), F.lit(r"^\d+\s*:\s*\d+$")), ids.parse_id(F.col("x"))).alias("id"))


@query("id_lookup", "SELECT * FROM (VALUES (0, '2:255', 1), (1, '2:5', 2), (2, '2:5', 2), (5, '10:1', 3)) v(qid, id, n)")
def id_lookup(spark, sf_dir):
    from textloom.operators.search import by_id

    records = spark.createDataFrame([("2:255", 1), ("2:5", 2), ("10:1", 3), ("1:1", 4)], "id string, n int")
    return by_id(frame(spark, ASKED).withColumnsRenamed({"i": "qid", "x": "query"}), records).select("qid", "id", "n")


KEYS = ["10:1", "2:1", "2:10", "2:9", "1:100"]


@query("id_sort_orders", f"""
SELECT x AS id, CAST(row_number() OVER (ORDER BY CAST(split_part(x, ':', 1) AS INT), CAST(split_part(x, ':', 2) AS INT)) AS INTEGER) AS by_number, CAST(row_number() OVER (ORDER BY x) AS INTEGER) AS by_text FROM {values(KEYS)}""")
def id_sort_orders(spark, sf_dir):
    """Five literal rows, so one window over all of them is bounded."""
    k = F.array(*[F.struct(ids.group_of(F.lit(x)).alias("g"), ids.number_of(F.lit(x)).alias("n"), F.lit(x).alias("id")) for x in KEYS])
    number = spark.range(1).select(F.posexplode(F.sort_array(k)).alias("p", "r")).select(F.col("r.id").alias("id"), (F.col("p") + 1).alias("by_number"))
    text = spark.range(1).select(F.posexplode(F.sort_array(F.array(*[F.lit(x) for x in KEYS]))).alias("p", "id")).select("id", (F.col("p") + 1).alias("by_text"))
    return number.join(text, "id")


@query("grouped_ids", "SELECT * FROM (VALUES (1, '1:100'), (2, '2:1|2:9|2:10'), (10, '10:1')) v(\"group\", ids)")
def grouped_ids(spark, sf_dir):
    return relations.grouped_ids(frame(spark, KEYS).select(F.col("x").alias("id"))).select("group", F.array_join("ids", "|").alias("ids"))


WORDS = ["running", "stories", "boxes", "cats", "walked", "sing", "bed", "gas", "ties", "being", "aaaa", "the", "of", "abcdefghi"]


@query("stem_variants", f"""
SELECT i, array_to_string(list_sort(list_distinct(list_filter([x, CASE WHEN x LIKE '%ing' AND n > 5 THEN x[:-4] END, CASE WHEN x LIKE '%ed' AND n > 4 THEN x[:-3] END, CASE WHEN x LIKE '%es' AND n > 4 THEN x[:-3] END,
 CASE WHEN x LIKE '%s' AND n > 3 THEN x[:-2] END, CASE WHEN x LIKE '%ies' AND n > 5 THEN x[:-4] || 'y' END], lambda a: a IS NOT NULL))), '|') AS variants,
 CASE WHEN n <= 4 THEN 1 WHEN n <= 8 THEN 2 ELSE 3 END AS edits, CAST(CASE WHEN n <= 3 THEN 1 ELSE n - 2 END AS INTEGER) AS grams, CAST(CASE WHEN n < 3 THEN 1 ELSE n - 2 END AS INTEGER) AS mobile_grams FROM (SELECT i, x, length(x) AS n FROM {values(WORDS)})""")  # fmt: skip
def stem_variants(spark, sf_dir):
    x = F.col("x")
    return frame(spark, WORDS).select("i", F.array_join(F.sort_array(tx.stem_variants_en(x)), "|").alias("variants"), tx.max_allowed_edits(x).alias("edits"), F.size(tx.trigrams(x)).alias("grams"), F.size(tx.trigrams_mobile(x)).alias("mobile_grams"))


@query("calibration", """
WITH v AS (SELECT CAST(k AS INTEGER) AS i, k / 200.0 AS x FROM range(-10, 220) t(k)), m AS (SELECT i, x, greatest(0.0, least(1.0, (x - 0.1) / 0.8)) AS m FROM v)
SELECT i, CAST(round_even(pow(m, 1.2) * 100, 0) AS INTEGER) AS score, round(m, 9) AS m, CAST(greatest(0, least(100, floor(x * 100 + 0.5))) AS VARCHAR) AS shown, CASE WHEN x >= 0.5 THEN 'high' WHEN x >= 0.2 THEN 'mid' ELSE 'low' END AS tier FROM
 (SELECT i, CAST(x AS DOUBLE) AS x, CAST(m AS DOUBLE) AS m FROM m)""".replace("CAST(greatest(0, least(100, floor(x * 100 + 0.5))) AS VARCHAR)", "CAST(CAST(greatest(0, least(100, floor(x * 100 + 0.5))) AS INTEGER) AS VARCHAR)"))  # fmt: skip
def calibration(spark, sf_dir):
    x = F.col("x")
    v = spark.range(-10, 220).select(F.col("id").cast("int").alias("i"), (F.col("id") / 200.0).alias("x"))
    return v.select("i", sc.calibrated_percentage(x, 0.1, 0.9, 1.2).alias("score"), F.round(sc.minmax01(x, 0.1, 0.9), 9).alias("m"), sc.display_score(x * 100).alias("shown"), sc.tier(x).alias("tier"))


@query("min_match", "SELECT CAST(k AS INTEGER) AS n, CAST(greatest(1, ceil(k * 3 / 5.0)) AS INTEGER) AS needed FROM range(0, 40) t(k)")
def min_match(spark, sf_dir):
    return spark.range(40).select(F.col("id").cast("int").alias("n"), sc.min_match(F.col("id")).alias("needed"))


@query("daily_pick", "SELECT CAST(k AS INTEGER) AS d, CAST((k + 20000) % 55 AS INTEGER) AS pick FROM range(0, 60) t(k)")
def daily_pick(spark, sf_dir):
    day = F.date_add(F.to_date(F.lit("2024-10-04")), F.col("id").cast("int"))
    return spark.range(60).select(F.col("id").cast("int").alias("d"), ranges.daily_pick(day, 55).alias("pick"))


@query("toggle_and_ranges", "SELECT * FROM (VALUES ('a|d', '2:5|2:6|2:7')) v(toggled, made)")
def toggle_and_ranges(spark, sf_dir):
    t = relations.toggled(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("d")))
    return spark.range(1).select(F.array_join(t, "|").alias("toggled"), F.array_join(ranges.number_range(F.lit("2"), F.lit(5), F.lit(7)), "|").alias("made"))


PATHS = ["./a/b.json", "data/x.json", "a\\b.json", "x"]


@query("paths_and_labels", "SELECT * FROM (VALUES (0, 'data/a/b.json'), (1, 'data/x.json'), (2, 'data/a/b.json'), (3, 'data/x')) v(i, path)")
def paths_and_labels(spark, sf_dir):
    return frame(spark, PATHS).select("i", tx.canonical_path("x").alias("path"))


@query("pictograph_prefix", "SELECT * FROM (VALUES (0, 'Mercy'), (1, 'Plain'), (2, 'Sky')) v(i, y)")
def pictograph_prefix(spark, sf_dir):
    return frame(spark, ["\U0001f319 Mercy", "Plain", " ☀️ Sky"]).select("i", tx.strip_pictograph_prefix("x").alias("y"))


NOTES = '<p class="tr">(2:3) text</p><p class="nt">1. A first note that is long enough &amp;c.</p><p class="nt">short</p><p class="nt">2. Another <b>note</b> of the same verse</p><p class="tr">no ref</p><p class="nt">3. Still the verse from before it</p><p class="tr">[2:4]</p>'


@query("tagged_notes", "SELECT * FROM (VALUES ('2:3', '1. A first note that is long enough &c.' || chr(10) || chr(10) || '2. Another note of the same verse' || chr(10) || chr(10) || '3. Still the verse from before it')) v(ref, notes)")
def tagged_notes(spark, sf_dir):
    notes = readers.tagged_notes(frame(spark, [NOTES, '<p class="nt">a note before any reference is left out</p>']), "i", "x")
    return relations.joined_notes(notes, ["i", "ref"], "pos", "note").select("ref", "notes")


@query("default_source", "SELECT * FROM (VALUES ('ur', 'b'), ('en', 'c'), ('fr', 'd'), ('xx', 'a')) v(lang, name)")
def default_source(spark, sf_dir):
    s = spark.createDataFrame([(0, "a", "ar"), (1, "b", "ur"), (2, "c", "en"), (3, "d", "fr"), (4, "e", "en")], "pos int, name string, lang string")
    found = [quality.default_source(s, p, {"ur": "b", "en": "c"}).select(F.lit(p).alias("lang"), "name") for p in ("ur", "en", "fr", "xx")]
    return relations.union_all(found)


@query("query_cache", "SELECT * FROM (VALUES (0, 'en', 'mercy now', 'old answer', true), (1, 'ar', 'رحمة', NULL, false), (3, 'en', 'late', NULL, false)) v(qid, lang, query, answer, cached)")
def query_cache(spark, sf_dir):
    from textloom.operators.search import cached_first, prepared

    q = spark.createDataFrame([(0, " Mercy  NOW ", None), (1, "رحمة", None), (2, "  ", "en"), (3, "Late", "en")], "qid int, query string, lang string")
    p = prepared(q)
    now = F.to_timestamp(F.lit("2024-06-01"))
    stored = p.select("cache_key", F.when(F.col("qid") == 0, "old answer").when(F.col("qid") == 3, "too old").alias("answer"), F.when(F.col("qid") == 0, now).otherwise(now - F.expr("INTERVAL 31 DAYS")).alias("stored_at")).where("answer is not null")
    return cached_first(p, stored, now=now).select("qid", "lang", "query", "answer", "cached")
