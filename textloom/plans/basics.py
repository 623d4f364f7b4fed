"""Queries over projections, predicates, sets and small aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from textloom.functions import ids
from textloom.functions import text as tx
from textloom.operators import index, postings, quality, relations, search
from textloom.plans.catalogue import query
from textloom.plans.tables import documents, table, tokens_sql


@query("prefix_head", """
SELECT key, n FROM (SELECT (l_orderkey % 50) || ':' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1) WHERE starts_with(key, '2:') ORDER BY CAST(split_part(key, ':', 1) AS INT), CAST(split_part(key, ':', 2) AS INT) LIMIT 15""")  # fmt: skip
def prefix_head(spark, sf_dir):
    """The first identifiers of a group in number order."""
    k = table(spark, sf_dir, "lineitem").select(ids.make_id(F.col("l_orderkey") % 50, F.col("l_linenumber")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("key").startswith("2:")).orderBy(*ids.id_order(F.col("key"))).limit(15)


@query("global_means", f"WITH d AS ({tokens_sql('documents', 'doc_id')}) SELECT count(*) AS docs, round(avg(len(tokens)), 6) AS mean_tokens, round(avg(len(list_distinct(tokens))), 6) AS mean_terms, count(*) FILTER (len(tokens) = 0) AS without FROM d")
def global_means(spark, sf_dir):
    n, u = F.size("tokens"), F.size(F.array_distinct("tokens"))
    return documents(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg(n), 6).alias("mean_tokens"), F.round(F.avg(u), 6).alias("mean_terms"), F.count_if(n == 0).alias("without"))


@query("topic_sizes", """
WITH b AS (SELECT l_returnflag || l_linestatus AS category, l_linenumber AS topic, l_partkey AS id FROM lineitem)
SELECT category, count(DISTINCT topic) AS topics, count(*) AS refs, count(DISTINCT id) AS ids FROM b GROUP BY 1""")  # fmt: skip
def topic_sizes(spark, sf_dir):
    """References of topics with repeats, and different ids; no list is gathered."""
    b = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("category"), F.col("l_linenumber").alias("topic"), F.col("l_partkey").alias("id"))
    refs = b.groupBy("category", "topic").agg(F.count(F.lit(1)).alias("n")).groupBy("category").agg(F.count(F.lit(1)).alias("topics"), F.sum("n").alias("refs"))
    return refs.join(b.select("category", "id").distinct().groupBy("category").agg(F.count(F.lit(1)).alias("ids")), "category")


@query("keyword_lookup", """
WITH q AS (SELECT * FROM (VALUES (0, 'src0'), (1, 'src0 src1'), (2, 'none')) t(qid, query)) SELECT qid, doc_id AS id FROM q JOIN documents ON regexp_replace(source, '[^0-9]', '', 'g') = trim(regexp_replace(regexp_replace(query, '[^0-9]', ' ', 'g'), ' +', ' ', 'g'))""")
def keyword_lookup(spark, sf_dir):
    """A whole query is one key of the index, so the second, of two words, finds nothing. Normalisation leaves the digits of Latin words,
    and so the index has those of sources."""
    q = spark.createDataFrame([(0, "src0"), (1, "src0 src1"), (2, "none")], "qid int, query string")
    t = lambda: table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.normalize_ar("source").alias("term"))
    return search.by_keyword(q, postings.built(spark, f"{sf_dir}/documents.parquet", "sources", t))


@query("array_sets", """
WITH d AS (SELECT doc_id, list_distinct(string_split(lang || ' ' || source || ' x', ' ')) AS a, ['en', 'src0', 'y'] AS b FROM documents)
SELECT doc_id, array_to_string(list_sort(list_intersect(a, b)), '|') AS inter, CAST(len(list_distinct(list_concat(a, b))) AS INTEGER) AS n_union, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), '|') AS diff FROM d""")  # fmt: skip
def array_sets(spark, sf_dir):
    a, b = F.array(F.col("lang"), F.col("source"), F.lit("x")), F.array(F.lit("en"), F.lit("src0"), F.lit("y"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.sort_array(F.array_intersect(a, b)), "|").alias("inter"), F.size(F.array_union(a, b)).alias("n_union"), F.array_join(F.sort_array(F.array_except(a, b)), "|").alias("diff"))


@query("hybrid_rejoin", "SELECT e.vec_id AS id, coalesce(d.lang, 'none') AS lang, coalesce(d.source, 'payload' || e.label) AS source FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id")
def hybrid_rejoin(spark, sf_dir):
    """A hit takes its record where there is one, else its own payload."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("payload"), "label").alias("payload"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source")
    return relations.lookup(e, d, "id", {"lang": F.lit("none"), "source": F.col("payload")}).select("id", "lang", "source")


@query("checked_join", "SELECT doc_id, a.lang, b.source FROM documents a JOIN documents b USING (doc_id)")
def checked_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return relations.checked_left_join(d.select("doc_id", "lang"), d.select("doc_id", "source"), "doc_id")


@query("composite_keys", "SELECT s_suppkey AS serial, n_name || '|' || s_name || '|' || s_suppkey AS key, s_name || ' — ' || n_name AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def composite_keys(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("s_suppkey").alias("serial"), ids.make_id(F.col("n_name"), F.col("s_name"), F.col("s_suppkey"), sep="|").alias("key"), tx.id_label(F.col("s_name"), F.col("n_name")).alias("label"))


@query("last_part_of_key", "SELECT o_orderkey, CAST(regexp_extract('b|r|' || o_orderkey, '([0-9]+)$', 1) AS BIGINT) AS serial, contains(lower(o_orderpriority), 'urgent') AS urgent FROM orders WHERE o_orderstatus IN ('O', 'F')")
def last_part_of_key(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F"))
    return o.select("o_orderkey", tx.trailing_number(F.concat(F.lit("b|r|"), "o_orderkey")).alias("serial"), F.lower("o_orderpriority").contains("urgent").alias("urgent"))


@query("id_intersection", "SELECT l_orderkey AS id, count(DISTINCT l_returnflag) AS n FROM lineitem WHERE l_returnflag IN ('A', 'N') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def id_intersection(spark, sf_dir):
    """Keys that all of several lists have."""
    pairs = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "N")).select(F.col("l_orderkey").alias("id"), "l_returnflag")
    return relations.having_all(pairs, "id", "l_returnflag", 2).select("id", F.col("n_items").alias("n"))


@query("search_terms_union", "SELECT lang AS term FROM documents UNION SELECT 'extra' UNION SELECT 'en'")
def search_terms_union(spark, sf_dir):
    extra = spark.createDataFrame([("extra",), ("en",)], "term string")
    return relations.union_all([table(spark, sf_dir, "documents").select(F.col("lang").alias("term")), extra]).distinct()


@query("gold_metrics", """
WITH p AS (SELECT doc_id % 20 AS query, doc_id AS cand, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS rank FROM documents), g AS (SELECT doc_id % 20 AS query, doc_id AS cand, CASE WHEN toxic = 1 THEN 'HN' WHEN quality = 1 THEN '2' ELSE '0' END AS label FROM labels)
SELECT query, round(count(*) FILTER (label IN ('1', '2')) / CAST(count(*) AS DOUBLE), 6) AS precision, round(count(*) FILTER (label = 'HN') / CAST(count(*) AS DOUBLE), 6) AS hard FROM p LEFT JOIN g USING (query, cand) WHERE rank <= 10 GROUP BY 1""")  # fmt: skip
def gold_metrics(spark, sf_dir):
    from textloom.operators.overlap import top_k

    p = top_k(table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("query"), F.col("doc_id").alias("cand")), ["query"], [F.asc("cand")], 50)
    g = table(spark, sf_dir, "labels").select((F.col("doc_id") % 20).alias("query"), F.col("doc_id").alias("cand"), F.when(F.col("toxic") == 1, "HN").when(F.col("quality") == 1, "2").otherwise("0").alias("label"))
    return quality.label_metrics(p, g, 10).select("query", F.round("precision", 6).alias("precision"), F.round("hard_negative_rate", 6).alias("hard"))


@query("random_pick")
def random_pick(spark, sf_dir):
    """One row at random: the count is all that can be checked."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.rand().alias("r")).orderBy("r").limit(1).select("item_id")
