"""Queries over term statistics, indexes and set overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import bounded, index, lemmas, overlap, tfidf
from textloom.plans.catalogue import query
from textloom.plans.tables import CORPORA_SQL, STOP_SQL, benchmark, cal, documents, mm, table, tokens_sql
from textloom.sources import sinks


def corpora(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms of anchors and candidates, and IDF over both."""
    a, c, idf, _ = written_corpora(spark, sf_dir)
    return a, c, idf


def written_corpora(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same and the table of texts. Each text is tokenised once, into a written table, and IDF is written too."""
    side = lambda df, name: df.select(F.lit(name).alias("side"), "id", F.array_distinct("tokens").alias("terms"))
    texts = sinks.scratch(side(benchmark(spark, sf_dir), "a").unionAll(side(documents(spark, sf_dir), "c")))
    a, c = (texts.where(F.col("side") == s).select("id", F.explode("terms").alias("term")) for s in "ac")
    return a, c, sinks.scratch(bounded.numbered_terms(index.idf_table(texts.select(F.explode("terms").alias("term")), texts.select(F.count(F.lit(1))).scalar()))), texts


@query("norm_en_tokens", f"""
WITH d AS ({tokens_sql("documents", "doc_id")})
SELECT id, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(len(list_distinct(tokens)) AS INTEGER) AS n_terms, md5(array_to_string(tokens, '|')) AS said FROM d""")  # fmt: skip
def norm_en_tokens(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_terms"), F.md5(F.array_join("tokens", "|")).alias("said"))


@query("token_df_idf", f"WITH {CORPORA_SQL} SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM idf")
def token_df_idf(spark, sf_dir):
    return corpora(spark, sf_dir)[2].select("term", "df", F.round("idf", 6).alias("idf"))


@query("generic_terms", f"""WITH {CORPORA_SQL} SELECT term, CAST(df AS BIGINT) AS df FROM idf WHERE df / CAST((SELECT n FROM n) AS DOUBLE) >= 0.05""")
def generic_terms(spark, sf_dir):
    ad, cd = benchmark(spark, sf_dir), documents(spark, sf_dir)
    rows = index.terms(ad).unionAll(index.terms(cd))
    return index.generic_terms(index.document_frequency(rows), ad.count() + cd.count(), 0.05).select("term", "df")


@query("postings_index", f"""
WITH d AS ({tokens_sql("documents", "doc_id")}), t AS (SELECT id, unnest(list_distinct(tokens)) AS term FROM d)
SELECT term, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(id AS VARCHAR), '|' ORDER BY id) AS ids FROM t GROUP BY term""")  # fmt: skip
def postings_index(spark, sf_dir):
    p = index.postings(index.terms(documents(spark, sf_dir)))
    return p.select("term", F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda x: x.cast("string")), "|").alias("ids"))


@query("trigram_index", f"""
WITH d AS ({tokens_sql("benchmark", "item_id")}), v AS (SELECT DISTINCT unnest(tokens) AS term FROM d),
g AS (SELECT DISTINCT term, unnest(CASE WHEN length(term) <= 3 THEN [term] ELSE list_transform(range(1, length(term) - 1), lambda i: substring(term, CAST(i AS INTEGER), 3)) END) AS trigram FROM v)
SELECT trigram, string_agg(term, '|' ORDER BY term) AS tokens FROM g GROUP BY trigram""")  # fmt: skip
def trigram_index(spark, sf_dir):
    return index.trigram_index(index.terms(benchmark(spark, sf_dir))).select("trigram", F.array_join("tokens", "|").alias("tokens"))


PAIRS_SQL = f"""{CORPORA_SQL},
aw AS (SELECT a.id, a.term, idf.idf AS w FROM a JOIN idf USING (term)), cw AS (SELECT c.id, c.term, idf.idf AS w FROM c JOIN idf USING (term)),
ab AS (SELECT id, sum(w) AS base FROM aw GROUP BY id), cb AS (SELECT id, sum(w) AS other FROM cw GROUP BY id),
p AS (SELECT aw.id AS anchor, cw.id AS cand, count(*) AS k, sum(aw.w) AS inter FROM aw JOIN cw USING (term) GROUP BY 1, 2),
s AS (SELECT anchor, cand, k, inter, inter / base AS recall, inter / (base + other - inter) AS jaccard FROM p JOIN ab ON ab.id = anchor JOIN cb ON cb.id = cand)"""
C4_RAW = f"(0.45 * {mm('jaccard', 0.02, 0.45)} + 0.35 * {mm('recall', 0.05, 0.90)} + 0.20 * {mm('k', 1.0, 6.0)})"
C4_SQL = f"""{PAIRS_SQL}, r AS (SELECT *, {C4_RAW} AS raw, {cal(C4_RAW, 0.08, 0.85, 1.10)} AS score FROM s),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, k DESC, cand) AS rank FROM r) WHERE rank <= 50)"""


@query("overlap_cross_top50", f"WITH {C4_SQL} SELECT anchor, cand, CAST(k AS BIGINT) AS k, score, round(raw, 6) AS raw, CAST(rank AS INTEGER) AS rank FROM top")
def overlap_cross_top50(spark, sf_dir):
    return best_overlaps(spark, sf_dir).select("anchor", "cand", "k", "score", F.round("raw", 6).alias("raw"), "rank")


def best_overlaps(spark, sf_dir) -> DataFrame:
    return bounded.TopOverlap(*corpora(spark, sf_dir)).best()


@query("overlap_signals", f"WITH {PAIRS_SQL} SELECT anchor, cand, CAST(k AS BIGINT) AS k, round(inter, 6) AS inter, round(recall, 6) AS recall, round(jaccard, 6) AS jaccard FROM s")
def overlap_signals(spark, sf_dir):
    a, c, idf = corpora(spark, sf_dir)
    return overlap.weighted_overlap(a, c, idf).select("anchor", "cand", "k", *[F.round(x, 6).alias(x) for x in ("inter", "recall", "jaccard")])


@query("shared_terms_display", f"""
WITH {C4_SQL}, sh AS (SELECT anchor, cand, a.term, round(idf.idf, 9) AS w FROM top JOIN a ON a.id = anchor JOIN c ON c.id = cand AND c.term = a.term JOIN idf ON idf.term = a.term),
o AS (SELECT *, row_number() OVER (PARTITION BY anchor, cand ORDER BY w DESC, term) AS i FROM sh)
SELECT anchor, cand, string_agg(term, '|' ORDER BY i) AS shared FROM o WHERE i <= 8 GROUP BY 1, 2""")  # fmt: skip
def shared_terms_display(spark, sf_dir):
    a, c, idf = corpora(spark, sf_dir)
    top = sinks.scratch(bounded.TopOverlap(a, c, idf).best().select("anchor", "cand"))
    return overlap.shared_terms(top, a, c, idf).select("anchor", "cand", F.array_join("shared", "|").alias("shared"))


#: Parts that stand for roots, orders for the texts that have them.
C3_RAW = f"(0.55 * {mm('jaccard', 0.06, 0.70)} + 0.30 * {mm('recall', 0.12, 0.95)} + 0.15 * {mm('k', 2.0, 7.0)})"


def baskets(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("term")).distinct()


@query("overlap_self_ge2", f"""
WITH b AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS term FROM lineitem), idf AS (SELECT term, 1 + ln((1.0 + (SELECT count(DISTINCT id) FROM b)) / (1.0 + count(*))) AS idf FROM b GROUP BY term),
w AS (SELECT id, term, idf AS w FROM b JOIN idf USING (term)), s0 AS (SELECT id, sum(w) AS base FROM w GROUP BY id),
p AS (SELECT x.id AS anchor, y.id AS cand, count(*) AS k, sum(x.w) AS inter FROM w x JOIN w y ON x.term = y.term AND x.id <> y.id GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT anchor, cand, k, inter / u.base AS recall, inter / (u.base + v.base - inter) AS jaccard FROM p JOIN s0 u ON u.id = anchor JOIN s0 v ON v.id = cand)
SELECT anchor, cand, CAST(k AS BIGINT) AS k, {cal(C3_RAW, 0.10, 0.92, 1.08)} AS score FROM s""")  # fmt: skip
def overlap_self_ge2(spark, sf_dir):
    return basket_pairs(spark, sf_dir).select("anchor", "cand", "k", "score")


def basket_pairs(spark, sf_dir) -> DataFrame:
    b = sinks.scratch(baskets(spark, sf_dir))
    idf = index.idf_table(b, b.select("id").distinct().count())
    return overlap.lexical_same_corpus(bounded.pairs_of_two(b, idf))


@query("client_root_pairs", f"""
WITH b AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS term FROM lineitem), idf AS (SELECT term, 1 + ln((1.0 + (SELECT count(DISTINCT id) FROM b)) / (1.0 + count(*))) AS idf FROM b GROUP BY term),
w AS (SELECT id, term, idf AS w FROM b JOIN idf USING (term)), s0 AS (SELECT id, sum(w) AS base FROM w GROUP BY id),
p AS (SELECT x.id AS anchor, y.id AS cand, count(*) AS k, sum(x.w) AS inter FROM w x JOIN w y ON x.term = y.term AND x.id <> y.id GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT anchor, cand, k, inter / u.base AS recall, inter / (u.base + v.base - inter) AS jaccard FROM p JOIN s0 u ON u.id = anchor JOIN s0 v ON v.id = cand),
c AS (SELECT anchor, cand, k, {cal(C3_RAW, 0.10, 0.92, 1.08)} AS score FROM s)
SELECT anchor, cand, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, k DESC, cand) AS rank FROM c) WHERE rank <= 20""")  # fmt: skip
def client_root_pairs(spark, sf_dir):
    return overlap.first_pairs(basket_pairs(spark, sf_dir)).select("anchor", "cand", "score", "rank")


@query("root_pairs_ranked", f"""
WITH b AS (SELECT DISTINCT l_orderkey AS id, l_partkey AS term FROM lineitem), idf AS (SELECT term, 1 + ln((1.0 + (SELECT count(DISTINCT id) FROM b)) / (1.0 + count(*))) AS idf FROM b GROUP BY term),
w AS (SELECT id, term, idf AS w FROM b JOIN idf USING (term)), s0 AS (SELECT id, sum(w) AS base FROM w GROUP BY id),
p AS (SELECT x.id AS anchor, y.id AS cand, count(*) AS k, sum(x.w) AS inter FROM w x JOIN w y ON x.term = y.term AND x.id <> y.id GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT anchor, cand, k, inter / u.base AS recall, inter / (u.base + v.base - inter) AS jaccard FROM p JOIN s0 u ON u.id = anchor JOIN s0 v ON v.id = cand),
c AS (SELECT anchor, cand, k, {cal(C3_RAW, 0.10, 0.92, 1.08)} AS score FROM s)
SELECT anchor, cand, CAST(k AS BIGINT) AS k, score, CAST(row_number() OVER (PARTITION BY anchor ORDER BY k DESC, score DESC, cand) AS INTEGER) AS rank FROM c""")  # fmt: skip
def root_pairs_ranked(spark, sf_dir):
    return overlap.ranked_pairs(basket_pairs(spark, sf_dir)).select("anchor", "cand", "k", "score", "rank")


ROOT = "substring({t}, 1, 3)"


@query("shared_roots_first", f"""
WITH {C4_SQL}, ar AS (SELECT DISTINCT id, {ROOT.format(t="term")} AS term FROM a), cr AS (SELECT DISTINCT id, {ROOT.format(t="term")} AS term FROM c),
ri AS (SELECT term, count(*) AS df, 1 + ln((1.0 + (SELECT n FROM n)) / (1.0 + count(*))) AS idf FROM (SELECT * FROM ar UNION ALL SELECT * FROM cr) GROUP BY term),
x AS (SELECT anchor, cand, 0 AS place, ar.term, round(ri.idf, 9) AS w, ri.df / CAST((SELECT n FROM n) AS DOUBLE) >= 0.05 AS generic FROM top JOIN ar ON ar.id = anchor JOIN cr ON cr.id = cand AND cr.term = ar.term JOIN ri ON ri.term = ar.term
  UNION ALL SELECT anchor, cand, 1, a.term, round(idf.idf, 9), idf.df / CAST((SELECT n FROM n) AS DOUBLE) >= 0.05 FROM top JOIN a ON a.id = anchor JOIN c ON c.id = cand AND c.term = a.term JOIN idf ON idf.term = a.term),
y AS (SELECT *, bool_or(NOT generic) OVER (PARTITION BY anchor, cand) AS telling FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY anchor, cand ORDER BY place, w DESC, term) AS i FROM y WHERE NOT (telling AND generic))
SELECT anchor, cand, string_agg(term, '|' ORDER BY i) AS shared FROM z WHERE i <= 8 GROUP BY 1, 2""")  # fmt: skip
def shared_roots_first(spark, sf_dir):
    """What a pair shares: first letters, which stand for roots, then tokens; generic ones only where there is nothing else."""
    a, c, idf, texts = written_corpora(spark, sf_dir)
    n = texts.count()
    top = sinks.scratch(bounded.TopOverlap(a, c, idf).best().select("anchor", "cand"))
    root = lambda df: df.select("id", F.substring("term", 1, 3).alias("term")).distinct()
    ri = index.idf_table(root(a).unionAll(root(c)), n)
    generic = lambda t: index.generic_terms(t, n, 0.05).select("term")
    return overlap.shared_by_kind(top, [(root(a), root(c), ri, generic(ri)), (a, c, idf, generic(idf))]).select("anchor", "cand", F.array_join("shared", "|").alias("shared"))


TFIDF_SQL = f"""
a_docs AS ({tokens_sql("benchmark", "item_id")}), c_docs AS ({tokens_sql("documents", "doc_id")}),
d AS (SELECT 'a' || id AS id, tokens FROM a_docs UNION ALL SELECT 'c' || id, tokens FROM c_docs), n AS (SELECT count(*) AS n FROM d),
g AS (SELECT id, unnest(list_concat(tokens, CASE WHEN len(tokens) >= 2 THEN list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]) ELSE [] END)) AS term FROM d),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM n)),
x AS (SELECT id, term, (1 + ln(CAST(tf AS DOUBLE))) * (1 + ln((1.0 + (SELECT n FROM n)) / (1.0 + df))) AS x FROM tf JOIN df USING (term)),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x)"""


def tfidf_rows(spark, sf_dir, only=None):
    key = lambda df, p: df.select(F.concat(F.lit(p), F.col("id")).alias("id"), "tokens")
    docs = key(benchmark(spark, sf_dir), "a").unionAll(key(documents(spark, sf_dir), "c"))
    return tfidf.tfidf(docs, docs.count(), only=only)


@query("tfidf_weights", f"WITH {TFIDF_SQL} SELECT id, CAST(count(*) AS BIGINT) AS n, round(sum(w), 4) AS total, round(max(w), 6) AS most, arg_max(term, (round(w, 9), term)) AS first FROM w GROUP BY id")
def tfidf_weights(spark, sf_dir):
    return tfidf_rows(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"), F.round(F.max("w"), 6).alias("most"), F.max_by("term", F.struct(F.round("w", 9), "term")).alias("first"))


@query("tfidf_pairs", f"""
WITH top AS (WITH {C4_SQL} SELECT anchor, cand FROM top), {TFIDF_SQL},
dots AS (SELECT top.anchor, top.cand, sum(x.w * y.w) AS dot FROM top JOIN w x ON x.id = 'a' || top.anchor JOIN w y ON y.id = 'c' || top.cand AND y.term = x.term GROUP BY 1, 2)
SELECT top.anchor, top.cand, round(coalesce(dot, 0), 6) AS tfidf FROM top LEFT JOIN dots USING (anchor, cand)""")  # fmt: skip
def tfidf_pairs(spark, sf_dir):
    top = best_overlaps(spark, sf_dir)
    pairs = sinks.scratch(top.select(F.concat(F.lit("a"), "anchor").alias("anchor"), F.concat(F.lit("c"), "cand").alias("cand")))
    wanted = pairs.select(F.col("anchor").alias("id")).unionAll(pairs.select(F.col("cand").alias("id"))).distinct()
    w = sinks.scratch(tfidf_rows(spark, sf_dir, wanted))
    dots = tfidf.sparse_dot(pairs, w, w)
    return dots.select(F.substring("anchor", 2, 20).cast("long").alias("anchor"), F.substring("cand", 2, 20).cast("long").alias("cand"), F.round("tfidf", 6).alias("tfidf"))


LEMMAS_SQL = f"""
dt AS ({tokens_sql("documents", "doc_id")}), v AS (SELECT DISTINCT unnest(tokens) AS term FROM dt), fm AS ({lemmas.forms_sql("v", lemmas.ENGLISH)}),
lm AS (SELECT term, arg_min(lemma, rank) AS lemma FROM fm WHERE lemma <> term AND lemma IN (SELECT term FROM v) GROUP BY term),
ea AS (SELECT id, unnest(tokens) AS term, unnest(range(len(tokens))) AS pos FROM dt), el AS (SELECT id, pos, coalesce(lemma, ea.term) AS lemma FROM ea LEFT JOIN lm USING (term)),
le AS (SELECT dt.id, coalesce(list_filter(l, lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ({STOP_SQL})), []) AS lemmas FROM dt LEFT JOIN (SELECT id, list(lemma ORDER BY pos) AS l FROM el GROUP BY id) USING (id))"""


def document_lemmas(spark, sf_dir) -> DataFrame:
    docs = sinks.scratch(documents(spark, sf_dir))
    return lemmas.lemmatised(docs, lemmas.lemma_map(docs.select(F.explode("tokens").alias("term"))))


@query("lemma_texts", f"WITH {LEMMAS_SQL} SELECT id, CAST(len(lemmas) AS INTEGER) AS n, CAST(len(list_distinct(lemmas)) AS INTEGER) AS n_distinct, md5(array_to_string(lemmas, ' ')) AS said FROM le")
def lemma_texts(spark, sf_dir):
    return document_lemmas(spark, sf_dir).select("id", F.size("lemmas").alias("n"), F.size(F.array_distinct("lemmas")).alias("n_distinct"), F.md5("text").alias("said"))


@query("lemma_tfidf", f"""
WITH {LEMMAS_SQL}, n AS (SELECT count(*) AS n FROM le),
g AS (SELECT id, unnest(list_concat(lemmas, CASE WHEN len(lemmas) >= 2 THEN list_transform(range(1, len(lemmas)), lambda i: lemmas[i] || ' ' || lemmas[i + 1]) ELSE [] END)) AS term FROM le),
tf AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM n)),
x AS (SELECT id, term, (1 + ln(CAST(tf AS DOUBLE))) * (1 + ln((1.0 + (SELECT n FROM n)) / (1.0 + df))) AS x FROM tf JOIN df USING (term)),
w AS (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x)
SELECT id, count(*) AS n, round(sum(w), 4) AS total, round(max(w), 6) AS most FROM w GROUP BY id""")  # fmt: skip
def lemma_tfidf(spark, sf_dir):
    """Weights of lemmas and pairs of lemmas, from the lemma texts."""
    docs = sinks.scratch(document_lemmas(spark, sf_dir).select("id", F.when(F.col("text") != "", F.split("text", " ")).otherwise(F.expr("cast(array() as array<string>)")).alias("tokens")))
    return tfidf.tfidf(docs, docs.count()).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("w"), 4).alias("total"), F.round(F.max("w"), 6).alias("most"))


@query("min_score_filter", f"WITH {C4_SQL} SELECT anchor, count(*) AS n, count(*) FILTER (score >= 50) AS high FROM top WHERE score >= 25 GROUP BY anchor")
def min_score_filter(spark, sf_dir):
    top = best_overlaps(spark, sf_dir).where("score >= 25")
    return top.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= 50).alias("high"))
