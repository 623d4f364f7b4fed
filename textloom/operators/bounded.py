"""Overlap joins that do not look at all pairs: the best k candidates under score bounds, and all pairs that share at least two terms.

Best k. The score of a pair grows with its shared weight and count, so what an anchor's terms still to come could add bounds the score of
every candidate not met so far. Candidates are kept in classes by their own weight: a heavy document's union is large, so in its class
fewer of the anchor's terms, the rarest, have to be looked up before no new candidate can reach the k-th best. A lower bound of that
k-th best comes from the rarest terms' candidates, scored exactly. Frequent terms, whose lists are long, are mostly met only when a pair
that may win is scored.

Two shared terms. Each id's terms are in one order, the rarest first, and a pair is made only at its first shared term, so no pair is made
twice and none is counted in a shuffle; an id's last term leads to no pair. Terms of very many ids lead only as pairs of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.scores import jaccard, recall
from textloom.operators.overlap import cross_scores, top_k
from textloom.sources.sinks import scratch

#: List entries of an anchor's rarest terms that the first look reads; longer lists give an even part of theirs, as only a bound comes of it.
FIRST_LOOK = 1000
#: Of the candidates found so, this many times k are scored exactly.
FIRST_SCORED = 2
#: Terms are looked up until no new candidate can reach this share of the bound: a few lists more, and far fewer pairs to score.
DEEPER = 0.25
#: Terms of all anchors, each in some forty classes at most, that go to all tasks instead of a shuffle of all that they meet.
SMALL_SIDE = 20_000
#: A term of more ids than this leads to pairs only together with another such term.
HEAVY = 1000
#: List entries that are looked up for all anchors without bounds: with so few, each further step costs more than it spares.
FULL_LOOK = 5_000_000
#: Bounds are raised by this much, so that sums in another order do not lose a pair.
SLACK = 1e-9


def _class_of(other: Column) -> Column:
    """Two classes for each doubling of a candidate's weight."""
    return F.floor(2 * F.log2(F.greatest(other, F.lit(1.0)))).cast("int")


def weighted_sets(rows: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """key, terms (w, term; the heaviest first), total. rows: id, term. weights: term, idf; a term without a weight weighs 1."""
    w = rows.select(F.col("id").alias(key), "term").join(weights.select("term", "idf"), "term", "left").withColumn("w", F.coalesce("idf", F.lit(1.0)))
    terms = F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "term")))
    sets = w.groupBy(key).agg(terms.alias("terms"), F.sum("w").alias("total"))
    return sets.select(key, F.transform("terms", lambda x: F.struct((-x["o"]).alias("w"), x["term"].alias("term"))).alias("terms"), "total")


def numbered_terms(weights: DataFrame) -> DataFrame:
    """Weights with a number for each term. Write them before use: other runs may give other numbers."""
    return weights.withColumn("number", F.monotonically_increasing_id())


def _exact(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (anchor, cand) with all figures of weighted_overlap, raw and score."""
    met = pairs.join(right, "cand").join(left, "anchor")
    met = met.withColumn("shared", F.array_intersect("numbers", "names")).withColumn("k", F.size("shared").cast("long"))
    inter = F.aggregate("shared", F.lit(0.0), lambda s, x: s + F.element_at("weigh", x))
    met = met.withColumn("inter", inter).withColumn("recall", recall(F.col("inter"), F.col("base"))).withColumn("jaccard", jaccard(F.col("inter"), F.col("base"), F.col("other")))
    return cross_scores(met).select("anchor", "cand", "k", "inter", "base", "other", "recall", "jaccard", "raw", "score")


def _bound(inter: Column, k: Column, base: Column, other: Column) -> Column:
    """The highest score of a pair that shares at most so much and so many."""
    most = F.least(inter, base, other)
    raw = cross_scores.raw(jaccard(most, base, other), recall(most, base), k) + SLACK
    return cross_scores.score(raw)


class TopOverlap:
    """The best k candidates of each anchor by the lexical score. Sets of term numbers are written once and read by every step; terms that
    no anchor has count in a candidate's weight alone. A term without a weight weighs 1, but weights that have numbers already (see
    numbered_terms) must have all terms of the anchors."""

    def __init__(self, anchors: DataFrame, candidates: DataFrame, weights: DataFrame, k: int = 50):
        self.k = k
        if "number" not in weights.columns:
            weights = scratch(numbered_terms(anchors.select("term").unionAll(weights.select("term")).distinct().join(weights.select("term", "idf"), "term", "left")))
        known = weights.select("term", F.coalesce("idf", F.lit(1.0)).alias("w"), "number")
        rows = anchors.select(F.col("id").alias("anchor"), "term").join(known, "term")
        terms = F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("w"), "term", "number")))
        sets = rows.groupBy("anchor").agg(terms.alias("terms"), F.sum("w").alias("base"))
        self.left = scratch(sets.select("anchor", "base", F.col("terms.number").alias("numbers"), F.transform("terms.w", lambda w: -w).alias("ws")).withColumn("weigh", F.map_from_arrays("numbers", "ws")))
        asked = anchors.select("term").distinct().withColumn("asked", F.lit(True))
        rows = candidates.select(F.col("id").alias("cand"), "term").join(known.join(asked, "term", "left"), "term", "left")
        self.right = scratch(rows.groupBy("cand").agg(F.collect_list(F.when(F.col("asked"), F.col("number"))).alias("names"), F.sum(F.coalesce("w", F.lit(1.0))).alias("other")))
        self.lists = self._lists(self.right)
        self.terms = self.left.agg(F.sum(F.size("ws"))).first()[0] or 0
        # few rows become very many in the steps that follow, so they are dealt out in a number of parts that adaptive execution keeps
        self.parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        each = self.left.repartition(self.parts, "anchor").select("anchor", "base", F.size("ws").alias("size"), F.posexplode(F.arrays_zip("numbers", "ws")).alias("place", "x"))
        self.each = each.select("anchor", "base", "size", "place", F.col("x.numbers").alias("number"), F.col("x.ws").alias("w"))

    def _lists(self, right: DataFrame) -> DataFrame:
        return right.select("cand", "other", _class_of(F.col("other")).alias("class"), F.explode("names").alias("number"))

    def thresholds(self) -> DataFrame:
        """anchor, least, least_k, least_cand: score, k and -cand of the k-th best candidate among some that are scored, which is no better
        than the true k-th best; for anchors that surely have k candidates."""
        df = self.lists.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
        before = F.sum("df").over(Window.partitionBy("anchor").orderBy("place")) - F.col("df")
        first = self.each.join(df, "number").repartition(self.parts, "anchor").withColumn("before", before).where(F.col("before") < FIRST_LOOK)
        first = first.withColumn("part", F.ceil(F.col("df") / FIRST_LOOK))
        met = first.join(self.lists.select("number", "cand", "other"), "number").where(F.pmod(F.xxhash64("cand"), F.col("part")) == 0)
        met = met.groupBy("anchor", "cand").agg(F.sum("w").alias("inter"), F.count(F.lit(1)).alias("k"), F.first("base").alias("base"), F.first("other").alias("other"))
        raw = cross_scores.raw(jaccard(F.col("inter"), F.col("base"), F.col("other")), recall(F.col("inter"), F.col("base")), F.col("k"))
        best = top_k(met.withColumn("raw", raw), ["anchor"], [F.desc("raw"), F.asc("cand")], FIRST_SCORED * self.k).select("anchor", "cand")
        order = [F.desc("score"), F.desc("k"), F.asc("cand")]
        kth = top_k(_exact(best, self.left, self.right).select("anchor", "cand", "k", "score"), ["anchor"], order, self.k).where(F.col("rank") == self.k)
        return kth.select("anchor", F.col("score").alias("least"), F.col("k").alias("least_k"), (-F.col("cand")).alias("least_cand"))

    def survivors(self) -> DataFrame:
        """anchor, cand: all pairs that can be among the best k."""
        top = F.coalesce(self.right.select(F.max(_class_of(F.col("other")))).scalar(), F.lit(0))
        own = Window.partitionBy("anchor").orderBy("place")
        rows = self.each.join(self.thresholds(), "anchor", "left").withColumn("least", F.coalesce("least", F.lit(-1)))
        rows = rows.withColumn("rest", F.col("base") - F.sum("w").over(own) + F.col("w")).withColumn("more", F.col("size") - F.col("place"))
        rows = rows.withColumn("class", F.explode(F.sequence(F.lit(0), top)))
        low = F.pow(F.lit(2.0), F.col("class") / 2) * (1 - SLACK)
        needed = rows.where(_bound(F.col("rest"), F.col("more"), F.col("base"), F.greatest(low, F.col("rest"))) >= DEEPER * F.col("least"))
        cell = Window.partitionBy("anchor", "class")
        needed = needed.withColumn("left", F.col("base") - F.sum("w").over(cell)).withColumn("count_left", F.col("size") - F.count(F.lit(1)).over(cell))
        needed = needed.select("anchor", "base", "least", "least_k", "least_cand", "number", "class", "w", "left", "count_left")
        lists = self.lists
        if self.terms <= SMALL_SIDE:  # then candidates stay where they are, and a pair's terms meet in one task without a shuffle of pairs
            needed, lists = F.broadcast(needed), self._lists(self.right.repartition(self.parts, "cand"))
        first = {c: F.first(c).alias(c) for c in ("base", "other", "least", "least_k", "least_cand", "left", "count_left")}
        met = needed.join(lists, ["number", "class"]).groupBy("anchor", "cand").agg(F.sum("w").alias("inter"), F.count(F.lit(1)).alias("k"), *first.values())
        most = F.col("k") + F.col("count_left")
        place = lambda score, k, cand: F.struct(score.alias("score"), k.cast("long").alias("k"), cand.alias("cand"))
        may = place(_bound(F.col("inter") + F.col("left"), most, F.col("base"), F.col("other")), most, -F.col("cand"))
        # What has been looked up so far bounds from below too, and by more terms than the first look.
        raw = cross_scores.raw(jaccard(F.col("inter"), F.col("base"), F.col("other")), recall(F.col("inter"), F.col("base")), F.col("k")) - SLACK
        met = met.where(may >= place(F.col("least"), F.coalesce("least_k", F.lit(0)), F.coalesce("least_cand", F.lit(0))))
        met = scratch(met.select("anchor", "cand", may.alias("may"), place(cross_scores.score(raw), F.col("k"), -F.col("cand")).alias("sure")))
        kth = top_k(met, ["anchor"], [F.desc("sure")], self.k).where(F.col("rank") == self.k).select("anchor", F.col("sure").alias("bar"))
        lowest = F.struct(F.lit(-1).alias("score"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("cand"))
        bars = self.left.select("anchor").join(kth, "anchor", "left").select(F.col("anchor").alias("its"), F.coalesce("bar", lowest).alias("bar"))
        return met.join(bars, (F.col("anchor") == F.col("its")) & (F.col("may") >= F.col("bar"))).select("anchor", "cand")

    def entries(self) -> int:
        """List entries of all anchors' terms: how many rows make all pairs."""
        df = self.lists.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
        return self.each.join(df, "number").agg(F.sum("df")).first()[0] or 0

    def pairs(self) -> DataFrame:
        """anchor, cand with figures, raw and score: those that can be among the best k, or all where they are few."""
        if self.entries() > FULL_LOOK:
            return _exact(self.survivors(), self.left, self.right)
        met = self.each.join(self.lists.select("number", "cand", "other"), "number")
        met = met.groupBy("anchor", "cand").agg(F.sum("w").alias("inter"), F.count(F.lit(1)).alias("k"), F.first("base").alias("base"), F.first("other").alias("other"))
        return cross_scores(met.withColumn("recall", recall(F.col("inter"), F.col("base"))).withColumn("jaccard", jaccard(F.col("inter"), F.col("base"), F.col("other"))))

    def best(self) -> DataFrame:
        """anchor, cand, figures, raw, score, rank."""
        return top_k(self.pairs(), ["anchor"], [F.desc("score"), F.desc("k"), F.asc("cand")], self.k)


def pairs_of_two(rows: DataFrame, weights: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """anchor, cand, k, inter, base, other, recall, jaccard of all pairs of one corpus with at least two shared terms, either way round.

    rows: id, term, different terms of each id. weights: term, df, idf. A pair all of whose shared terms are frequent is made at its
    first two of them; any other at its first, which is not frequent and so has at most ``heavy`` ids."""
    sets = weighted_sets(rows, weights, "id").where(F.size("terms") >= 2)
    frequent = weights.where(F.col("df") > heavy).select("term")
    many = rows.join(frequent, "term", "left_semi").groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("many"))
    sets = scratch(sets.join(many, "id", "left").select("id", F.col("terms.term").alias("names"), F.col("terms.w").alias("ws"), F.col("total").alias("base"), F.coalesce("many", F.lit(0)).alias("many")))
    few = F.size("names") - F.col("many")  # frequent terms stand last, as weights fall with df
    light = sets.withColumn("lead", F.explode(F.slice("names", F.lit(1), F.least(few, F.size("names") - 1))))
    heavies = F.slice("names", few + 1, F.col("many"))
    two = F.flatten(F.transform(heavies, lambda x, i: F.transform(F.slice(heavies, i + 2, F.size(heavies)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    dark = sets.where("many >= 2").withColumn("lead", F.explode(two))
    out = None
    for led, first in ((light, lambda s: s[0] == F.col("x.lead")), (dark, lambda s: (s[0] == F.col("x.lead.a")) & (s[1] == F.col("x.lead.b")))):
        x, y = led.alias("x"), led.select("id", "names", "base", "lead").alias("y")
        met = x.join(y, (F.col("x.lead") == F.col("y.lead")) & (F.col("x.id") < F.col("y.id")))
        met = met.withColumn("shared", F.array_intersect("x.names", "y.names")).where((F.size("shared") >= 2) & first(F.col("shared")))
        inter = F.aggregate(F.filter(F.arrays_zip("x.names", "x.ws"), lambda z: F.array_contains(F.col("shared"), z["names"])), F.lit(0.0), lambda s, z: s + z["ws"])
        found = met.select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), F.size("shared").cast("long").alias("k"), inter.alias("inter"), F.col("x.base").alias("p"), F.col("y.base").alias("q"))
        out = found if out is None else out.unionAll(found)
    way = lambda a, b, p, q: F.struct(F.col(a).alias("anchor"), F.col(b).alias("cand"), F.col(p).alias("base"), F.col(q).alias("other"))
    both = out.select("k", "inter", F.explode(F.array(way("i", "j", "p", "q"), way("j", "i", "q", "p"))).alias("w")).select("w.anchor", "w.cand", "k", "inter", "w.base", "w.other")
    return both.withColumn("recall", recall(F.col("inter"), F.col("base"))).withColumn("jaccard", jaccard(F.col("inter"), F.col("base"), F.col("other")))
