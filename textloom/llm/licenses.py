"""License scans as an exact set-similarity join, in DataFrame operations alone.

Text blocks are lines and, in the registered query, runs of consecutive lines that can hold a template, as notices are wrapped; license templates are short word sets. A block holds a template when it has at least ``threshold`` of the
template's different words. Words are ordered by how many documents have them, rarest first. A block that holds a template
shares a word with the template's prefix in this order, is long enough, and at the place of the first shared word enough words
are left on both sides; only what passes these filters is verified by intersection. The templates are a parameter of the
operator and small by nature, so their prefixes travel with the plan as literals; document words are only exploded for blocks
that have a prefix word. Base phrases are counted beside, word by word, in every text.

Defined results: a null text is empty: no words, no places, null first and last word, no labels, score 0. Every
template at the threshold gives its label, but of several of one family (FAMILIES: notices that differ in a word or a number) in a
block only those with the highest containment, all of them at a tie. Repeated rows get the same result. An empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import id_and_text, read_table

#: Base phrases and their labels.  Fixed values.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
#: Sentences that stand for a license, with the method's labels.  Fixed values, from the licenses' usual notices.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "Licensed under the GNU Lesser General Public License."),
    ("agpl", "Licensed under the GNU Affero General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0."),
    ("proprietary", "All rights reserved."),
]
THRESHOLD = 0.8
#: Labels whose sentences differ in so few words that one notice reaches the threshold of several. Others are families of their own.
FAMILIES = {x: "gnu" for x in ("gpl-2.0", "gpl-3.0", "lgpl", "agpl")} | {x: "cc-by" for x in ("cc-by-4.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0")}
#: What stands between words: ASCII other than letters and digits. A-Z is lower-cased before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() changes other letters too, which no template has; two of them would become ASCII and are kept apart."""
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("￭")), F.lit("İ"), F.lit("￮")))


def words_of(text: Column) -> Column:
    return F.filter(F.split(lowered(text), GAP), lambda w: w != "")


def _tokens(sentence: str) -> list[str]:
    import re

    return list(dict.fromkeys(w for w in re.split(GAP, sentence.lower()) if w))


def _length(sentence: str) -> int:
    import re

    return len([w for w in re.split(GAP, sentence) if w])


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def base_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: _all([F.get(words, i + k) == p for k, p in reversed(list(enumerate(parts)))]))
    return F.when(F.size(words) >= len(parts), at).otherwise(F.expr("cast(array() as array<int>)"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def word_order(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents have each word of the templates: a row for each word of this parameter, however large the corpus."""
    found = id_and_text(docs).select(F.explode(F.array_intersect(F.array_distinct(words_of(F.col("text"))), _texts(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}


def _line_runs(lines: Column, longest: int) -> Column:
    """Runs of consecutive lines: an array of (first, last, line, inner, own, but_last, but_first).

    lines: array of (line, n, own) of the lines with words. A run's inner words, those of the lines between its first and its last, are
    fewer than ``longest``; both of these lines have words of templates. but_last and but_first are the run's words without that line."""
    none = F.expr("cast(array() as array<string>)")

    def run(first, last, line, inner, own, but_last, but_first):
        return F.struct(first.alias("first"), last.alias("last"), line.alias("line"), inner.alias("inner"), own.alias("own"), but_last.alias("but_last"), but_first.alias("but_first"))

    def from_line(x, i):
        alone = F.array(run(i, i, x["line"], F.lit(0), x["own"], none, none))

        def step(acc, y):
            at = acc["at"] + 1
            longer = F.concat(acc["runs"], F.array(run(i, at, x["line"], acc["inner"], F.array_union(acc["own"], y["own"]), acc["own"], F.array_union(acc["rest"], y["own"]))))
            fits = (acc["inner"] < longest) & (F.size(y["own"]) > 0)
            return F.struct(
                at.alias("at"), (acc["inner"] + y["n"]).alias("inner"), F.array_union(acc["own"], y["own"]).alias("own"), F.array_union(acc["rest"], y["own"]).alias("rest"),
                F.when(fits, longer).otherwise(acc["runs"]).alias("runs"),
            )

        zero = F.struct(i.alias("at"), F.lit(0).alias("inner"), x["own"].alias("own"), none.alias("rest"), alone.alias("runs"))
        # Every line has a word, so no run has more lines than that.
        runs = F.aggregate(F.slice(lines, i + 2, F.lit(longest)), zero, step, lambda acc: acc["runs"]) if longest else alone
        return F.when(F.size(x["own"]) > 0, runs).otherwise(F.slice(alone, 1, F.lit(0)))

    return F.flatten(F.transform(lines, from_line))


def license_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, across_lines: bool = False) -> DataFrame:
    """doc_id, row_id, label, containment and line (the first line's number, from 0) of each block that holds a template, with the
    block's first and last place among the text's lines with words.

    docs: doc_id, text and row_id, which tells different rows apart. Blocks are lines; with ``across_lines`` also runs of lines."""
    sets = [(label, _tokens(t)) for label, t in templates]
    order = word_order(docs, sorted({w for _, t in sets for w in t}))
    words_in_order = sorted(order, key=order.get)
    rows, needs = [], []
    for number, (label, tokens) in enumerate(sets):
        tokens = sorted(tokens, key=order.get)
        need = math.ceil(threshold * len(tokens) - 1e-9)
        needs.append((tokens, need))
        # A template's words and as many strange ones as it may lack stand in this many words; two of them are on the outer lines.
        inner = math.ceil(_length(templates[number][1]) / threshold) - 2
        for i, w in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((number, label, w, i, len(tokens), need, tokens, max(0, inner)))
    schema = "template int, label string, word string, t_at int, t_size int, need int, t_words array<string>, most_inner int"
    prefix = docs.sparkSession.createDataFrame(rows, schema)
    prefix_words = sorted({r[2] for r in rows})
    longest = max((r[7] for r in rows), default=-1) + 1 if across_lines else 0
    # A text that lacks the words of every template has no block to look at; few texts are left to be split into lines.
    vocabulary = F.filter(words_of(F.col("text")), lambda w: w.isin(words_in_order))
    likely = docs.select("row_id", "doc_id", "text", F.array_distinct(vocabulary).alias("has"))
    enough = [F.size(F.array_intersect("has", _texts(tokens))) >= need for tokens, need in needs]
    likely = likely.where(~_all([~e for e in enough])) if enough else likely.limit(0)
    lines = F.transform(F.transform(F.split("text", "\n"), words_of), lambda w, i: F.struct(i.alias("line"), F.size(w).alias("n"), F.array_distinct(F.filter(w, lambda x: x.isin(words_in_order))).alias("own")))
    lines = likely.select("row_id", "doc_id", F.filter(lines, lambda x: x["n"] > 0).alias("lines"))
    found = lines.select("row_id", "doc_id", F.explode(_line_runs(F.col("lines"), longest)).alias("run")).select("row_id", "doc_id", "run.*")
    found = found.where(F.arrays_overlap("own", _texts(prefix_words)))
    # The block's words that any template has, in the global order.
    found = found.withColumn("own", F.array_intersect(_texts(words_in_order), F.col("own")))
    exploded = found.select("*", F.posexplode("own").alias("b_at", "word")).where(F.col("word").isin(prefix_words))
    met = exploded.join(F.broadcast(prefix), "word").where((F.size("own") >= F.col("need")) & (F.least(F.col("t_size") - F.col("t_at"), F.size("own") - F.col("b_at")) >= F.col("need")))
    met = met.where(F.col("inner") <= F.col("most_inner"))
    # Only at the first shared word, so that a block and a template meet once.
    met = met.where(F.get(F.array_intersect("own", "t_words"), F.lit(0)) == F.col("word"))
    met = met.withColumn("shared", F.size(F.array_intersect("own", "t_words"))).where("shared >= need")
    # A run is a block of its own only where its first and its last line add to it.
    met = met.where((F.size(F.array_intersect("but_last", "t_words")) < F.col("shared")) & (F.size(F.array_intersect("but_first", "t_words")) < F.col("shared")))
    return met.select("doc_id", "row_id", "line", "label", (F.col("shared") / F.col("t_size")).alias("containment"), "first", "last")


def family(label: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in FAMILIES.items() for v in kv])
    return F.coalesce(known[label], label)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, across_lines: bool = False) -> DataFrame:
    """For each row: doc_id, n_words, places (label and start of each base phrase), held (label and containment of the templates that
    its blocks hold; of several templates of a family in one block those with the highest containment)."""
    d = id_and_text(docs).withColumn("row_id", F.xxhash64("doc_id", "text"))
    blocks = license_blocks(d, templates, threshold, across_lines).withColumn("at", F.explode(F.sequence("first", "last")))
    of_block = Window.partitionBy("row_id", "doc_id", "at", family(F.col("label")))  # the blocks that share a line
    blocks = blocks.withColumn("most", F.max("containment").over(of_block)).where("containment = most")
    held = blocks.groupBy("row_id", "doc_id").agg(F.collect_set(F.struct("label", "containment")).alias("held"))
    words = words_of(F.col("text"))
    likely = lowered(F.col("text")).contains("license")
    places = F.concat(*[F.transform(base_places(F.col("words"), p), _labelled(label)) for label, p in PHRASES.items()])
    none = F.expr("cast(array() as array<struct<label: string, at: int>>)")
    base = d.select("row_id", "doc_id", F.size(words).cast("long").alias("n_words"), F.when(likely, words).alias("words"))
    base = base.select("row_id", "doc_id", "n_words", F.when(F.col("words").isNotNull(), places).otherwise(none).alias("places"))
    return base.join(held, ["row_id", "doc_id"], "left").select(
        "doc_id", "n_words", "places", F.coalesce("held", F.expr("cast(array() as array<struct<label: string, containment: double>>)")).alias("held")
    )


def _labelled(label: str):
    return lambda at: F.struct(F.lit(label).alias("label"), at.alias("at"))


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    """Base phrases and held templates of every document."""
    found = scan(read_table(spark, sf_dir, "documents"), across_lines=True)
    starts, base = F.transform("places", lambda x: x["at"]), F.transform("places", lambda x: x["label"])
    every = F.concat(base, F.transform("held", lambda x: x["label"]))
    best = F.coalesce(F.array_max(F.transform("held", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(every)), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
