"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Null and empty texts pass through: they are not
toxic, count as equal and near copies of each other, hold no benchmark item and encode to no tokens. Rows are told apart by doc_id and
text: a text goes only for what it holds itself, whatever other texts its doc_id has, and a null doc_id is an id like any other. Extra
columns of documents stay until the last stage. Texts do not move but for those that a screen of the rows to drop lets pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, decontaminate, exact, simhash, toxicity
from textloom.llm.common import discard, drop_rows, materialise, read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, does not call toxic."""
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model, "stage score", "stage predicted").where("`stage predicted` = 0").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space the longest, then the one with the smallest doc_id."""
    return exact.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked fingerprints the document with the smallest doc_id."""
    return drop_rows(docs, simhash.near_copies(docs), {"text_hash": text_hash()})


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return drop_rows(docs, decontaminate.found_in_texts(docs, read_table(spark, sf_dir, "benchmark")), {"text_hash": text_hash()})


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (unsigned 32-bit little-endian) and whether they decode to the text."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")))
    return bpe.decode(encoded).select(
        "doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", tokenise),
]
#: SQL has no byte-pair encoding, classifier or fingerprint of this kind; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder before the next one reads it."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
