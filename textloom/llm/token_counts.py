"""Token counts: texts travel to Python in Arrow batches, and only the number of their tokens comes back.

Texts of any length are counted whole. A long one is cut first, at places where the tokenizer starts a new piece whatever stands on
either side, so the parts' counts add up to the text's. Parts are packed into batches of about the same number of bytes, which bounds
what the library holds at a time: neither a very long text nor many short ones make a batch large. A text without such a place (one word
of a megabyte, a megabyte of blanks) is one part, as its tokens may depend on all of it.

Defined results: a null or empty text has no tokens. Special strings inside a text are what the library takes them for by default: the
added tokens of a .json file count as one token each. Counts depend on the text alone, so equal rows give equal counts, and ids may repeat
or be null. ``count_tokens`` keeps the other columns; one that is named like the result gives way to it.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import blocks, read_table, small_batches

VOCABULARY = "byte_bpe_50k.json"
#: Tokens of one training sequence: op11 marks texts that have more.
LIMIT = 1024
#: A part ends at the first safe place behind so many characters; a batch has about so many bytes.
PART_CHARS, BATCH_BYTES = 1 << 15, 1 << 19
#: Where a byte-level pre-tokenizer with its usual pattern ends a piece whatever follows: before white space that follows something else,
#: between Latin letters and digits, and before an ideographic comma or stop that follows a letter or digit. Characters whose class differs
#: between versions of Unicode are left out.
SAFE = re.compile(
    r"(?<=[!-~¡-ᙿⰀ-⿿、-퟿])(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[0-9A-Za-zぁ-ゖァ-ヺ一-鿌])(?=[、。，])"
)


def parts_of(text: str, chars: int) -> list[str]:
    """The text in parts of about ``chars`` characters, cut at safe places; joined they are the text."""
    out, start = [], 0
    while len(text) - start > chars and (m := SAFE.search(text, start + chars)):
        out.append(text[start : m.start()])
        start = m.start()
    out.append(text[start:])
    return out


def cuttable(vocabulary: dict) -> bool:
    """Whether a tokenizer of the .json kind splits texts as SAFE assumes."""
    pre = vocabulary.get("pre_tokenizer") or {}
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or SAFE.search(t["content"])) for t in vocabulary.get("added_tokens", []))
    return bool(byte_level and plain and not vocabulary.get("normalizer"))


@lru_cache(2)
def _counter(content: bytes, kind: str):
    """A function from texts to their numbers of tokens, and whether texts may be cut."""
    if kind == ".json":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(content)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return (lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]), cuttable(json.loads(content))
    if kind == ".model":
        from sentencepiece import SentencePieceProcessor

        pieces = SentencePieceProcessor(model_proto=content)
        return (lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]), False
    raise ValueError(f"no library counts with a {kind} file")


def counts_of(texts: list[str], content: bytes, kind: str, chars: int = PART_CHARS, batch: int = BATCH_BYTES) -> np.ndarray:
    """Tokens of each text."""
    count, cut = _counter(content, kind)
    parts, owner = [], []
    for i, text in enumerate(texts):
        own = parts_of(text, chars) if cut and len(text) > chars else [text]
        parts += own
        owner += [i] * len(own)
    sizes = [len(p.encode("utf-8", "surrogatepass")) for p in parts]
    found = [n for a, b in blocks(sizes, batch) for n in count(parts[a:b])]
    return np.bincount(np.array(owner, np.int64), np.array(found, np.float64), len(texts)).astype(np.int64)


def count_tokens(df: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """The given columns but the text, and n_tokens (long). vocabulary: the path of a .json file of tokenizers or a .model file of
    sentencepiece, read on the driver and sent with the tasks (some MB)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, "rb") as f:
        shared, kind = df.sparkSession.sparkContext.broadcast(f.read()), os.path.splitext(vocabulary)[1]
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text, "n_tokens")]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField("n_tokens", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            counts = counts_of([t or "" for t in batch.column(len(rest)).to_pylist()], shared.value, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(counts, pa.int64())], [*rest, "n_tokens"])

    return df.select(*rest, text).mapInArrow(run, schema)


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text of documents, and whether it has more tokens than a training sequence."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return count_tokens(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
