"""Token counts against the library itself, text by text."""

import random

import public_tokenizers
import pytest

from tests.llm.helpers import EDGES, hostile, table
from textloom.llm import token_counts
from textloom.llm.token_counts import count_tokens, counts_of, parts_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["<|endoftext|>", "<|endo", "ftext|>", "'s", "'", "'re", "'LL", "é", "日本語", "。", "、", "12", "7a", "a7", "!", "?!", " ", "  ", "\n", "\r\n", "\t", " ", "　", " ", "\x85", "\x1c", "́", "😀", "word", "Ω", "ß", "٣", "Ⅷ", "\0", " ", "​"]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_cuts_change_no_count():
    random.seed(11)
    texts = ["".join(random.choice(ODD) for _ in range(random.randrange(1, 60))) for _ in range(3000)]
    content = open(PATH, "rb").read()
    want = library(texts)
    for chars, batch in ((1, 64), (7, 200), (1 << 15, 1 << 19)):
        assert counts_of(texts, content, ".json", chars, batch).tolist() == want
    assert all("".join(parts_of(t, 3)) == t for t in texts)
    assert sum(len(parts_of(t, 3)) for t in texts) > 2 * len(texts)


def test_long_texts_make_bounded_parts():
    assert max(map(len, parts_of("some words " * 100_000, 1 << 10))) < (1 << 10) + 12
    assert max(map(len, parts_of("日本語の文、" * 50_000, 1 << 10))) < (1 << 10) + 12
    assert parts_of("a" * 100_000, 1 << 10) == ["a" * 100_000]  # one word


def test_kinds_of_vocabularies(spark):
    texts = ["Hello  World, it's 2024!", "", None, "ein Satz\nund noch einer " * 4000]
    df = table(spark, list(enumerate(texts)))
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    t, p = Tokenizer.from_file(word), SentencePieceProcessor(model_file=piece)
    for path, count in ((word, lambda x: len(t.encode(x, add_special_tokens=False).ids)), (piece, lambda x: len(p.encode(x)))):
        got = {r.doc_id: r.n_tokens for r in count_tokens(df, path).collect()}
        assert got == {i: count(x or "") for i, x in enumerate(texts)}
    with pytest.raises(ValueError):
        token_counts._counter(b"", ".txt")


def test_op11(spark, tmp_path):
    rows = [*EDGES, (None, "no id"), (5, "x <|endoftext|> y"), (11, "many words here " * 30_000), (12, " " * 50_000), (13, "k" * 20_000)]
    hostile(table(spark, rows)).selectExpr("*", "'x' as n_tokens", "'y' as n_bytes", "'z' as over_limit").write.parquet(f"{tmp_path}/documents.parquet")
    want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(rows, library([t or "" for _, t in rows]), strict=True)]
    got = [tuple(r) for r in token_counts.op11_token_counts(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    table(spark, []).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_counts.op11_token_counts(spark, f"{tmp_path}/none").count() == 0
