"""Ids against the public libraries, byte for byte."""

import random

import pytest

from tallyloom.llm import encode

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoder():
    return encode.Tokenizer.load().encoder()


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


TEXTS = ["", " ", "\n\n", "Hello world", "<|endoftext|> text", "naïve café — 数据 🙂​", "don't  stop\t\tnow", "x" * 3000, "ab" * 2000, "é" * 500, "\x00\x07", "１２ ﬁ", "a" + "́" * 50]


def test_texts(encoder, library):
    for t in TEXTS:
        assert encoder.encode(t) == library.encode_ordinary(t), t[:20]
    assert encoder.encode(None) == []


def test_random_words(encoder, library):
    rng = random.Random(3)
    for _ in range(400):
        t = "".join(rng.choice("abcdefghij éß數🙂 '-\n12") for _ in range(rng.randrange(80)))
        assert encoder.encode(t) == library.encode_ordinary(t)


def test_merges_take_the_leftmost_least_rank():
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"aa": 0, b"aaa": 1}
    assert encode.merge_word(b"aaaa", ranks) == [0, 0] or encode.merge_word(b"aaaa", ranks) == [1, 1000 + 97]
    tree = encode.MergeTree([5, 3, 3, 9])
    assert tree.leftmost() == 1
    tree.update(1, encode.NEVER)
    assert tree.leftmost() == 2


def test_vocabulary_is_checked():
    with pytest.raises(ValueError, match="single bytes"):
        encode.Encoder({b"a": 0}, ".")


def test_frames(spark):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello", "y")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode.encode(df, encode.Tokenizer.load()).collect())
    assert got == [(1, [15496]), (1, [15496]), (2, []), (3, [])]
    counts = sorted((r.doc_id, r.n_tokens) for r in encode.token_counts(df, encode.Tokenizer.load()).collect())
    assert counts == [(1, 1), (1, 1), (2, 0), (3, 0)]
    assert encode.encode(df.limit(0), encode.Tokenizer.load()).count() == 0
