"""Token counts against the vocabulary's own library."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parcelcover.llm import tokens

ODD = [
    (1, "Hello world  \n\n it's  we'll've 'S<|endoftext|> foo <|endoftext|><|endoftext|>"), (2, None), (3, ""), (4, "   "), (4, "   "), (None, "日本語 テスト x　 y \x1c z\x85"), (None, None),
    (5, "a" * 30_000), (6, "word " * 20_000), (7, "՘a ₝1 \U000323b0 x" * 3), (8, "<|endoftext|>"), (9, "<|endoftext| >"), (10, "\r\n\t x\t\ty 12345 ½²"),
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def want(library, rows):
    n = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    return sorted(((i, b, k, k > 512) for i, b, k in n), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in df.collect()), key=str)


def test_whole_table(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(tokens.token_counts(docs)) == want(library, [(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_and_clashing_columns(spark, library):
    df = spark.createDataFrame([(*r, 1, "x", 3) for r in ODD], "doc_id long, text string, block long, pretoken string, pieces int")
    assert got(tokens.token_counts(df)) == want(library, ODD)
    assert tokens.token_counts(df.limit(0)).collect() == []
    assert got(tokens.token_counts(df.where("text is null"))) == [(2, 0, 0, False), (None, 0, 0, False)]


@pytest.mark.parametrize("entries", [1, 7])
def test_small_blocks(spark, library, monkeypatch, entries):
    """Blocks that end after few pre-tokens give the same counts."""
    monkeypatch.setattr(tokens, "ENTRIES", entries)
    df = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1)
    table = tokens.frequencies(df, "byte_bpe_50k.json")
    assert got(tokens.token_counts(df)) == want(library, ODD)
    assert table.where("pretoken is null").count() == len(ODD)


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_pieces_go_to_their_blocks(spark, monkeypatch, held):
    monkeypatch.setattr(tokens, "HELD", held)
    words = [" the", "xyzzyx", " a"]
    df = spark.createDataFrame([(k, p, t) for k in range(5) for p, t in enumerate(words)], "block long, place int, pretoken string")
    got = {k: {} for k in range(5)}
    for r in tokens.piece_counts(df, "byte_bpe_50k.json").collect():
        got[r.block] |= dict(zip(*(x.tolist() for x in tokens.unpack(r.packed)), strict=True))
    bpe = tokens.load("byte_bpe_50k.json")
    assert got == {k: {p: len(bpe.merge(t)) for p, t in enumerate(words)} for k in range(5)}


def test_random_texts(library):
    random.seed(5)
    bpe = tokens.load("byte_bpe_50k.json")
    letters = [*"abceis'  \n\t.,!1234", "é", "ß", "Σ", "日", "​", "́", "😀", "　", "Ᲊ", "'ll", " the", "<|endoftext|>"]
    for _ in range(400):
        text = "".join(random.choices(letters, k=random.randrange(60)))
        found, special = bpe.pretokens(text)
        assert sum(bpe.pieces(w) * n for w, n in found.items()) + special == len(library.encode(text, add_special_tokens=False).ids)


def test_packing():
    r = np.random.default_rng(3)
    for n in (0, 1, 5, 1000):
        at, count = r.permutation(1 << 20)[:n], r.integers(1, 1 << 20, n)
        back, counted = tokens.unpack(tokens.pack(at, count))
        order = np.argsort(at)
        assert (back == at[order]).all() and (counted == count[order]).all()
