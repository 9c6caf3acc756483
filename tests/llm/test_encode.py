"""Encoding against the plain tokenizer, including texts that are cut."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import encode


@pytest.fixture(scope="module")
def codec():
    return encode.codec(encode.read_vocabulary(encode.default_vocabulary()))


def in_pieces(codec, text, piece):
    out, parts = [], []
    for go, body in encode.cut_text(text, piece):
        if go is not True and parts:
            out += codec.tree(parts)
            parts = []
        if go is None:
            out += codec.text(body.decode()).tolist()
        else:
            parts.append(codec.word(body))
    return out + codec.tree(parts)


ALPHABETS = ["ab", "a'srevlmdt ", "0123456789", " \n\t", "-=_'", "aé漢字ß", "abc ABC 12 .,'\n", "=- \n's", "　  x"]


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(ALPHABETS).flatmap(lambda a: st.text(alphabet=a, max_size=400)), st.integers(4, 60))
def test_pieces_equal_whole(codec, text, piece):
    assert in_pieces(codec, text, piece) == codec.text(text).tolist()


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.integers(4, 40))
def test_pieces_equal_whole_any_text(codec, text, piece):
    assert in_pieces(codec, text, piece) == codec.text(text).tolist()


def test_long_unsplit_words(codec):
    rng = random.Random(5)
    for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "the", "漢字語", "=-"):
        text = "".join(rng.choice(letters) for _ in range(30_000))
        assert in_pieces(codec, text, 1000) == codec.text(text).tolist()


@pytest.mark.parametrize("blank", ["\n\n", "\r\n", "\r\n\r\n", " \n", "\n\n ", "\t\t", "\u3000\u3000", "\n" * 50])
def test_white_space_before_a_cut(spark, codec, blank):
    texts = ["abc" + blank + "x" * 400, "abc" + blank + "=" * 400 + blank + "漢" * 400 + blank, blank + "9" * 400 + blank + "é" * 300, "漢" * 39 + blank + "漢" * 300, ("漢" * 7 + blank) * 60]
    for text in texts:
        for piece in (8, 20, 40, 41, 42):
            assert in_pieces(codec, text, piece) == codec.text(text).tolist()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: list(r.ids) for r in encode.encode_corpus(df, piece=40).collect()} == {k: codec.text(t).tolist() for k, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in encode.encode_corpus(df, piece=40, counts_only=True).collect()} == {k: len(codec.text(t)) for k, t in enumerate(texts)}


def test_corpus(spark, codec):
    big = "word " * 3000 + "x" * 5000 + "'s " + "ab" * 4000
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, "  \n ", "x"), (5, "<|endoftext|> a", "x"), (6, big, "x"), (6, big, "x"), (None, big, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encode.encode_corpus(df, piece=1000).collect()), key=str)
    assert got == sorted(((i, codec.text(t or "").tolist()) for i, t, _ in rows), key=str)
    counts = sorted(((r.doc_id, r.n_tokens) for r in encode.encode_corpus(df, piece=1000, counts_only=True).collect()), key=str)
    assert counts == sorted(((i, len(codec.text(t or ""))) for i, t, _ in rows), key=str)
    assert encode.encode_corpus(df.limit(0)).count() == 0
