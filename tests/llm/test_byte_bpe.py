"""Byte-level BPE against the public library with the same ranks and pattern."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corpus_rows import empty, hard, small  # noqa: F401  (fixtures)
from survspan.llm import byte_bpe


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.codec()


@pytest.fixture(scope="module")
def library(bpe):
    import public_tokenizers

    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def test_hash_is_minimal_and_perfect():
    for n in (0, 1, 2, 3, 1000):
        keys = [f"key{i * i}".encode() for i in range(n)]
        made = byte_bpe.MinimalPerfectHash(keys)
        lengths = np.array([*map(len, keys)], np.int64)
        slots = made.slots(np.frombuffer(b"".join(keys), np.uint8), np.cumsum(lengths) - lengths, lengths)
        assert sorted(slots.tolist()) == list(range(n))


def test_every_token_is_its_own_id(bpe):
    tokens = pa.array([*bpe.ranks], pa.large_binary())
    flat, count = bpe._lookup(tokens)
    assert (count == 1).all() and flat.tolist() == [*bpe.ranks.values()]


PARTS = ["a", "b", "the", "ing", " ", "\n", "\t", "é", "ß", "日本", "1", "23", "'s", "'ll", "<|endoftext|>", ".", "!!",
         "　", "\x85", "\x1c", "😀", "ab" * 40, "\x00", "ﬁ", "İ", "x́"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=5), st.sampled_from([1 << 21, 30]))
def test_ids_match_the_library(bpe, library, texts, slice_chars):
    before = byte_bpe.SLICE_CHARS, byte_bpe.SLICE_PIECES
    byte_bpe.SLICE_CHARS, byte_bpe.SLICE_PIECES = slice_chars, 7
    try:
        got = [x.tolist() for x in bpe.encode(texts)]
    finally:
        byte_bpe.SLICE_CHARS, byte_bpe.SLICE_PIECES = before
    assert got == [library.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x).decode() for x in got] == texts


def test_long_pre_token(bpe, library):
    text = "ab" * 60_000 + "a" * 60_000 + " " * 5000 + "x"
    assert next(bpe.encode([text])).tolist() == library.encode_ordinary(text)


def test_forgetting_changes_nothing(library):
    import public_tokenizers

    few = byte_bpe.ByteBPE(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN, remembered=1)
    texts = ["zqx wvut zqx", "wvut kjhg zqx", "zqx"]
    for _ in range(2):
        assert [x.tolist() for x in few.encode(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("table", ["hard", "small", "empty"])
def test_query(table, request, library):
    docs = request.getfixturevalue(table)
    want = []
    for r in docs.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.op13_byte_bpe(docs).collect()), key=str) == sorted(want, key=str)


def test_columns_there_and_back(spark, hard, library):
    """Other columns stay, also those of the operator's own names; the text comes back from the ids alone."""
    docs = hard.selectExpr("doc_id", "text", "doc_id as row", "size as raw", "lang as `a.b`")
    there = byte_bpe.encoded(docs)
    back = byte_bpe.decoded(there.drop("text")).collect()
    want = {(r.doc_id, r.row, r["raw"], r["a.b"], r.text or "") for r in docs.collect()}
    assert {(r.doc_id, r.row, r["raw"], r["a.b"], r.decoded.decode()) for r in back} == want
    assert all(r.ids == library.encode_ordinary(r.text or "") for r in there.collect())
    again = byte_bpe.encoded(docs.selectExpr("doc_id", "text", "'old' as ids"))
    assert dict(again.dtypes)["ids"] == "array<int>"
    assert byte_bpe.decoded(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == b""
