"""Byte-level BPE against the public library, and the joins of the tree on their own."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from logsig.llm import bpe

from .conftest import ODD

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
LEAVES = [(1, 1), (3, 2), (7, 5), (40, 16)]


def ids(codec, text):
    return np.frombuffer(codec.encode(text), "<u4").tolist()


@pytest.mark.parametrize("leaves", LEAVES)
@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'strevlmd  \n\té日😀1_.!-Æ", max_size=80))
def test_tree_equals_library(leaves, text):
    codec = bpe.Codec(RANKS, PATTERN, *leaves)
    assert ids(codec, text) == LIBRARY.encode_ordinary(text)
    assert codec.decode(np.array(ids(codec, text), np.int64)) == text.encode()


@pytest.mark.parametrize("leaves", LEAVES)
def test_long_pieces(leaves):
    draw = random.Random(5)
    texts = ["a" * 3000, "ab" * 1500, "the" * 900, " " * 700, "=" * 999, "'" * 301]
    texts += ["".join(draw.choice("abcdeéthings") for _ in range(900)) for _ in range(20)]
    codec = bpe.Codec(RANKS, PATTERN, *leaves)
    for text in texts:
        assert ids(codec, text) == LIBRARY.encode_ordinary(text)


def test_heap_merges_like_the_scan():
    draw = random.Random(7)
    for _ in range(50):
        piece = "".join(draw.choice("abeinst") for _ in range(150)).encode()
        assert bpe._merge_heap(piece, RANKS) == bpe.merge(piece, RANKS)


def test_round_trip(spark, make):
    texts = [*ODD, "word " * 5000, "x" * 20_000]
    rows = bpe.round_trip(make(texts), "text", PATH, PATTERN).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        want = LIBRARY.encode_ordinary(text)
        assert row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ids_decode_and_clashing_names(spark, make):
    docs = make([(1, "a b", "en", "s", 3), (1, "a b", "en", "s", 3), (None, None, None, None, None)])
    docs = docs.withColumn("token_ids", docs.lang).withColumn("_key", docs.lang)
    made = bpe.encoded(docs, "text", PATH, PATTERN)
    assert set(made.columns) == set(docs.columns)
    back = bpe.decoded(made, "token_ids", PATH).collect()
    assert [bytes(r.decoded) for r in back] == [b"a b", b"a b", b""]
    assert bpe.encoded(docs.limit(0), "text", PATH, PATTERN).count() == 0
