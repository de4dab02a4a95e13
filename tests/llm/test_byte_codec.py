"""Byte-level BPE against the library, and stitched chunks against whole texts."""

import base64
from bisect import bisect_left
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.llm import byte_codec
from weftgraph.llm.byte_codec import ByteCodec, encode_documents, public_bytes
from weftgraph.llm.common import documents


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = st.sampled_from(["a", "The", " the", " ", "  ", "\n", "\t", "'s", "'", "re", "'ve", "12", "٣", "é", "ß", "日本", "!", "...", " ", "😀", "ǅ", "́", "\x1c", "՘", "\U00011de0", "꟎"])


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(PARTS, max_size=40).map("".join)))
def test_text_equals_the_library(library, text):
    codec = public_bytes()
    ids = codec.encode(text)
    assert ids == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, "\n" * 900 + "x", "é" * 700, "the" * 500, "0123456789" * 200])
def test_long_pre_tokens_equal_the_library(library, text):
    assert public_bytes().encode(text) == library.encode_ordinary(text)


@given(st.binary(max_size=80))
def test_scan_and_queue_merge_alike(piece):
    codec = public_bytes()
    if piece:
        assert codec._by_scan(piece) == codec._by_queue(piece)


def test_categories_of_all_characters_equal_the_library(library):
    """Around those characters that Unicode tables of different age class apart, and every 97th other."""
    codec = public_bytes()
    every = [chr(i) for i in [*range(0, 0xD800, 97), *range(0xE000, 0x110000, 97)]]
    odd = codec.odd.findall("".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000))[::40] if codec.odd else []
    for c in every + odd:
        text = f"a{c}1{c}! {c}{c}\n"
        assert codec.encode(text) == library.encode_ordinary(text), hex(ord(c))


def test_the_cache_may_be_small(library, monkeypatch):
    monkeypatch.setattr(byte_codec, "CACHE", 3)
    codec = ByteCodec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "one two three four five one two three four five " * 3
    assert codec.encode(text) == library.encode_ordinary(text)


def expected(library, rows):
    done = [(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows]
    return Counter((i, len(ids), ",".join(map(str, ids)), text) for i, ids, text in done)


def result(df):
    return Counter((r["doc_id"], r["n_tokens"], r["ids"], bytes(r["decoded"])) for r in df.collect())


ODD = [
    (1, None), (2, ""), (3, " "), (4, "plain words, it's here"), (4, "plain words, it's here"), (None, "no id"), (None, "no id"),
    (5, "we've got  spaces \n\n and 12345 numbers — “quotes” " * 40),
    (6, "x" * 900), (7, " " * 500 + "end"), (8, "don't " * 200 + "'" * 60 + "s" * 90 + " 日本語テキスト" * 50),
    (9, "\n\n  word" * 300), (10, "a'b'c'd'll'll're " * 120), (-3, "é😀" * 333),
]


@pytest.mark.parametrize(("stride", "overlap"), [(64, 16), (40, 40), (33, 9), (500, 100), (100_000, 1000)])
def test_chunks_are_stitched(spark, docs_of, library, stride, overlap):
    assert result(encode_documents(docs_of(ODD), stride=stride, overlap=overlap)) == expected(library, ODD)


def test_given_documents(spark, library):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert result(encode_documents(docs, stride=300, overlap=60)) == expected(library, rows)


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overlaps_have_to_fit(spark):
    with pytest.raises(ValueError, match="overlap"):
        encode_documents(spark.createDataFrame([], "doc_id long, text string"), stride=10, overlap=20)


def test_starts_after_a_common_one_agree():
    """What stitching rests on: from a place where pre-tokens of both begin, a text and its tail are cut alike."""
    codec, text = public_bytes(), "it's  a   test\n\n of 'll resync 12ab  !! " * 5
    whole = codec.starts(text)
    for at in range(len(text)):
        tail = [at + s for s in codec.starts(text[at:])]
        if common := set(whole) & set(tail):
            first = min(common)
            assert tail[bisect_left(tail, first) :] == whole[bisect_left(whole, first) :]
