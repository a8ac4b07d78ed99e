"""Backtracking BPE against the tokenizers library, and round trips."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annospark.llm.bpe import Encoder, encode_decode, read_vocabulary

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(read_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expect(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def check(encoder, library, text):
    ids, joined = encoder.encode(text)
    want, decoded = expect(library, text)
    assert ids.tolist() == want
    assert joined == ",".join(map(str, want))
    assert encoder.decode(ids) == decoded


PIECES = st.one_of(st.text(max_size=12), st.sampled_from(
    ["<|endoftext|>", "  ", "\x1c", "\x1f", "\x85", " ", "᠎", "​", "\xa0", "'s", "'ll", "²", "Ⅷ", "ing", "the", "\r\n", "naïve", "🙂", "é" * 30, "a" * 40, "x y "]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=8).map("".join))
def test_same_as_library(text):
    e = STATE.get("e") or STATE.setdefault("e", Encoder(read_vocabulary(PATH)))
    lib = STATE.get("l") or STATE.setdefault("l", Tokenizer.from_file(PATH))
    check(e, lib, text)


STATE: dict = {}


def test_long_word_and_backtracking(encoder, library):
    for text in ("ab" * 5000, "hehehe" * 999 + "!" * 2000, " " * 3000 + "x", "abcdefghijklmnopqrstuvwxyz" * 200):
        check(encoder, library, text)


def test_documents_nulls_and_repeats(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "<|endoftext|> a<|endoftext|>"), (-2, "<|endoftext|> a<|endoftext|>")], "doc_id long, text string")
    got = encode_decode(docs.unionByName(extra), PATH, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()} | {r.doc_id: r.text for r in extra.collect()}
    assert len(got) == len(texts) + 1
    for r in got:
        ids, decoded = expect(library, texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids, r.decoded) == (len(ids), ids, decoded)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty_table(spark):
    assert encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
