import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plurality.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()
ODD = ["Hello, world it's", "<|endoftext|>foo\x1cbar\x85baz ΑΣ İ 'S ǅ é", "", "  ", "<|STARTOFTEXT|> ½²③ 12", "a" * 3001, "abab" * 700, "é ñ　x", "<|startoftext|><|endoftext|>", "'LL'Re''s"]


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    vocab = bpe.vocabulary(PATH)
    assert vocab.encode(text) == want
    assert vocab.encode(text, leaf=5) == want
    assert bpe._counter(PATH).text(text) == len(want)
    ids, decoded = bpe._encoder(PATH).text(text)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert decoded == LIBRARY.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abehinorst'é .1!", max_size=300))
def test_words(text):
    same(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aeinthor", min_size=60, max_size=900))
def test_long_unsplit(text):
    same(text)


def test_leaves_dealt_to_tasks_join_to_the_same(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_RUN", 90)
    monkeypatch.setattr(bpe, "WIDE_LEAF", 16)
    rows = [(i, t) for i, t in enumerate([*ODD, "x " + "the" * 40 + "1234" * 30 + " y " + "é" * 95 + "<|endoftext|>" + "ab'll" * 30, None, "z" * 89, "q" * 90])]
    rows += [(5, "a" * 3001), (None, "ba" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS at").repartition(3)
    encode = lambda t: LIBRARY.encode(t or "", add_special_tokens=False).ids
    want = sorted(((d, encode(t), LIBRARY.decode(encode(t), skip_special_tokens=False)) for d, t in rows), key=str)
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in bpe.encode_texts(docs, PATH).collect()), key=str)
    assert got == want
    digests = {(r.doc_id, r.ids_sha256) for r in bpe.encode_texts(docs, PATH, digests=True).collect()}
    assert digests == {(d, hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()) for d, i, _ in want}


def test_remembered_words_move_between_generations(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    encoder = bpe.Encoder(bpe.vocabulary(PATH))
    words = [f"word{i % 7}" for i in range(60)] + ["x" * 80] * 2
    for w in words:
        assert encoder.ids(w) == np.array(LIBRARY.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(encoder.known) <= 5 and "x" * 80 not in encoder.known


def test_frames(spark):
    rows = [(1, "Hello, world"), (2, None), (None, "x"), (1, "Hello, world"), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS ids")
    got = sorted((tuple(r) for r in bpe.token_counts(docs, PATH, limit=2).collect()), key=str)
    assert got == sorted([(1, 12, 3, True), (2, 0, 0, False), (None, 1, 1, False), (1, 12, 3, True), (3, 0, 0, False)], key=str)
    got = {r.doc_id: r for r in bpe.encode_texts(docs, PATH).collect()}
    assert got[1].ids == LIBRARY.encode("Hello, world", add_special_tokens=False).ids and got[2].ids == [] and got[3].decoded == ""
    got = {r.doc_id: r for r in bpe.encode_texts(docs, PATH, digests=True).collect()}
    assert got[2].ids_sha256 == hashlib.sha256(b"").hexdigest() == got[3].decoded_sha256
    assert bpe.token_counts(docs.limit(0), PATH).count() == 0
