"""Operator 11 against the tokenizers library and the rules of packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from plurality.llm import packing
from plurality.llm.queries import op11_curve_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "é", "\xa0", "　", "<|endoftext|>", "!", "\x1c", "\x85", "word", "日本", "x" * 70]


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, docs, length):
    """Every document whole and in order; sequences gapless, full or a power of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for doc, text, *_ in docs:
        want.setdefault(doc, []).append([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1])
    assert set(by_doc) == set(want)
    for doc, copies in want.items():
        if len(copies) > 1:  # rows of one id: as many pieces' tokens as theirs
            assert sum(r.length for r in by_doc[doc]) == sum(map(len, copies))
            continue
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(copies[0])
            part = np.array(copies[0][at : at + r.length], "<u4")
            assert r.ids_crc32 == zlib.crc32(part.tobytes()) if "ids_crc32" in r else r.ids == part.tolist()
            at += r.length
        assert at == len(copies[0])
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and (at == length or at & (at - 1) == 0)
        sizes.append(at)
    return sizes


@pytest.mark.parametrize("digests", [True, False])
def test_pieces(spark, digests):
    rng = random.Random(4)
    docs = [(i, "".join(rng.choice(ODD) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "one more word " * 5000), (1003, "y" * 30_000), (None, "no id"), (7, "again"), (7, "again")]
    docs += [(2000 + i, "the same text, many times") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS ids", "3 AS row", "4 AS doc")
    rows = packing.packed(frame.repartition(3), PATH, length=64, digests=digests).collect()
    check(rows, docs, 64)


def test_no_documents(spark):
    assert packing.packed(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sizes = check(op11_curve_packing(spark, sf).collect(), docs, 2048)
    assert sum(x == 2048 for x in sizes) * 2048 > 0.9 * sum(sizes)


def test_units_equal_the_library():
    rng = random.Random(1)
    units = packing.Units(PATH)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(6000)]
    want = [np.array(e.ids, units.kind).tobytes() for e in units.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert units.batch(texts[:10]) + units.batch(texts[10:]) == want


@pytest.mark.parametrize("alphabet", [["a", "b.", " ", "\n", "\r", "\t", "é"], ["a", " ", "\n", "<|endoftext|>", "日", "\u2028", "’"]])
def test_white_space_equals_the_library(alphabet):
    """Runs of it at the beginning, inside, at the end and before special strings."""
    rng = random.Random(5)
    units = packing.Units(PATH)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(6000)] + ["a" + " " * 1_200_000 + "b"]
    assert units.batch(texts) == [np.array(e.ids, units.kind).tobytes() for e in units.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plain_texts_take_the_faster_merger(monkeypatch):
    """Lines, first and last words too, and equal words once."""
    units, merged = packing.Units(PATH), []
    texts = [f"First {i % 7}.\n\nNext line\tété {i % 7} last" for i in range(1000)]
    want = [np.array(e.ids, units.kind).tobytes() for e in units.tokenizer.encode_batch(texts, add_special_tokens=False)]
    slow, fast = units.tokenizer, units._merged

    class Library:
        def encode_batch_fast(self, strings, **options):
            assert not "".join(strings).strip(), strings
            return slow.encode_batch_fast(strings, **options)

    monkeypatch.setattr(units, "tokenizer", Library())
    monkeypatch.setattr(units, "_merged", lambda text: merged.append(text) or fast(text))
    assert units.batch(texts) == want
    assert sum(map(len, merged)) < 200


def test_texts_are_chunked_by_bytes(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_BYTES", 1000)
    batches = [pa.RecordBatch.from_pydict({"doc_id": [i, None], "text": ["x" * 300, None]}) for i in range(7)] + [pa.RecordBatch.from_pydict({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]
    found = list(packing.chunks(iter(batches)))
    assert [len(ids) for ids, _ in found] == [8, 6]
    assert [x for ids, _ in found for x in ids.to_pylist()] == [x for i in range(7) for x in (i, None)]
    assert [x for _, rows in found for x in rows] == ["x" * 300, ""] * 7


def test_curve_visits_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = packing.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_like_documents_are_near():
    rng = np.random.default_rng(2)
    kinds = [rng.integers(0, 50_000, 200) for _ in range(5)]
    documents = [rng.choice(kinds[i % 5], 400).astype(np.uint16) for i in range(100)]
    order = np.argsort(packing.document_keys(documents)) % 5
    assert (np.diff(order) == 0).mean() > 0.6  # one fifth by chance
