"""Packing along a space-filling curve.

Each document's token numbers are hashed into a vector (square roots of counts, of length
one), which fixed random directions project to ``DIMENSIONS`` numbers. The cell they fall in
has a place on a Hilbert curve, so documents of like content get near keys. Documents are
range-sorted by key, and every task cuts its stretch of the curve into sequences: documents
follow each other without a gap, and the last, shorter sequence of a stretch is cut into
powers of two, so nothing is padded.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.bpe import byte_symbols
from plurality.llm.common import Scratch, bound_batches, texts, tidied

LENGTH = 2048
#: What ends a document.
END_ID = 1
HASHED, DIMENSIONS, BITS, SEED = 1024, 4, 15, 20240611
#: Tokens of a task: at least and, beyond the session's number of partitions, at most.
LEAST_TOKENS, MOST_TOKENS = 1 << 16, 1 << 26
#: Sequences that are handed on together.
FLUSH = 64
#: Bytes of texts whose units are encoded together, each once.
CHUNK_BYTES = 16 << 20
#: Strings whose characters every Unicode version knows alike, without special strings.
PLAIN = r"^[\t\n\r\x20-;=-~\x{a1}-\x{24f}]*$"
#: White space that texts are cut before, beside blanks.
MARKS = "\n\r\t"
#: White space of a length that the faster merger may not bear.
LONG_SPACE = re.compile(r"\s{1000}")
#: Units that are encoded in one call, and texts that are put together at a time.
RUN_UNITS, RUN_TEXTS = 4096, 256
#: Kinds of units: white space alone; with other white space at an end, or led by a special string.
BLANK, ODD = 1, 2


class Units:
    """Encodes texts unit by unit, equal units of a batch once.

    Texts are cut before each blank, tab and line's end. No token of the vocabulary's pattern
    goes on over these, and its search looks back no further, except where white space is
    longer: its last character stands apart from those before it. So up to two of them are
    cut right, and texts with three, or with two at the end, are encoded whole, as are those
    with other white space, or a special string that ends what comes before, behind a cut.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = number_type(self.tokenizer.get_vocab_size())
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        special = self.tokenizer.get_added_tokens_decoder()
        self.specials = {x.content for x in special.values()}
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.merges = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        byte_level = model["normalizer"] is None and model["pre_tokenizer"]["type"] == "ByteLevel" and model["pre_tokenizer"]["use_regex"] and not model["pre_tokenizer"]["add_prefix_space"]
        known = all("<" in x.content and not (x.lstrip or x.rstrip or re.search(r"\s", x.content)) for x in special.values())
        self.merger = self._same_merger(vocab, public_tokenizers.PATTERN) if byte_level and known else None
        #: Bytes of each token; a character of the vocabulary stands for a byte.
        self.widths = np.zeros(max([*vocab.values(), *special]) + 1, np.int64)
        for name, number in vocab.items():
            self.widths[number] = len(name)
        for number, token in special.items():
            self.widths[number] = len(token.content.encode())
        del self.merges

    def batch(self, rows: list[str]) -> list[bytes]:
        """Token numbers of each text."""
        if not (self.merger and rows):
            return self.alone(rows)
        marked = pa.array(rows, pa.string())
        for mark in MARKS:
            marked = pc.replace_substring(marked, mark, " " + mark)
        # A line's end before each text makes its first unit like any other; it goes below.
        parts = pc.split_pattern(pc.binary_join_element_wise("\n", marked, ""), " ")
        words = parts.values.dictionary_encode()
        starts, words, distinct = parts.offsets.to_numpy(), words.indices.to_numpy(), words.dictionary
        del marked, parts
        ids, first, counts, kinds = self.encoded(distinct)
        kinds = kinds[words]
        blanks = (kinds[1:] == BLANK) & (kinds[:-1] == BLANK)
        blanks[starts[1:-1] - 1] = False  # of two texts
        odd = np.concatenate([np.flatnonzero(kinds == ODD), np.flatnonzero(blanks)])
        out: list[bytes] = []
        for at in range(0, len(rows), RUN_TEXTS):
            bounds = starts[at : at + RUN_TEXTS + 1]
            own = words[bounds[0] : bounds[-1]]
            ends = np.cumsum(counts[own])
            data = ids[np.arange(ends[-1]) + np.repeat(first[own] + counts[own] - ends, counts[own])]
            cuts = [0, *ends[bounds[1:] - bounds[0] - 1].tolist()]
            out += [data[a + 1 : b].tobytes() for a, b in zip(cuts, cuts[1:])]  # noqa: B905
        for i in np.unique(np.searchsorted(starts, odd, "right") - 1).tolist():
            out[i] = self.whole(rows[i])
        return out

    def encoded(self, units: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Token numbers of all units, each one's first place there and count, and its kind.

        A unit follows a blank, which its numbers begin with, or begins with one of ``MARKS``.
        Units of kind ``ODD`` have no numbers.
        """
        kinds = np.zeros(len(units), np.int8)
        kinds[pc.is_in(units, pa.array(["", *MARKS])).to_numpy(zero_copy_only=False)] = BLANK
        plain = pc.match_substring_regex(units, PLAIN).to_numpy(zero_copy_only=False)
        special = tuple(self.specials)
        for i in np.flatnonzero(~plain).tolist():
            unit = units[i].as_py()
            body = unit[unit[0] in MARKS :]
            if body[0].isspace() or body[-1].isspace() or body.startswith(special):
                kinds[i] = ODD
        first, counts = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        found, held = [], 0
        usual = kinds == 0
        for at, encode, size in ((usual & plain, self._merged, RUN_UNITS), (usual & ~plain, self._encoded, RUN_UNITS), (kinds == BLANK, self._encoded, 1)):
            places = np.flatnonzero(at)
            for low in range(0, len(places), size):
                run = places[low : low + size]
                ids, cuts = self._run(units.take(pa.array(run)), encode)
                first[run], counts[run] = held + cuts[:-1], np.diff(cuts)
                found.append(ids)
                held += len(ids)
        return np.concatenate(found) if found else np.zeros(0, self.kind), first, counts, kinds

    def _run(self, units: pa.StringArray, encode: Callable[[str], list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Units encoded together, and where each begins and ends by its bytes."""
        joined = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(units)], pa.int32()), units), " ")[0].as_py()
        led = np.zeros(len(units), bool)
        for mark in MARKS:
            joined = joined.replace(" " + mark, mark)
            led |= pc.starts_with(units, mark).to_numpy(zero_copy_only=False)
        ids = np.array(encode(joined), self.kind)
        ends = np.cumsum(pc.binary_length(units).to_numpy() + ~led)
        return ids, np.concatenate([[0], np.searchsorted(np.cumsum(self.widths[ids]), ends, "right")])

    def _merged(self, text: str) -> list[int]:
        return self.merger.encode_ordinary(text)

    def _encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def alone(self, strings: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        """The same for a text that may not be cut."""
        plain = pc.match_substring_regex(pa.array([text]), PLAIN)[0].as_py() and not LONG_SPACE.search(text)
        return np.array((self._merged if plain else self._encoded)(text), self.kind).tobytes()

    def _same_merger(self, vocab: dict[str, int], pattern: str):
        """A faster merger that gives the same numbers for plain strings, or None.

        It joins the pair whose whole has the lowest number. That is the same as going by the
        list of merges if numbers follow that list, and every token comes out whole from its
        own string (so a token's two halves are always those of its merge).
        """
        letters = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        ranks = {b"".join(map(letters.__getitem__, name)): number for name, number in vocab.items() if all(c in letters for c in name)}
        merges = [vocab["".join(m)] for m in self.merges]
        if merges != list(range(256, 256 + len(merges))) or any(len(self.tokenizer.model.tokenize(x)) != 1 for x in vocab if x not in self.specials):
            return None
        return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def number_type(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=2)
def _units(path: str) -> Units:
    return Units(path)


@functools.lru_cache(maxsize=1)
def _directions() -> np.ndarray:
    """Unit vectors, so that projections of unit vectors lie between -1 and 1."""
    rows = np.random.default_rng(SEED).standard_normal((HASHED, DIMENSIONS))
    return rows / np.linalg.norm(rows, axis=0)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of rows of cell numbers below ``2 ** bits`` (Skilling 2004)."""
    x = [c.astype(np.int64) for c in cells.T]
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(len(x)):
            turned = x[i] & q != 0
            swapped = np.where(turned, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(turned, x[0] ^ (q - 1), x[0] ^ swapped)
            x[i] = x[i] ^ swapped if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    last = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        last = np.where(x[-1] & q != 0, last ^ (q - 1), last)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << 1 | ((c ^ last) >> b & 1)
    return key


def document_keys(documents: list[np.ndarray]) -> np.ndarray:
    """The curve's key of each document's token numbers."""
    vectors = np.zeros((len(documents), HASHED))
    for row, ids in zip(vectors, documents, strict=True):
        row += np.bincount((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)).astype(np.int64), minlength=HASHED)
    np.sqrt(vectors, out=vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    cells = np.clip((vectors @ _directions() + 1) * (1 << BITS - 1), 0, (1 << BITS) - 1)
    return hilbert_keys(cells.astype(np.int64), BITS)


def tokenised(docs: DataFrame, vocab_path: str, id_col: str, text_col: str) -> DataFrame:
    """``doc, key, n, ids``: token numbers of each document, as bytes, and its key."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(vocab_path)
        end = np.array([END_ID], units.kind).tobytes()
        for names, rows in chunks(batches):
            done = units.batch(rows)
            for at in range(0, len(rows), RUN_TEXTS):
                part = [x + end for x in done[at : at + RUN_TEXTS]]
                arrays = [np.frombuffer(x, units.kind) for x in part]
                columns = [names[at : at + RUN_TEXTS], pa.array(document_keys(arrays), pa.int64()), pa.array([len(x) for x in arrays], pa.int64()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "key", "n", "ids"])

    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"doc {dict(docs.dtypes)[id_col]}, key long, n long, ids binary")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of batches until they have ``CHUNK_BYTES``."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield chunk(held)
            held, size = [], 0
    if held:
        yield chunk(held)


def chunk(batches: list[pa.RecordBatch]) -> tuple[pa.Array, list[str]]:
    return pa.concat_arrays([b.column(0) for b in batches]), [x for b in batches for x in texts(b.column(1))]


def powers_of_two(n: int) -> list[int]:
    """``n`` as a sum of different powers of two, the largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut_into(pieces: list[tuple], sizes: list[int]) -> Iterator[tuple]:
    """Pieces ``(document, start, ids)`` laid one after the other into sequences of ``sizes``:
    ``(document, start, ids, number of the sequence, offset)``."""
    at, offset = 0, 0
    for document, start, ids in pieces:
        done = 0
        while done < len(ids):
            part = ids[done : done + sizes[at] - offset]
            yield document, start + done, part, at, offset
            done, offset = done + len(part), offset + len(part)
            if offset == sizes[at]:
                at, offset = at + 1, 0


def packed(docs: DataFrame, vocab_path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per piece: ``id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is its token numbers and ``END_ID``; ``start`` counts its tokens before the
    piece, ``doc_tokens`` all of them. Sequences have ``length`` tokens; the shorter ones at
    the end of a task's stretch have a power of two. ``digests`` gives ``ids_crc32`` (of
    unsigned 32-bit numbers, the low byte first) for ``ids``. A null or empty text is
    ``END_ID`` alone, a null id stays, repeated rows are packed each; other columns are not
    read. An empty table has no rows. A long document is one row of two or four bytes a token
    where it is shuffled, and is cut wherever a sequence is full. Equal documents have one
    key; the row's number parts them, so they fill any number of tasks.
    """
    session, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    scratch = Scratch(session)
    rows = scratch.keep(tokenised(docs, vocab_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    tokens = rows.agg(F.sum("n")).first()[0] or 0
    parts = min(max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-tokens // MOST_TOKENS)), tokens // LEAST_TOKENS + 1)
    ordered = rows.repartitionByRange(parts, "key", "row").sortWithinPartitions("key", "row").select("doc", "n", "ids")
    names = [id_col, "start", "length", "ids_crc32" if digests else "ids", "doc_tokens", "sequence_id", "offset"]
    schema = f"`{id_col}` {kind}, start long, length long, {'ids_crc32 long' if digests else 'ids array<int>'}, doc_tokens long, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = TaskContext.get().partitionId() << 40
        done, waiting, held = 0, [], 0  # full sequences, and pieces of the open one

        def shown(pieces: list[tuple]) -> pa.RecordBatch:
            own, starts, ids, numbers, offsets = zip(*pieces, strict=True)
            documents, ns = zip(*own, strict=True)
            said = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()) if digests else pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            columns = [starts, [len(x) for x in ids], said, ns, [begin + n for n in numbers], offsets]
            return pa.RecordBatch.from_arrays([pa.array(documents, types[0]), *(c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns)], names)

        types = []
        for batch in batches:
            types = [batch.schema.field(0).type]
            for document, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4")
                waiting.append(((document, n), 0, ids))
                held += n
                if held >= FLUSH * length:
                    full = held // length
                    out = list(cut_into(waiting, [length] * full + [length]))
                    yield shown([(d, s, x, done + k, o) for d, s, x, k, o in out if k < full])
                    waiting = [(d, s, x) for d, s, x, k, _ in out if k == full]
                    done, held = done + full, held % length
        if held:
            full, rest = divmod(held, length)
            yield shown([(d, s, x, done + k, o) for d, s, x, k, o in cut_into(waiting, [length] * full + powers_of_two(rest))])

    return ordered.mapInArrow(tidied(run), schema)

