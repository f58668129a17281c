"""Byte-pair encoding for a word-based vocabulary file (``word_bpe_49k.json``).

Two evaluators share one reading of the file:

* ``count_tokens``: heap and linked list. The heap holds adjacent pairs by (rank,
  position); each pop that is still current joins two list cells. The token count is the
  number of initial symbols minus the merges done; no identifiers are built.
* ``encode``: identifiers. A piece longer than ``LEAF`` symbols is cut in halves down to
  leaves; leaves are independent of each other and encoded on their own, then neighbours
  are joined upwards. Of texts with a run of ``LONG_RUN`` characters or more between white
  space, the leaves (``WIDE_LEAF`` symbols each) are rows of their own, encoded by all
  tasks in parallel, and one task joins what they come to. At each join a window around the seam is encoded anew and grown
  until its first token is the left side's token there and its last one the right side's.
  All neighbours inside a window, or inside a side, are neighbours in a true encoding, and
  a sequence whose every adjacent pair is such is the encoding of the whole.

Texts are handled as the library does by default: special strings are cut out first, the
rest is composed (NFC), lower-cased code point by code point, and split at white space and
by the file's pattern. A null or empty text has no tokens.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, bound_batches, map_batches, texts, tidied

LEAF = 256
#: Unsplit characters from which a text's leaves are dealt to all tasks, and the symbols of
#: such a leaf.
LONG_RUN, WIDE_LEAF = 200_000, 16_384
#: Symbols up to which a leaf is merged without a heap; no rank; bits of a symbol.
FEW, NONE, LOW_BITS = 40, 1 << 62, (1 << 20) - 1
#: Words, and their pieces, of at most this length are remembered by a worker, this many of
#: each in a generation.
CACHE_CHARS, CACHE_WORDS = 64, 60_000
#: As many counts, which are small.
CACHE_COUNTS = 200_000

# The vocabulary's splitting pattern (here for strings without white space).
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{L}\p{N}]+")
#: The characters that Unicode calls white space; the four controls are str.isspace's own.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not "\x1c" <= c <= "\x1f")
SPLIT = re.compile(f"[{WHITE}]+")
#: str.split also parts at these, which are not white space.
CONTROLS = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else 256 upwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        ids = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        names = {number: name for name, number in (ids | self.special).items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + end] for s in symbols]
        self.parts: dict[int, tuple[int, int]] = {}
        self.ranks: dict[int, tuple[int, int]] = {}
        #: The same for ``_leaf``: rank and merged symbol in one number.
        self.steps: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            merged = ids[a + b]
            self.ranks.setdefault(ids[a] << 20 | ids[b], (rank, merged))
            self.steps.setdefault(ids[a] << 20 | ids[b], rank << 20 | merged)
            self.parts.setdefault(merged, (ids[a], ids[b]))

    def chunks(self, text: str) -> list[str]:
        """Lower-cased runs between white space of a text without special strings."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        text = text.lower()
        if CONTROLS.search(text):
            return [x for x in SPLIT.split(text) if x]
        return text.split()

    def sections(self, text: str) -> list[str]:
        """Alternately ordinary text and a special string."""
        if self.special_cut is None or "<" not in text:
            return [text]
        return self.special_cut.split(text)

    def symbols(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        out = [self.inner[b] for b in data]
        out[-1] = self.last[data[-1]]
        return out

    def _merge(self, cells: list[int]) -> tuple[int, list[int]]:
        """Number of merges done; cells merged away become -1 in place."""
        size, ranks = len(cells), self.ranks
        heap = []
        for i in range(size - 1):
            found = ranks.get(cells[i] << 20 | cells[i + 1])
            if found:
                heap.append((found[0], i, found[1], cells[i], cells[i + 1]))
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        merges = 0
        while heap:
            _, i, merged, a, b = heapq.heappop(heap)
            j = after[i] if cells[i] == a else size
            if j >= size or cells[j] != b:
                continue
            merges += 1
            cells[i], cells[j] = merged, -1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                found = ranks.get(merged << 20 | cells[k])
                if found:
                    heapq.heappush(heap, (found[0], i, found[1], merged, cells[k]))
            h = before[i]
            if h >= 0:
                found = ranks.get(cells[h] << 20 | merged)
                if found:
                    heapq.heappush(heap, (found[0], h, found[1], cells[h], merged))
        return merges, cells

    def count_piece(self, piece: str) -> int:
        cells = self.symbols(piece)
        initial = len(cells)
        return initial - self._merge(cells)[0]

    def _leaf(self, symbols: list[int]) -> list[int]:
        """Merges of few symbols: the list of adjacent pairs' ranks is searched anew."""
        if len(symbols) > FEW:
            return [x for x in self._merge(list(symbols))[1] if x >= 0]
        cells, get = list(symbols), self.steps.get
        found = [get(a << 20 | b, NONE) for a, b in zip(cells, cells[1:])]
        while found and (least := min(found)) < NONE:
            i, merged = found.index(least), least & LOW_BITS
            cells[i : i + 2] = (merged,)
            del found[i]
            if i:
                found[i - 1] = get(cells[i - 1] << 20 | merged, NONE)
            if i < len(found):
                found[i] = get(merged << 20 | cells[i + 1], NONE)
        return cells

    def spell(self, tokens: list[int]) -> list[int]:
        """The initial symbols that the tokens were merged from."""
        out, stack = [], list(reversed(tokens))
        while stack:
            pair = self.parts.get(x := stack.pop())
            if pair is None:
                out.append(x)
            else:
                stack += (pair[1], pair[0])
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 2
        while True:
            a, b = left[-width:], right[:width]
            window = self._leaf(self.spell(a + b))
            left_whole, right_whole = width >= len(left), width >= len(right)
            if (left_whole or window[0] == a[0]) and (right_whole or window[-1] == b[-1]) and (left_whole or right_whole or len(window) > 1):
                return left[: len(left) - len(a)] + window + right[len(b) :]
            width *= 2

    def encode_symbols(self, symbols: list[int], leaf: int = LEAF) -> list[int]:
        if len(symbols) <= leaf:
            return self._leaf(symbols)
        known: dict[tuple[int, ...], list[int]] = {}
        level = []
        for at in range(0, len(symbols), leaf):
            part = tuple(symbols[at : at + leaf])
            if part not in known:
                known[part] = self._leaf(list(part))
            level.append(known[part])
        return self.joined(level)

    def joined(self, level: list[list[int]]) -> list[int]:
        """Encodings of neighbouring leaves, joined two by two up to one."""
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def pieces(self, chunk: str) -> list[str]:
        return [chunk] if chunk.isascii() and chunk.isalpha() and "'" not in chunk else PIECES.findall(chunk)

    def encode_piece(self, piece: str, leaf: int = LEAF) -> list[int]:
        return self.encode_symbols(self.symbols(piece), leaf)

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        out: list[int] = []
        for i, section in enumerate(self.sections(text)):
            if i % 2:
                out.append(self.special[section])
            else:
                for chunk in self.chunks(section):
                    for piece in self.pieces(chunk):
                        out += self.encode_piece(piece, leaf)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: token strings, parted by blanks."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Remembered(dict):
    """Results of short words, in two generations: when the younger one is full it becomes
    the older one, and words of that which come up again move back."""

    def __init__(self, compute, most: int | None = None):
        super().__init__()
        self.compute, self.older, self.most = compute, {}, most or CACHE_WORDS

    def __missing__(self, word: str):
        found = self.older.get(word)
        if found is None:
            found = self.compute(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


class Counter:
    """Token counts of texts, remembering the count of each distinct short word."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.known, self.parts = Remembered(self.word, CACHE_COUNTS), Remembered(vocab.count_piece, CACHE_COUNTS)

    def word(self, word: str) -> int:
        pieces = self.vocab.pieces(word)
        return sum(map(self.parts.__getitem__, pieces)) if len(pieces) > 1 else self.vocab.count_piece(word)

    def text(self, text: str) -> int:
        total, known = 0, self.known.__getitem__
        for i, section in enumerate(self.vocab.sections(text)):
            total += 1 if i % 2 else sum(map(known, self.vocab.chunks(section)))
        return total


class Encoder:
    """Identifiers as little-endian bytes, remembering those of each distinct short word."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.known, self.parts = vocab, Remembered(self.word), Remembered(self.piece)
        self.special = {s: np.array([n], "<u4").tobytes() for s, n in vocab.special.items()}

    def piece(self, piece: str) -> bytes:
        return packed(self.vocab.encode_piece(piece))

    def word(self, word: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self.vocab.pieces(word)))

    def text(self, text: str) -> tuple[bytes, str]:
        """(identifiers, decoded text)."""
        ids = self.ids(text)
        return ids, self.vocab.decode(unpacked(ids))

    def ids(self, text: str) -> bytes:
        parts, known = [], self.known.__getitem__
        for i, section in enumerate(self.vocab.sections(text)):
            if i % 2:
                parts.append(self.special[section])
            else:
                parts += map(known, self.vocab.chunks(section))
        return b"".join(parts)

    def leaves(self, text: str) -> Iterator[tuple[int, bytes]]:
        """(piece, identifiers or symbols) in order. Pieces are numbered from 1 where they
        are long and come as symbols, a leaf each; 0 marks identifiers of all between."""
        done: list[bytes] = []
        long = 0
        for i, section in enumerate(self.vocab.sections(text)):
            if i % 2:
                done.append(self.special[section])
                continue
            for chunk in self.vocab.chunks(section):
                if len(chunk) < WIDE_LEAF:
                    done.append(self.known[chunk])
                    continue
                for piece in self.vocab.pieces(chunk):
                    symbols = self.vocab.symbols(piece)
                    if len(symbols) <= WIDE_LEAF:
                        done.append(packed(self.vocab.encode_symbols(symbols)))
                        continue
                    yield 0, b"".join(done)
                    done, long = [], long + 1
                    for at in range(0, len(symbols), WIDE_LEAF):
                        yield long, packed(symbols[at : at + WIDE_LEAF])
        yield 0, b"".join(done)

    def put_together(self, leaves: list[tuple[int, bytes]]) -> bytes:
        """Identifiers of a text from its leaves, those of long pieces being encoded."""
        out = []
        for piece, run in itertools.groupby(leaves, key=lambda x: x[0]):
            parts = [x[1] for x in run]
            out += [packed(self.vocab.joined([unpacked(x) for x in parts]))] if piece else parts
        return b"".join(out)


def packed(ids: list[int]) -> bytes:
    """As little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def unpacked(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@functools.lru_cache(maxsize=4)
def _counter(path: str) -> Counter:
    return Counter(vocabulary(path))


@functools.lru_cache(maxsize=4)
def _encoder(path: str) -> Encoder:
    return Encoder(vocabulary(path))


def _forget() -> None:
    """What a task remembers of words goes with it; the vocabulary stays."""
    _counter.cache_clear()
    _encoder.cache_clear()


def token_counts(docs: DataFrame, vocab_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_bytes, n_tokens, over_limit``.

    Null text: 0 bytes and 0 tokens. A null id stays null. Repeated rows give repeated
    rows. Other columns are not read. No shuffle; one pass.
    """
    kind = dict(docs.dtypes)[id_col]

    def step(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        counter, rows = _counter(vocab_path), texts(column)
        counts = [counter.text(x) for x in rows]
        return pa.RecordBatch.from_arrays(
            [ids, pa.array([len(x.encode("utf-8")) for x in rows], pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
            [id_col, "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(docs, [id_col, text_col], step, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean", _forget)


def _result(vocab_path: str, digests: bool, id_col: str):
    """Builds the output batch from ids of rows and their packed identifiers."""

    def build(ids: pa.Array, done: list[bytes]) -> pa.RecordBatch:
        decode = vocabulary(vocab_path).decode
        counts = pa.array([len(x) // 4 for x in done], pa.int64())
        decoded = (decode(unpacked(x)) for x in done)
        if digests:
            more = [pa.array([hashlib.sha256(x).hexdigest() for x in done], pa.string()), pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded], pa.string())]
            names = ["ids_sha256", "decoded_sha256"]
        else:
            flat = np.frombuffer(b"".join(done), "<u4").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(counts.to_numpy())]).astype(np.int32)
            more = [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(list(decoded), pa.string())]
            names = ["ids", "decoded"]
        return pa.RecordBatch.from_arrays([ids, counts, *more], [id_col, "n_tokens", *names])

    return build


def _encode_wide(long: DataFrame, vocab_path: str, build, id_col: str, text_col: str, schema: str, scratch: Scratch) -> DataFrame:
    """The same result for texts with long unsplit runs: leaves are dealt to all tasks.

    A task holds one text's identifiers when it joins them; what it encodes anew are the
    windows around the seams.
    """
    kind = dict(long.dtypes)[id_col]
    keyed = scratch.keep(long.select(F.monotonically_increasing_id().alias("row"), id_col, text_col))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocab_path)
        for batch in batches:
            for row, id_, text in zip(batch.column(0).to_pylist(), batch.column(1), texts(batch.column(2)), strict=True):
                for at, (piece, data) in enumerate(encoder.leaves(text)):
                    columns = [pa.array([row], pa.int64()), pa.array([id_.as_py()], id_.type), pa.array([at], pa.int32()), pa.array([piece], pa.int32()), pa.array([data], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["row", id_col, "at", "piece", "data"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocab_path)
        for batch in batches:
            data = [packed(vocab.encode_symbols(unpacked(x))) if piece else x for piece, x in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary())], batch.schema.names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key, id_, leaves = _encoder(vocab_path), None, None, []
        for batch in batches:
            for row, own, piece, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if row != key and key is not None:
                    yield build(pa.array([id_.as_py()], id_.type), [encoder.put_together(leaves)])
                    leaves = []
                key, id_ = row, own
                leaves.append((piece, data))
        if key is not None:
            yield build(pa.array([id_.as_py()], id_.type), [encoder.put_together(leaves)])

    spec = f"row long, `{id_col}` {kind}, at int, piece int, data binary"
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = keyed.mapInArrow(tidied(cut, _forget), spec).repartition(parts, "row", "at").mapInArrow(tidied(encode), spec)
    return encoded.repartition(parts, "row").sortWithinPartitions("row", "at").mapInArrow(tidied(join, _forget), schema)


def encode_texts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: the encoding and its decoding.

    ``digests=False`` returns ``id, n_tokens, ids array<int>, decoded``; ``digests=True``
    returns SHA-256 of the identifiers (little-endian unsigned 32-bit) and of the decoded
    text instead, so that only digests travel. Null or empty text: no identifiers and an
    empty decoded text; a null id and repeated rows stay; other columns are not read. One
    pass without a shuffle, but for texts that hold a run of ``LONG_RUN`` characters without
    white space, whose leaves are dealt to all tasks.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rest = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    schema = f"`{id_col}` {kind}, n_tokens long, {rest}"
    build = _result(vocab_path, digests, id_col)

    def step(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        encoder = _encoder(vocab_path)
        return build(ids, [encoder.ids(x) for x in texts(column)])

    text = F.coalesce(F.col(text_col), F.lit(""))
    wide = (F.length(text) >= LONG_RUN) & text.rlike(rf"(?<![^\s])[^\s]{{{LONG_RUN}}}")
    long = docs.where(wide)
    if not long.limit(1).count():
        return map_batches(docs, [id_col, text_col], step, schema, _forget)
    short = map_batches(docs.where(~wide), [id_col, text_col], step, schema, _forget)
    return short.union(_encode_wide(long, vocab_path, build, id_col, text_col, schema, Scratch(docs.sparkSession)))
