"""Collocations: phrases whose weakest cut is still far more frequent than chance.

Phrases are counted level by level. A phrase of k words is a pair of numbers: those of its
first and of its last k-1 words, so a key is exact in 64 bits.

1. Words: tasks count in dictionaries; those of ``least`` occurrences get numbers.
2. Candidates of a level are Apriori-safe: pairs of neighbours that are both frequent, and
   that tasks have seen ``least`` times in all. Tasks add pairs up before they are shuffled,
   and send them packed, in rows of many pairs.
3. A minimal perfect hash over the candidates gives each a slot. Mappers look pairs up, verify
   the stored key, count slots with ``np.bincount`` and hand on arrays, added up as a tree.
   They also write the slots down in place of the numbers before, which the next level reads.
4. Counts of a candidate's cuts are read by the slots of its parts.

Perfect hashes hold ``VOLUME`` keys or so. More candidates make more volumes, sent one after the
other in as many passes over the numbers, so what an executor holds does not grow.
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, bound_batches, hot_join, tidied, tree_summed

#: Keys of one perfect hash (at most about 20 MB sent).
VOLUME = 1 << 20
#: Positions of a level's bit array for each key it has to place.
ROOM = 2
#: Slots of an array that is added up; different words, and pairs, that a task holds at most.
BLOCK, HELD_WORDS, HELD_PAIRS = 4096, 300_000, 800_000
#: Pairs of one Arrow batch; neighbours whose different pairs one task adds up at most.
SHOWN_PAIRS, PART_PAIRS = 1 << 16, 1 << 21
#: Ranks are first found in as many groups of a language.
SALTS = 64
NO_WORD, SKIPPED = -1, -2
#: Slots are 31-bit numbers.
MOST_SLOTS = 1 << 31

# What ends a piece, and blanks between words.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
TABLE = bytes.maketrans(CAPITALS + ENDS + BLANKS, CAPITALS.lower() + b"\n" * len(ENDS) + b" " * len(BLANKS))


def tokens_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text; a newline where a piece ends, and empty ones to skip."""
    return text.translate(TABLE).replace(b"\n", b" \n ").split(b" ")


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays, one for each level.

    A key that is alone at its position of a level is settled there, others go on to the next
    level. Its slot is the number of bits set before its own.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        done, left = 0, np.unique(keys)
        while len(left):
            size = -(-len(left) * ROOM // 64) * 64
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            before = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            self.levels.append((words, done + np.concatenate([[0], before[:-1]])))
            done, left = done + int(before[-1]), left[~alone[at]]
        self.size = done

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (((mixed >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; of others any slot, or -1."""
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._place(keys[rest], level, len(words) * 64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[hit]] = ranks[at[hit] >> 6] + below[hit]
            rest = rest[~hit]
        return out


class PairVolume:
    """Slots of pairs, verified by the stored keys."""

    def __init__(self, keys: np.ndarray):
        self.hash = PerfectHash(keys)
        self.keys = np.zeros(self.hash.size, np.uint64)
        self.keys[self.hash.slots(keys)] = keys

    def slots(self, keys: np.ndarray) -> np.ndarray:
        found = self.hash.slots(keys)
        told = found >= 0
        told[told] = self.keys[found[told]] == keys[told]
        return np.where(told, found, NO_WORD)


class WordVolume:
    """Slots of words of a language, verified by the stored words."""

    def __init__(self, words: list[bytes]):
        self.seed, hashes = 0, self._hashes(words, 0)
        while len(np.unique(hashes)) < len(words):  # another seed tells these words apart
            self.seed += 1
            hashes = self._hashes(words, self.seed)
        self.hash = PerfectHash(hashes)
        at = self.hash.slots(hashes)
        self.keys = [b""] * len(words)
        for slot, word in zip(at.tolist(), words, strict=True):
            self.keys[slot] = word

    @staticmethod
    def _hashes(words: list[bytes], seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))

    def slots(self, words: list[bytes]) -> list[int]:
        found = self.hash.slots(self._hashes(words, self.seed)).tolist()
        return [s if s >= 0 and self.keys[s] == w else NO_WORD for s, w in zip(found, words, strict=True)]


def _word_key(lang: str, word: bytes) -> bytes:
    return word + b" " + lang.encode()  # words have no blank


def _by_lang(batch: pa.RecordBatch) -> dict[str, list[bytes]]:
    out: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
        out.setdefault(lang, []).append(text)
    return out


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n``; ``word`` is null for all of a language's words together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                counts.pop(b"", None), counts.pop(b"\n", None)
                words = [None, *counts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array([sum(counts.values()), *counts.values()], pa.int64())], ["lang", "word", "n"]
                )
            held.clear()

        for batch in batches:
            for lang, texts in _by_lang(batch).items():
                counts = held.setdefault(lang, Counter())
                for text in texts:
                    counts.update(tokens_of(text))
            if sum(map(len, held.values())) >= HELD_WORDS:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(tidied(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _volumes(keys: DataFrame, columns: list[str], count: int, volume: int, build: Callable, scratch: Scratch) -> DataFrame:
    """``volume, n, data``: ``build`` over the keys of each volume, one task for one volume."""
    many = max(1, -(-count // volume))
    dealt = keys.select(F.pmod(F.xxhash64(*columns), F.lit(many)).cast("int").alias("volume"), *columns).repartition(many, "volume")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            for number in set(batch.column(0).to_pylist()):
                held.setdefault(number, []).append(batch.filter(pa.compute.equal(batch.column(0), number)))
        for number in sorted(held):
            own = pa.Table.from_batches(held.pop(number)).combine_chunks()
            built = build(*(own.column(c) for c in columns))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([built.hash.size], pa.int64()), pa.array([pickle.dumps(built)], pa.binary())], ["volume", "n", "data"])

    return scratch.keep(dealt.mapInArrow(tidied(run), "volume int, n long, data binary"))


def _bases(volumes: DataFrame) -> dict[int, int]:
    """The first slot of each volume."""
    at, out = 0, {}
    for r in sorted(volumes.select("volume", "n").collect()):  # a row for each volume
        out[r.volume], at = at, at + r.n
    if at >= MOST_SLOTS:
        raise OverflowError(f"{at} candidates of one length; slots are 31-bit numbers")
    return out


def _keys_by_slot(volumes: DataFrame, bases: dict[int, int], spec: str, columns: Callable) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                built = pickle.loads(data)
                for at in range(0, built.hash.size, BLOCK):
                    part = built.keys[at : at + BLOCK]
                    slots = pa.array(np.arange(at, at + len(part)) + bases[number], pa.int64())
                    yield pa.RecordBatch.from_arrays([slots, *columns(part)], [c.split()[0] for c in spec.split(", ")])

    return volumes.select("volume", "data").mapInArrow(tidied(run), spec)


def _thinned(slots: np.ndarray) -> np.ndarray:
    """Runs of positions without a slot become one."""
    told = slots >= 0
    kept = told.copy()
    kept[1:] |= told[:-1]
    return slots[kept]


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32)


def _joined(parts: list[np.ndarray]) -> pa.RecordBatch | None:
    """One row of all parts, runs of positions without a slot being one."""
    thin = _thinned(np.concatenate([x for part in parts for x in (part, [NO_WORD])])) if parts else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array([thin.astype(np.int32).tobytes()], pa.binary())], ["slots"]) if len(thin) else None


def _sent(volumes: DataFrame, number: int):
    """One volume (``VOLUME`` keys or so) for every executor."""
    data = volumes.where(F.col("volume") == number).select("data").first()[0]
    return volumes.sparkSession.sparkContext.broadcast(data)


def _word_slots(rows: DataFrame, volumes: DataFrame, bases: dict[int, int], scratch: Scratch) -> DataFrame:
    """``slots``: numbers of frequent words in order, a row for a batch of texts.

    A pass for each volume; but for the last one, texts go on beside the slots found so far.
    """
    table = rows.select("lang", "text", F.lit(None).cast("binary").alias("slots"))
    for number, base in bases.items():
        sent, last = _sent(volumes, number), number == max(bases)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, base=base, last=last) -> Iterator[pa.RecordBatch]:
            volume = pickle.loads(sent.value)
            known: dict[str, dict[bytes, int]] = {}

            def slots(lang: str, text: bytes, before: bytes | None) -> np.ndarray:
                own, tokens = known.setdefault(lang, {}), tokens_of(text)
                seen = list(map(own.get, tokens))
                if None in seen:
                    if sum(map(len, known.values())) > HELD_WORDS:
                        for held in known.values():
                            held.clear()
                    new = list(set(tokens).difference(own))
                    own.update(zip(new, (s if s < 0 else s + base for s in volume.slots([_word_key(lang, w) for w in new])), strict=True))
                    own[b""], own[b"\n"] = SKIPPED, NO_WORD
                    seen = list(map(own.__getitem__, tokens))
                found = np.array(seen, np.int32)
                found = found[found != SKIPPED]
                return found if before is None else np.where(found >= 0, found, _array(before))

            for batch in batches:
                langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
                done = [slots(*x) for x in zip(langs, texts, batch.column(2).to_pylist(), strict=True)]
                if not last:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([x.tobytes() for x in done], pa.binary())], ["lang", "text", "slots"])
                elif (row := _joined(done)) is not None:
                    yield row

        after = scratch.keep(table.mapInArrow(tidied(run), "slots binary" if last else "lang string, text string, slots binary"))
        scratch.drop(table)
        table = after
    return table


def _pairs(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of neighbouring slots, and where they stand."""
    both = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    wide = slots.astype(np.int64)
    return (wide[both] << 32 | wide[both + 1]).view(np.uint64), both


class PairSums:
    """Counts of pairs by ascending key; what comes in waits until ``HELD_PAIRS`` are there."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.single: list[np.ndarray] = []
        self.counted: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        """Keys in any order, each once more; or ascending ones with their counts."""
        self.single.append(keys) if counts is None else self.counted.append((keys, counts))
        self.size += len(keys)
        if self.size >= HELD_PAIRS:
            self.settle()

    def settle(self) -> None:
        runs = [(self.keys, self.counts), *self.counted]
        if self.single:
            runs.append(np.unique(np.concatenate(self.single), return_counts=True))
        self.single, self.counted, self.size = [], [], 0
        keys, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
        if len(keys):
            order = np.argsort(keys, kind="stable")  # merges the ascending runs
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.keys, self.counts = keys[first], np.add.reduceat(counts, first)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest; first bytes first, then second ones."""
    narrow = values.astype(np.min_scalar_type(int(values.max())))
    return narrow.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _of_planes(data: bytes, count: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, count)
    return np.ascontiguousarray(planes.T).view(f"u{len(planes)}").ravel()


def _dealt(keys: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """``part, many, lefts, rights, counts``: ascending keys with their counts, a row for each part (or a piece of it)."""
    own = PerfectHash._place(keys, 0, parts)
    order = np.argsort(own, kind="stable")
    keys, counts, own = keys[order], counts[order], own[order]
    ends = np.flatnonzero(np.concatenate([own[1:] != own[:-1], [True]])) + 1
    rows, size, start = [], 0, 0
    for end in ends.tolist():
        for at in range(start, end, SHOWN_PAIRS):
            piece, n = keys[at : min(end, at + SHOWN_PAIRS)], counts[at : min(end, at + SHOWN_PAIRS)]
            lefts = np.diff(piece >> np.uint64(32), prepend=np.uint64(0))
            rows.append((int(own[at]), len(piece), _planes(lefts), _planes(piece & np.uint64(0xFFFFFFFF)), _planes(n)))
            size += len(piece)
            if size >= SHOWN_PAIRS:
                yield _dealt_rows(rows)
                rows, size = [], 0
        start = end
    if rows:
        yield _dealt_rows(rows)


def _dealt_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "many", "lefts", "rights", "counts"])


def _candidates(table: DataFrame, least: int, positions: int) -> DataFrame:
    """``pair``: keys of neighbours that occur ``least`` times.

    Tasks send their pairs packed, a row for each part; there are so many parts that one holds
    at most ``PART_PAIRS`` of ``positions`` neighbours or so.
    """
    parts = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-positions // PART_PAIRS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums()
        for batch in batches:
            for data in batch.column(0).to_pylist():
                sums.add(_pairs(_array(data))[0])
            if len(sums.keys) >= HELD_PAIRS:
                sums.settle()
                yield from _dealt(sums.keys, sums.counts, parts)
                sums = PairSums()
        sums.settle()
        if len(sums.keys):
            yield from _dealt(sums.keys, sums.counts, parts)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = PairSums()
        for batch in batches:
            for _, many, lefts, rights, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = np.cumsum(_of_planes(lefts, many), dtype=np.uint64) << np.uint64(32) | _of_planes(rights, many)
                sums.add(keys, _of_planes(counts, many).astype(np.int64))
        sums.settle()
        frequent = sums.keys[sums.counts >= least].view(np.int64)
        for at in range(0, len(frequent), SHOWN_PAIRS):
            yield pa.RecordBatch.from_arrays([pa.array(frequent[at : at + SHOWN_PAIRS])], ["pair"])

    sent = table.mapInArrow(tidied(run), "part int, many long, lefts binary, rights binary, counts binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(tidied(added), "pair long")


def _counted_slots(table: DataFrame, volumes: DataFrame, bases: dict[int, int], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A table with ``slots`` of the next level (rows without ``block``), and ``block,
    counts`` of all tasks, a block beginning at that slot. A pass for each volume."""
    names = ["slots", "found", "block", "counts"]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    rows, held, sums = table.select("slots", F.lit(None).cast("binary").alias("found")), None, []
    for number, base in bases.items():
        sent, last = _sent(volumes, number), number == max(bases)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, base=base, last=last) -> Iterator[pa.RecordBatch]:
            volume = pickle.loads(sent.value)
            totals = np.zeros(volume.hash.size, np.int64)
            row = lambda *values: pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(values, kinds, strict=True)], names)
            for batch in batches:
                for data, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    slots = _array(data)
                    keys, places = _pairs(slots)
                    own = volume.slots(keys)
                    hits = own[own >= 0]
                    reach = int(hits.max()) + 1 if len(hits) else 0
                    totals[:reach] += np.bincount(hits)
                    out = np.full(len(slots), NO_WORD, np.int32) if before is None else _array(before).copy()
                    out[places[own >= 0]] = hits + base
                    if not last:
                        yield row(data, out.tobytes(), None, None)
                    elif len(thin := _thinned(out)):
                        yield row(thin.tobytes(), None, None, None)
            for at in range(0, len(totals), BLOCK):
                if (part := totals[at : at + BLOCK]).any():
                    yield row(None, None, base + at, part.tobytes())

        after = scratch.keep(rows.mapInArrow(tidied(run), "slots binary, found binary, block long, counts binary"))
        own = after.where("block IS NOT NULL").select("block", "counts")
        sums.append(own if last else scratch.keep(own))
        scratch.drop(held)
        held, rows = after, after.where("block IS NULL").select("slots", "found")
    return held, functools.reduce(DataFrame.unionByName, sums)


def _by_slot(sums: DataFrame) -> DataFrame:
    """``slot, a`` of the blocks' slots that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(data, np.int64)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(at + block, pa.int64()), pa.array(counts[at])], ["slot", "a"])

    return sums.mapInArrow(tidied(run), "slot long, a long")


def _read_cuts(pairs: DataFrame, parts: DataFrame, total: int) -> DataFrame:
    """Phrases of a level from ``slot, left, right, a`` and the phrases one word shorter.

    ``heads`` and ``tails`` are counts of a phrase's first and last 1, 2, ... words.
    """
    uses = pairs.select(F.explode(F.array("left", "right")).alias("slot")).groupBy("slot").agg(F.count("*").alias("uses"))
    known = parts.join(uses, "slot")
    left = known.select(F.col("slot").alias("left"), "lang", "phrase", F.col("a").alias("left_a"), "heads", "uses")
    right = known.select(F.col("slot").alias("right"), "last", F.col("a").alias("right_a"), "tails", "uses")
    rows = hot_join(pairs, left, "left", F.col("uses"), total).drop("uses")
    rows = hot_join(rows, right, "right", F.col("uses"), total).drop("uses")
    phrase = F.concat("phrase", F.lit(" "), "last").alias("phrase")
    heads, tails = F.concat("heads", F.array("left_a")).alias("heads"), F.concat("tails", F.array("right_a")).alias("tails")
    return rows.select("slot", "left", "right", "lang", phrase, "last", "a", "left_a", "right_a", heads, tails)


def _scored(phrases: DataFrame, totals: DataFrame, words: int) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` by the lowest cut, the first of equal ones."""
    wide = lambda c: c.cast("decimal(19,0)")
    rows = phrases.join(F.broadcast(totals), "lang")
    cuts = []
    for k in range(1, words):
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))  # noqa: E741
        over, under = wide(F.col("a")) * wide(F.col("n")) * F.lit(1000), wide(l) * wide(r)
        rows = rows.withColumn(f"_over{k}", over).withColumn(f"_under{k}", under)
        cuts.append(F.struct(F.expr(f"_over{k} div _under{k}").alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    lowest = cuts[0] if len(cuts) == 1 else F.least(*cuts)
    return rows.select("lang", "phrase", "a", lowest.alias("cut"), "n").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, most_words: int = 5, top: int = 2000, volume: int = VOLUME
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are split at ``.,;:!?`` and line ends, pieces at blanks and tabs; A-Z are
    lower-cased. ``a`` counts a phrase of 2 to ``most_words`` words, overlaps included, ``l``
    and ``r`` the two sides of the cut with the lowest ``floor(1000 * a * n / (l * r))``,
    ``n`` all words of the language. A phrase that a longer one of as many occurrences holds
    is left out. Ties go by ``a``, then by bytes of the phrase. Null texts have no words, a
    null language is ``und``; ids are not read, so repeated rows count each; texts are read
    whole; an empty table has no rows. Any ``volume`` gives the same result.
    """
    session = docs.sparkSession
    bound_batches(session)
    scratch = Scratch(session)
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = scratch.keep(word_counts(rows).where(f"word IS NULL OR n >= {int(least)}"))
    totals = counted.where("word IS NULL").select("lang", "n")
    words = counted.where("word IS NOT NULL")
    count, positions = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = []
    if count:
        volumes = _volumes(words, ["lang", "word"], count, volume, lambda langs, ws: WordVolume([_word_key(x, w) for x, w in zip(langs.to_pylist(), ws.to_pylist(), strict=True)]), scratch)
        bases = _bases(volumes)
        keys = _keys_by_slot(volumes, bases, "slot long, key binary", lambda part: [pa.array(part, pa.binary())])
        blank = F.expr("instr(cast(key AS string), ' ')")
        text = F.col("key").cast("string")
        told = keys.select("slot", F.substring(text, blank + 1, F.length(text)).alias("lang"), F.substring(text, 1, blank - 1).cast("binary").alias("word")).join(words, ["lang", "word"])
        none = F.array().cast("array<long>")
        word = F.col("word").cast("string")
        parts = scratch.keep(told.select("slot", "lang", word.alias("phrase"), word.alias("last"), F.col("n").alias("a"), none.alias("heads"), none.alias("tails")))
        slots = table = _word_slots(rows, volumes, bases, scratch)
    for k in range(2, most_words + 1) if count else []:
        pairs = scratch.keep(_candidates(slots, least, positions))
        count = pairs.count()
        if not count:
            break
        volumes = _volumes(pairs, ["pair"], count, volume, lambda keys: PairVolume(keys.to_numpy().view(np.uint64)), scratch)
        bases = _bases(volumes)
        after, sums = _counted_slots(slots, volumes, bases, scratch)
        scratch.drop(table)
        table, slots = after, after.where("block IS NULL").select("slots")
        keys = _keys_by_slot(volumes, bases, "slot long, left long, right long", lambda part: [pa.array((part >> np.uint64(32)).astype(np.int64)), pa.array((part & np.uint64(0xFFFFFFFF)).astype(np.int64))])
        summed = scratch.keep(tree_summed(sums, ["block"]))  # no task runs two Python steps, as each has a worker
        own = scratch.keep(keys.join(_by_slot(summed).where(F.col("a") >= least), "slot"))
        scratch.drop(summed)
        parts = scratch.keep(_read_cuts(own, parts, own.count()))
        found.append(parts)
    scratch.drop(table) if count else None
    scored = [docs.sparkSession.createDataFrame([], "lang string, phrase string, a long, l long, r long, n long, score long")]
    for k, phrases in enumerate(found, 2):
        left = phrases
        if k - 1 < len(found):
            longer = found[k - 1]
            covered = longer.where("a = left_a").select(F.col("left").alias("slot")).union(longer.where("a = right_a").select("right")).distinct()
            left = phrases.join(covered, "slot", "left_anti")
        scored.append(_scored(left, totals, k))
    everything = functools.reduce(DataFrame.unionByName, scored)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = everything.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[ 	]+'), lambda w: w <> '') AS words
  FROM (SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents)
), cut AS (
  SELECT lang, k, words[i:i + k - 1] AS phrase FROM pieces, range(1, 6) AS a(k), unnest(range(1, len(words) - k + 2)) AS b(i)
), counted AS (
  SELECT lang, k, array_to_string(phrase, ' ') AS phrase, count(*) AS f FROM cut GROUP BY ALL HAVING count(*) >= 100
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang
), cuts AS (
  SELECT c.lang, c.k, c.phrase, c.f AS a, j, array_to_string(string_split(c.phrase, ' ')[:j], ' ') AS first, array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ') AS rest
  FROM counted c, unnest(range(1, k)) AS u(j)
), scores AS (
  SELECT x.lang, x.k, x.phrase, a, p.f AS l, q.f AS r, n, j, CAST(1000::HUGEINT * a * n // (p.f::HUGEINT * q.f) AS BIGINT) AS score
  FROM cuts x JOIN counted p ON p.lang = x.lang AND p.phrase = x.first JOIN counted q ON q.lang = x.lang AND q.phrase = x.rest JOIN totals t ON t.lang = x.lang
), lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), covered AS (
  SELECT DISTINCT lang, part AS phrase, f FROM (
    SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[:k - 1], ' '), array_to_string(string_split(phrase, ' ')[2:], ' ')]) AS part FROM counted WHERE k > 2)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM lowest w WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = w.lang AND c.phrase = w.phrase AND c.f >= w.a)
) WHERE rank <= 2000
"""
