"""Quality rules: base counts, and repeated substrings found with a suffix array.

Words of a text are numbered, their suffixes sorted by prefix doubling, and longest common
prefixes of neighbours read off the doubling's ranks. Each interval of neighbours with a
common prefix is a repeated substring; it is maximal if its occurrences are preceded by
different words. The spans of all occurrences are united. The limits are on the covered
fraction of the words and on the longest repeat.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plurality.llm.common import map_batches, texts

# What parts words, and the characters counted as symbols.
GAPS = re.compile("[\x20\x09-\x0d]")
SYMBOLS = "#*$%&|<>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").split()


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows that the text holds twice or more, the first one included."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    windows = ids[:n]
    for i in range(1, width):
        windows = _dense(windows * (len(ids) + 1) + ids[i : i + n])
    again = np.bincount(windows)[windows] > 1
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, np.flatnonzero(again), 1)
    np.add.at(cover, np.flatnonzero(again) + width, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted suffixes, and ranks of the windows of 1, 2, 4... words at each position."""
    n, rank, width, levels = len(ids), _dense(ids), 1, []
    levels.append(rank)
    while rank.max(initial=0) < n - 1:
        after = np.zeros(n, np.int64)
        if width < n:
            after[: n - width] = rank[width:] + 1
        rank = _dense(rank * (n + 1) + after)
        levels.append(rank)
        width *= 2
    return np.argsort(rank), levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """``lcp[i]``: words that suffixes ``order[i]`` and ``order[i + 1]`` begin with alike."""
    n = len(order)
    a, b, length = order[:-1], order[1:], np.zeros(max(n - 1, 0), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        width, rank = 1 << k, levels[k]
        i, j = a + length, b + length
        inside = np.maximum(i, j) + width <= n
        same = inside & (rank[np.minimum(i, n - 1)] == rank[np.minimum(j, n - 1)])
        length += same * width
    return length


def maximal_repeats(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(length, first, last) of each common-prefix interval that is a maximal repeat."""
    out, stack = [], []
    before = np.where(order > 0, ids[order - 1], -1 - np.arange(len(order)))
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    for i in range(len(lcp) + 1):
        here, start = (int(lcp[i]) if i < len(lcp) else 0), i
        while stack and stack[-1][0] > here:
            length, start = stack.pop()
            if changes[i] > changes[start]:
                out.append((length, start, i))
        if here >= least and (not stack or stack[-1][0] < here):
            stack.append((here, start))
    return out


def innermost(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Of each of ``n`` suffixes, in order, the length of the innermost interval it is in.

    Intervals nest or lie apart, and an inner one is longer; each suffix is written once.
    """
    out, open_, at = np.zeros(n, np.int64), [], 0

    def until(end: int) -> None:
        nonlocal at
        if open_ and end > at:
            out[at:end] = open_[-1][1]
        at = max(at, end)

    for length, first, last in sorted(found, key=lambda x: (x[1], -x[2])):
        while open_ and open_[-1][0] < first:
            until(open_[-1][0] + 1)
            open_.pop()
        until(first)
        open_.append((last, length))
    while open_:
        until(open_[-1][0] + 1)
        open_.pop()
    return out


def repeats(ids: np.ndarray, least: int) -> tuple[int, int, int]:
    """(covered words, longest repeat, maximal repeats) over repeats of ``least`` words on."""
    if len(ids) < 2:
        return 0, 0, 0
    order, levels = suffix_array(ids)
    lcp = common_prefixes(order, levels)
    if lcp.max(initial=0) < least:
        return 0, int(lcp.max(initial=0)), 0
    found = maximal_repeats(ids, order, lcp, least)
    longest = max(length for length, _, _ in found)
    # spans of all occurrences of all maximal repeats: a repeat that is not maximal lies
    # inside a longer one wherever it stands
    reach = np.zeros(len(ids), np.int64)
    reach[order] = innermost(found, len(ids))
    end = np.maximum.accumulate(np.arange(len(ids)) + reach)
    return int((end > np.arange(len(ids))).sum()), longest, len(found)


def repetition_rules(
    docs: DataFrame,
    least_words: int = 50,
    most_repeat_percent: int = 50,
    least_repeat: int = 8,
    most_covered: float = 0.2,
    most_longest: int = 200,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: counts, the base rules' and the suffix array's verdict.

    Words are runs of other than blank, tab, line and page feeds. ``word_chars`` are code
    points in words, ``n_symbols`` of ``#*$%&|<>``; ``n_dup_lines`` lines with a word that
    equal an earlier line; ``n_repeat_words`` words in 3-word windows found twice or more.
    ``base_failed``: under ``least_words`` words, or over ``most_repeat_percent`` of them
    repeated. ``covered`` words lie in repeats of ``least_repeat`` words or more;
    ``longest_repeat`` is in words. ``kept`` is false if the base fails, if ``covered`` is
    over ``most_covered`` of the words, or if the longest repeat is over ``most_longest``.
    Null and empty texts have no words and fail; texts of any length are taken whole (memory
    follows the longest text of a batch). Nulls in the id and repeated rows stay.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered", "longest_repeat", "n_maximal_repeats"]

    def judge(text: str) -> tuple:
        words = words_of(text)
        n, ids = len(words), numbered(words)
        lines = [x for x in text.split("\n") if GAPS.sub("", x)]
        again = repeated_words(ids)
        failed = n < least_words or 100 * again > most_repeat_percent * n
        covered, longest, count = repeats(ids, least_repeat)
        kept = not failed and covered <= most_covered * n and longest <= most_longest
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
        return n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, kept, covered, longest, count

    def step(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        rows = [judge(x) for x in texts(column)]
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
        kinds = [pa.bool_() if x in ("base_failed", "kept") else pa.int64() for x in names]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, *names])

    spec = ", ".join(f"{x} {'boolean' if x in ('base_failed', 'kept') else 'long'}" for x in names)
    return map_batches(docs, [id_col, text_col], step, f"`{id_col}` {kind}, {spec}")
