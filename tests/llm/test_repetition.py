import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from plurality.llm import repetition as rep


def brute_repeats(ids, least):
    n, covered, longest, maximal = len(ids), set(), 0, 0
    for length in range(1, n):
        seen = {}
        for i in range(n - length + 1):
            seen.setdefault(tuple(ids[i : i + length]), []).append(i)
        for key, at in seen.items():
            if len(at) > 1:
                longest = max(longest, length)
                if length >= least:
                    covered |= {p for i in at for p in range(i, i + length)}
                    after = {ids[i + length] if i + length < n else -1 - i for i in at}
                    before = {ids[i - 1] if i else -1 for i in at}
                    maximal += len(after) > 1 and len(before) > 1
    return len(covered), longest, maximal


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 5))
def test_repeats(ids, least):
    array = np.array(ids, np.int64)
    got, want = rep.repeats(array, least), brute_repeats(ids, least)
    assert got[1] == want[1]
    if want[1] >= least:
        assert got == want
    windows = Counter(tuple(ids[i : i + 3]) for i in range(len(ids) - 2))
    covered = {i + k for i in range(len(ids) - 2) if windows[tuple(ids[i : i + 3])] > 1 for k in range(3)}
    assert rep.repeated_words(array) == len(covered)


def test_rules(spark):
    good = " ".join(f"w{i}" for i in range(60))
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, good), (2, None), (3, ""), (None, good), (1, good), (4, good + " " + passage + " x " + passage + " y " + passage), (5, "a b\n \na b\n\x0b\na b # <x>\n"), (6, "la " * 80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS kept")
    got = [r.asDict() for r in rep.repetition_rules(docs).collect()]
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 8 and by[1]["kept"] and not by[1]["base_failed"]
    assert by[2]["n_words"] == by[3]["n_words"] == 0 and by[2]["base_failed"] and not by[3]["kept"]
    assert not by[4]["base_failed"] and not by[4]["kept"] and by[4]["covered"] == 60 and by[4]["longest_repeat"] == 20
    assert (by[5]["n_dup_lines"], by[5]["n_symbols"], by[5]["word_chars"], by[5]["n_words"]) == (1, 3, 10, 8)
    assert by[6]["base_failed"] and by[6]["n_repeat_words"] == 80
    for r, (_, text) in zip(got, rows, strict=True):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
    assert rep.repetition_rules(docs.limit(0)).count() == 0


def test_very_long_and_periodic_texts(spark):
    """Twenty thousand words of one period, and of hundreds of nested repeats."""
    period = " ".join(f"w{i % 7}" for i in range(20_000))
    nested = " ".join(f"w{i}" for k in range(40, 240) for i in range(k))
    docs = spark.createDataFrame([(1, period), (2, nested)], "doc_id long, text string")
    got = {r.doc_id: r for r in rep.repetition_rules(docs).collect()}
    assert (got[1].covered, got[1].longest_repeat, got[1].kept) == (20_000, 19_993, False)
    assert got[2].covered == len(nested.split()) - 1 and got[2].longest_repeat == 238
