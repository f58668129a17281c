import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plurality.llm import jaccard


def brute_sets(rows, size):
    import re

    out = []
    for doc, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if not words:
            out.append((doc, frozenset()))
        elif len(words) < size:
            out.append((doc, frozenset([tuple(words)])))
        else:
            out.append((doc, frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))))
    return out


def brute(rows, size, percent):
    sets = brute_sets(rows, size)
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((root(a), root(b)))
                up[b_] = a_
    return sorted((d, len(s), root(d)) for d, s in sets)


def corpus(seed, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, base = [], [rng.choices(words, k=rng.choice([1, 2, 3, 5, 9, 30, 60, 200])) for _ in range(12)]
    for i in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((i * 3, " ".join(text).upper() if i % 7 == 0 else "\n".join(text)))
    return rows + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "é ñ"), (9005, "É ñ"), (9006, "é\xa0ñ"), (9007, "é ñ")]


@pytest.mark.parametrize(("size", "percent", "chunk"), [(3, 90, None), (5, 80, None), (3, 90, 400), (1, 50, 300)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, chunk):
    if chunk:
        monkeypatch.setattr(jaccard, "CHUNK_NGRAMS", chunk)
    rows = corpus(size + percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS doc", "1 AS n", "2 AS k1").repartition(5)
    got = sorted(tuple(r) for r in jaccard.ngram_components(docs, size, percent).collect())
    assert got == brute(rows, size, percent)


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.ngram_components(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (2, 2, 1), (3, 0, 3)], key=str)
    assert jaccard.ngram_components(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1, max_size=30), min_size=1, max_size=25), st.sampled_from([50, 70, 80, 90, 100]))
def test_tree_links(sets, percent):
    arrays = [np.array(sorted(s), np.uint64) for s in sets]
    tree = jaccard.PrefixTree(arrays, percent)
    for at in range(len(sets)):
        others = np.ones(len(sets), bool)
        others[at] = False
        got = {tree.place[k] for k in tree.links(at, others)}
        mine = sets[tree.place[at]]
        assert got == {i for i, s in enumerate(sets) if i != tree.place[at] and 100 * len(s & mine) >= percent * len(s | mine)}


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(0, 10**6), min_size=1, max_size=120), st.sampled_from([50, 80, 90]), st.randoms(use_true_random=False))
def test_linked_sets_see_what_is_asked(base, percent, rng):
    other = set(base)
    for x in sorted(base):
        if rng.random() < (100 - percent) / 250:
            other.discard(x)
        if rng.random() < (100 - percent) / 250:
            other.add(rng.randrange(10**6, 10**7))
    if other and 100 * len(base & other) >= percent * len(base | other):
        a, b = (np.sort(jaccard.mixed(np.array(sorted(s), np.uint64))) for s in (base, other))
        both = set(jaccard.shown(a, percent).tolist()) & set(jaccard.shown(b, percent).tolist())
        assert len(both) >= max(jaccard.asked(len(a), percent), jaccard.asked(len(b), percent))


def test_hits_count_shared_cells_and_ends():
    import pyarrow as pa

    cells, docs = [1, 2, 2, 3, 4, 4, 4, 5], [9, 9, 8, 9, 7, 8, 9, 9]
    for cut in range(1, 8):
        parts = [pa.RecordBatch.from_arrays([pa.array(c), pa.array(d)], ["cell", "doc"]) for c, d in ((cells[:cut], docs[:cut]), (cells[cut:], docs[cut:]))]
        total = {}
        for batch in jaccard._seen(iter(parts)):
            for doc, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total[doc] = total.get(doc, 0) + hits
        assert total == {9: 4, 8: 2, 7: 1}  # 2 and 4 are shared, 1 and 5 are ends


def test_very_long_texts_and_ties(spark, monkeypatch):
    """A text of two hundred thousand words, its near copy just on either side of the threshold, and equal sets of unlike texts."""
    monkeypatch.setattr(jaccard, "CHUNK_NGRAMS", 5000)
    words = [f"w{i}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:190_000])), (3, " ".join(words[:100_000])), (4, "a b a b a b"), (5, "a b a b a b a b"), (6, "b a b a b")]
    rows += [(10 + i, " ".join(words[i : i + 100])) for i in range(0, 60, 5)] + [(90, "p q r"), (91, "q p r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.ngram_components(docs, 3, 90).collect())
    assert got == brute(rows, 3, 90)
    assert [c for d, _, c in got if d in (2, 3, 5, 6)] == [1, 3, 4, 4]
