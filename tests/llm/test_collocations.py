"""Operator 12 against plain counting, on odd rows and with many small volumes."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from plurality.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts.setdefault(lang, Counter()).update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        rows = []
        for p, a in f.items():
            if len(p) == 1 or a < least:
                continue
            longer = (q for q, n in f.items() if n == a and len(q) > len(p))
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            score, _, l, r = min((1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, totals[lang], -score) for i, (score, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


def result(spark, docs, least, top, **more):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS slot", "2 AS phrase", "3 AS n", "4 AS word")
    rows = collocations.collocations(frame.repartition(5), least=least, top=top, **more)
    assert rows.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, rows.collect()))


def made(n=160):
    rng = random.Random(11)
    words = ["The", "of", "New", "york", "é", "É", "ab\x01", "x y", "ß", "city", "Z", "\x1f"] + [f"w{i}" for i in range(30)]
    fixed = ["New York city of the w1", "a b a b a b a", "same same same same same same"]

    def text():
        out = []
        for _ in range(rng.randrange(40)):
            out.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            out.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ",", "\x0b", "\r\n"]))
        return "".join(out)

    docs = [(i, text(), rng.choice(["en", "fr", None, "", "x y"])) for i in range(n)]
    return docs + docs[:9] + [(None, None, "en"), (1, "", None), (2, " . ", "zz"), (3, "once", "und")]


@pytest.mark.parametrize(("least", "top", "volume"), [(5, 2000, 1 << 20), (5, 10, 1 << 20), (4, 2000, 21), (10**6, 5, 50)])
def test_equals_plain_counts(spark, least, top, volume):
    docs = made()
    assert result(spark, docs, least, top, volume=volume) == brute(docs, least, top)


def test_empty_and_long(spark):
    assert result(spark, [], 2, 10) == []
    docs = [(1, "a bc " * 60_000 + "d" * 500_000, "en")]
    assert result(spark, docs, 100, 10) == brute(docs, 100, 10)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
    built = collocations.PairVolume(keys)
    assert sorted(built.slots(keys).tolist()) == list(range(len(keys)))
    others = np.setdiff1d(rng.integers(0, 2**63, 1000, dtype=np.uint64), keys)
    assert (built.slots(others) == -1).all()


def test_words_of_equal_hashes_get_another_seed(monkeypatch):
    plain = collocations.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(collocations.xxhash, "xxh3_64_intdigest", lambda w, seed: plain(w, seed) if seed else 7)
    built = collocations.WordVolume([b"a en", b"b en"])
    assert built.seed == 1
    assert sorted(built.slots([b"a en", b"b en"])) == [0, 1]
    assert built.slots([b"c en"]) == [-1]


def test_pairs_are_added_up_and_dealt_whole(monkeypatch):
    monkeypatch.setattr(collocations, "HELD_PAIRS", 500)
    monkeypatch.setattr(collocations, "SHOWN_PAIRS", 64)
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 40, 5000, dtype=np.uint64) << np.uint64(32) | rng.integers(0, 2**31, 5000, dtype=np.uint64) % np.uint64(70)
    keys[:3] = (2**31 - 1) << 32 | (2**31 - 1), 0, 7
    sums = collocations.PairSums()
    for part in np.array_split(keys, 37):
        sums.add(part)
    sums.settle()
    plain = Counter(keys.tolist())
    assert dict(zip(sums.keys.tolist(), sums.counts.tolist(), strict=True)) == plain
    assert (np.diff(sums.keys.astype(object)) > 0).all()
    again, where = collocations.PairSums(), {}
    for factor in (1, 300, 70_000, 2**33):
        for batch in collocations._dealt(sums.keys, sums.counts * factor, 5):
            for part, many, lefts, rights, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.cumsum(collocations._of_planes(lefts, many), dtype=np.uint64) << np.uint64(32) | collocations._of_planes(rights, many)
                assert all(where.setdefault(k, part) == part for k in own.tolist())
                again.add(own, collocations._of_planes(counts, many).astype(np.int64))
    again.settle()
    assert set(where.values()) == set(range(5))
    assert dict(zip(again.keys.tolist(), again.counts.tolist(), strict=True)) == {k: n * (1 + 300 + 70_000 + 2**33) for k, n in plain.items()}


def test_tasks_send_few_rows_of_many_pairs(spark, monkeypatch):
    """A row for each pair grew faster than the input: more words are frequent in a larger one."""
    slots = np.random.default_rng(5).integers(0, 3000, 60_000).astype(np.int32)
    monkeypatch.setattr(collocations, "PART_PAIRS", 7000)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = collocations._candidates(spark.createDataFrame([(bytearray(slots.tobytes()),)], "slots binary").coalesce(1), 2, len(slots))
        found = [r.pair for r in rows.collect()]
        plan, made = rows._jdf.queryExecution().executedPlan(), []
        while plan.children().size():
            if plan.nodeName() == "MapInArrow":
                made.append(plan.metrics().apply("pythonNumRowsReceived").value())
            plan = plan.children().head()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    counts = Counter((slots[:-1].astype(np.int64) << 32 | slots[1:]).tolist())
    assert sorted(found) == sorted(k for k, n in counts.items() if n >= 2)
    assert made[0] == len(found)
    assert 9 <= made[1] <= 64 < len(counts)
