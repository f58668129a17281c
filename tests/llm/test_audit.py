"""Operator 13 against plain loops, on odd rows."""

import itertools
import random
import re

from plurality.llm import audit

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(docs, labels):
    good, toxic = ({d for d, *marks in labels if d is not None and marks[i] == 1} for i in (0, 1))
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    seen = {}
    for doc, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and doc > least[text],
        }
        seen.setdefault(lang or "", []).append((fails, doc in good, doc in toxic))
    rows = []
    for part, all_ in seen.items():
        own, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(all_)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                shapley[f] += len(gone)
                alone = sum(x[0][f] and sum(x[0].values()) == 1 for x in all_)
                own.append((f, (part, "".join(order), step, len(left), len(gone), sum(x[0][f] for x in all_) - len(gone), alone, sum(x[1] for x in gone), sum(x[2] for x in gone))))
        rows += [(*r, shapley[f]) for f, r in own]
    return sorted(rows)


def result(spark, docs, labels, extra=False):
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    if extra:
        frame, marks = (x.selectExpr("*", "1 AS part", "2 AS mask", "3 AS label", "4 AS n", "5 AS salt", "6 AS digest") for x in (frame, marks))
    return sorted(tuple(r[c] for c in COLUMNS) for r in audit.filter_audit(frame, marks).collect())


def test_equals_plain_loops(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Éa", "BIG", "a#b", "x|", "ß"]

    def text():
        few = rng.choice([3, 60, 400])
        return " ".join(rng.choice(words[: rng.choice([few, 405])]) for _ in range(rng.choice([0, 1, 99, 100, 101, 150]))) + rng.choice(["", "\n", "\x0b"])

    texts = [text() for _ in range(60)] + [None, "", " ", "ABC " * 40]
    docs = [(rng.choice([None, *range(90)]), rng.choice(texts), rng.choice(["en", "fr", None, ""])) for _ in range(300)]
    docs += docs[:20]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert result(spark, docs, labels, extra=True) == brute(docs, labels)


def test_no_rows_no_labels_and_long_texts(spark):
    assert result(spark, [], []) == []
    long_text = " ".join(f"word{i}" for i in range(200_000))
    docs = [(1, long_text, "en"), (2, long_text, "en"), (3, "x" * 2_000_000, "en")]
    assert result(spark, docs, []) == brute(docs, [])


def test_one_text_many_parts(spark):
    docs = [(i, "same", f"l{i % 7}") for i in range(3000)]
    assert result(spark, docs, [(i, 1, 0) for i in range(0, 3000, 3)]) == brute(docs, [(i, 1, 0) for i in range(0, 3000, 3)])
