"""Column functions on small tables of cases."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plurality.functions import answers as A
from plurality.functions import guards as G
from plurality.functions import hashing as H
from plurality.functions import normalize as N
from plurality.functions import views as V
from plurality.operators import controller as K
from plurality.operators import matching as M
from plurality.operators import metrics as X
from plurality.operators import sampling as T
from plurality.operators import selection as L


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_explicit_answers(spark):
    cases = [
        ("math_qa", "thinking\nAnswer: (b)", None, "B"),
        ("math_qa", "Answer: 0.036 (A)", None, "A"),
        ("math_qa", "Answer: C\nAnswer: none of these", None, "C"),
        ("arc_easy", "**Final Answer:** 2", None, "B"),
        ("gsm8k", "Answer: $1,234.00", None, "1234"),
        ("gsm8k", "Answer: 1,23", None, None),
        ("svamp", "answer: minus one hundred and five apples", None, "-105"),
        ("svamp", "answer: two thousand three hundred", None, "2300"),
        ("object_counting", "Answer: 7.0", None, "7"),
        ("svamp", "the answer is 5", None, None),
        ("other", "Answer: \\boxed{ D }", None, "D"),
        ("other", "Answer: 3.5e2", None, "C"),
        ("svamp", "Answer: 3.5e2", None, "3.5e2"),
        ("other", "myanswer: 4", None, None),
        ("x", "Answer: E", "numeric", None),
        ("svamp", None, None, None),
        ("svamp", "Answer:\n\n12", None, None),
    ]
    got = values(spark, [c[:3] for c in cases], "d string, t string, k string", A.explicit_answer(F.col("d"), F.col("t"), F.col("k")))
    assert got == [c[3] for c in cases]


def test_numbers_and_options(spark):
    cases = [("Answer: $1,000.00", "1000"), ("-0.0", "0"), ("1e3", "1000"), ("1.50E-3", "0.0015"), (".5", "0.5"), ("+7.", "7"), ("(12)", "12"), ("12%", None), ("", None), (None, None), ("0012.3400", "12.34"), ("-5e0", "-5")]
    got = values(spark, [(c[0],) for c in cases], "v string", N.normalize_number(F.col("v"))["normalized"])
    assert got == [c[1] for c in cases]
    options = [("b", "B", "valid"), ("Option: 3", "C", "valid"), ("F", None, "out_of_answer_space"), ("0", None, "out_of_answer_space"), ("A or B", None, "invalid_format"), (" ", None, "missing_answer"), (None, None, "missing_answer"), ("[d].", None, "invalid_format"), ("[d]", "D", "valid"), ("2.0", "B", "valid")]
    got = values(spark, [(c[0],) for c in options], "v string", N.normalize_option(F.col("v"), F.lit(5)))
    assert [(g["normalized"], g["status"]) for g in got] == [c[1:] for c in options]


def test_guards(spark):
    text = ["0.5", "nan", "inf", "x", None, "-1", "1.5"]
    assert values(spark, [(t,) for t in text], "v string", G.probability(F.col("v"))) == [0.5, None, None, None, None, None, None]
    assert values(spark, [(t,) for t in text], "v string", G.non_negative(F.col("v"))) == [0.5, None, None, None, None, None, 1.5]
    flags = ["TRUE", " no", "invalid", "maybe", None, ""]
    assert values(spark, [(t,) for t in flags], "v string", G.flag(F.col("v"), True)) == [True, False, False, None, True, False]
    keys = ["N/A", " a ", "f", "x y", None, "<invalid>"]
    assert values(spark, [(t,) for t in keys], "v string", G.answer_key(F.col("v"))) == [None, "A", "f", "x y", None, None]
    assert values(spark, [("7.0",), ("b c",), ("",)], "v string", G.answer_upper(F.col("v"))) == ["7", "B C", None]
    row = [("option_permutation", 0, "g0")]
    schema = "t string, v int, r string"
    assert values(spark, row, schema, G.identity_by_type_first(F.col("t"), F.col("v"), F.col("r"))) == [False]
    assert values(spark, row, schema, G.identity_by_any(F.col("t"), F.col("v"), F.col("r"))) == [True]


def test_hashes(spark):
    want = hashlib.sha256("ä\0None\x001".encode()).hexdigest()[:16]
    assert values(spark, [("ä", None, 1)], "a string, b string, c int", H.stable_id(F.col("a"), F.col("b"), F.col("c"))) == [want]
    number = int.from_bytes(hashlib.sha256(b"ns\x001\0d\0q").digest()[:8], "big") / 2**64
    assert values(spark, [("d", "q")], "d string, q string", H.holdout_fraction("ns", 1, F.col("d"), F.col("q"))) == [number]
    rows = spark.createDataFrame([("d", i) for i in range(10)] + [("one", 1)], "dataset_name string, question_id int")
    split = {(r[0], r[1]): r[2] for r in H.group_split(rows, 0.25, 3).collect()}
    first = sorted(range(10), key=lambda i: hashlib.sha256(f"3\0{i}".encode()).hexdigest()[:32])[:2]
    assert {i for i in range(10) if split["d", i] == "test"} == set(first) and split["one", 1] == "train"


def test_permutations(spark):
    rows = spark.createDataFrame([(1, ["x", "y", "z"]), (2, ["p", "q"])], "question_id int, options array<string>")
    out = V.option_views(rows, 4, 5).withColumn("shown", V.permuted(F.col("options"), F.col("sources"))).withColumn("back", V.inverse_map(F.col("sources"))).withColumn("there", V.forward_map(F.col("sources"))).collect()
    assert sorted((r.question_id, r.view_index) for r in out) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    for r in out:
        assert all(r.there[v] == k for k, v in r.back.items())
        assert [r.options["ABC".index(r.back[label])] for label in "ABC"[: len(r.options)]] == r.shown
        assert r.view_index or r.shown == r.options


def test_yes_probability_and_losses(spark):
    rows = spark.createDataFrame([([("Yes", -0.1), (" Yes.", -3.0), ("No", -2.5)],)], "t array<struct<token:string,logprob:double>>")
    r = rows.select(A.yes_no_probability(F.col("t")).alias("p")).first().p
    assert abs(r.yes - (np.exp(-0.1) + np.exp(-3))) < 1e-12 and abs(r.no - np.exp(-2.5)) < 1e-12
    assert values(spark, [(0.2, 0.5), (3.0, 1.0)], "a double, b double", T.smooth_l1(F.col("a"), F.col("b"))) == pytest.approx([0.045, 1.5])
    assert values(spark, [(0.2, 1.0)], "a double, b double", T.binary_cross_entropy(F.col("a"), F.col("b"))) == pytest.approx([-np.log(0.2)])


def greedy(items, threshold):
    leaders, out, made = [], [], 0
    for answer, tokens, own in items:
        if own is not None:
            out.append(own)
            if own not in [x[0] for x in leaders]:
                leaders.append((own, answer, tokens))
            continue
        best, top = None, -1.0
        for name, a, t in leaders:
            v = 1.0 if not t | tokens else len(t & tokens) / len(t | tokens)
            if a == answer and v >= threshold and v > top:
                best, top = name, v
        if best is None:
            best, made = f"B{made:04d}", made + 1
            leaders.append((best, answer, tokens))
        out.append(best)
    return out


def test_clusters_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(q, p, "ab"[rng.integers(2)], " ".join(f"w{i}" for i in rng.integers(0, 8, rng.integers(0, 7))), "own" if rng.random() < 0.1 else None) for q in range(30) for p in range(12)]
    frame = spark.createDataFrame(rows, "question_id int, pos long, answer string, text string, own string")
    got = {(r.question_id, r.pos): r.cluster for r in K.strategy_clusters(frame, F.array_distinct(F.filter(F.split("text", " "), lambda w: w != "")), 0.4, F.col("own")).collect()}
    for q in range(30):
        mine = [r for r in rows if r[0] == q]
        assert [got[q, r[1]] for r in mine] == greedy([(r[2], set(r[3].split()), r[4]) for r in mine], 0.4)


def test_bootstrap_equals_a_loop(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": 1, "question_id": np.arange(60)[::-1], "ref_score": rng.random(60), "ref_correct": rng.integers(0, 2, 60), "score": rng.random(60), "correct": rng.integers(0, 2, 60)})
    pairs = spark.createDataFrame(frame)
    for metric in ("accuracy", "brier", "ece_paper", "ece_strict"):
        r = X.paired_bootstrap(pairs, ["g"], metric, 50, 9).first()
        s = frame.sort_values("question_id").to_numpy()
        g, deltas = np.random.default_rng(9), []
        for _ in range(50):
            at = g.integers(0, 60, size=60)
            deltas.append(X._values(s[at, 5], s[at, 4], metric, 10) - X._values(s[at, 3], s[at, 2], metric, 10))
        assert (r.low, r.high) == pytest.approx(tuple(np.percentile(deltas, [2.5, 97.5])))
    h = X.hashed_bootstrap(pairs, ["g"], "brier", 300).first()
    e = X.paired_bootstrap(pairs, ["g"], "brier", 300, 1).first()
    assert abs(h.low - e.low) < 6 and abs(h.high - e.high) < 6


def test_matching(spark):
    candidates = spark.createDataFrame([(1, "q1", 10, "x"), (2, "zz", 11, "y"), (3, "zz", 99, "same"), (4, "zz", 99, "none")], "cid int, question_id string, source int, text string")
    questions = spark.createDataFrame([("q1", 50, "t", 100), ("q2", 11, "u", 200), ("q3", 77, "same", 300), ("q4", 78, "same", 400)], "question_id string, source int, text string, target int")
    got = {r.cid: (r.match, r.level, r.hits) for r in M.cascade(candidates, questions, ["question_id", "source", "text"], "cid", "target").collect()}
    assert got == {1: (100, "question_id", 1), 2: (200, "source", 1), 3: (None, "text", 2), 4: (None, None, 0)}
    assert M.align(candidates, questions, "question_id", "source").count() == 1
    assert M.align(candidates.where("cid = 2"), questions, "question_id", "source").count() == 1
    rows = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, None, 1), (2, "b", 2)], "k int, v string, o int")
    kept, bad = M.distinct_or_conflict(rows, ["k"], "o", ["v"])
    assert {tuple(r) for r in kept.collect()} == {(1, "a", 1), (2, None, 1)} and [r.k for r in bad.collect()] == [2]
    assert [r.k for r in M.conflicting_values(rows, "k", "v").collect()] == [2]
    assert [r[0] for r in M.leaks(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, split string"), "k").collect()] == [1]
    shards = spark.createDataFrame([("a", True, 3), ("a", True, 4), ("b", False, 5), ("b", False, 6)], "source string, disjoint boolean, questions long")
    assert {tuple(r) for r in M.expected_questions(shards).collect()} == {("a", 7), ("b", 6)}


def test_selection(spark):
    curve = spark.createDataFrame([(0.1, 10, 5, 20), (0.2, 10, 9, 40), (0.3, 10, 1, 40), (0.4, 10, 9, 90)], "parameter double, questions long, correct long, used long")
    assert [(r.target, r.parameter) for r in L.match_budgets(curve, [4, 8]).orderBy("target").collect()] == [(4, 0.2), (8, 0.2)]
    assert [(r.target, r.parameter) for r in L.match_budgets(curve, [8], analysis=True).collect()] == [(8, 0.4)]
    assert [r.target for r in L.unmet_targets(curve, [1, 4]).collect()] == [1]
    good = spark.createDataFrame([("a", 4, "threshold", 0.5, 16), ("b", 4, "window_size", 3.0, 16)], "method string, target long, parameter_type string, parameter double, cap int")
    assert L.artifact_violations(good, ["a", "b"], [4], 16).count() == 0
    bad = good.selectExpr("method", "target", "parameter_type", "parameter + 0.7 AS parameter", "cap")
    assert {r.rule for r in L.artifact_violations(bad, ["a", "b", "c"], [4], 16).collect()} == {"bad_threshold", "bad_window", "not_exactly_once"}


def test_samples(spark):
    rows = spark.createDataFrame([("g", i, (i % 101) / 100) for i in range(500)], "g string, id int, t double")
    out = T.bin_balanced(rows, 84, "t", "id", "g").collect()
    assert len(out) == 84 and len({r.id for r in out}) == 84 and len({r.target_bin for r in out}) >= 20
    assert T.hashed_sample(rows, 7, "id", "g").count() == 7 and T.hashed_sample(rows, 0, "id", "g").count() == 0
    weights = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "k string, weight double")
    assert sorted((r.k, r.allocation) for r in T.largest_remainder(weights, 10, "k").collect()) == [("a", 4), ("b", 3), ("c", 3)]


def test_window_size_rounds_half_to_even_and_takes_fractions():
    from plurality.operators.stopping import window_size

    assert [window_size(v, 32) for v in (2.5, 3.5, 40, 1, 0.5, 0.02, 1.6)] == [2, 4, 32, 32, 16, 2, 2]
