"""Operators that no registered query shows, on rows written by hand."""

import pytest
from pyspark.sql import functions as F

from plurality.functions import answers, hashing
from plurality.operators import evaluation, matching, profiles, records, sampling


def test_loose_option(spark):
    texts = ["the answer is (b)", "Option: C, no choice d", "answer", None, "answer is Apple", "choice e."]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in rows.select(answers.loose_option(F.col("t"))).collect()] == ["B", "D", None, None, None, "E"]


def test_best_profiles_and_candidate_order(spark):
    rows = [("p1", "relation", 3.0, 1.0, 50.0), ("p2", "relation", -1.0, 2.0, 50.0), ("p3", "relation", -1.0, 1.0, 50.0), ("p4", "weighting", -9.0, 0.0, 0.0), ("p5", "relation", -1.0, 1.0, 60.0)]
    found = profiles.best_profiles(spark.createDataFrame(rows, "profile string, effect string, ece_paper double, brier double, accuracy double"), 3)
    assert [r.profile for r in found.collect()] == ["p5", "p3", "p2"]
    order = records.candidate_order(spark.createDataFrame([("b", 2, "x"), ("a", 10, "y"), ("a", 9, "z"), ("a", 10, "a")], "dataset_name string, source_index int, question_id string"))
    assert [r.question_id for r in order.collect()] == ["a", "y", "z", "x"]


def test_hybrid_target(spark):
    rows = spark.createDataFrame([(0.5, 0.25)], "ssc double, relssc double")
    of = lambda mode, value: rows.select(sampling.hybrid_target(mode, F.col("ssc"), value, F.lit(1.0)).alias("t")).first().t
    assert of("hybrid", F.col("relssc")) == 0.25 and of("ssc", F.col("relssc")) == 0.5 and of("residual", F.col("relssc")) == 0.375
    with pytest.raises(Exception, match="hybrid target"):
        of("hybrid", F.lit(1.5))


def test_scope_violations(spark):
    settings = evaluation.Settings(budgets=(1, 16), targets=(8,))
    rows = [("m", "d", method, 8, "window_size" if method == "ESC" else "confidence_threshold", 4.0 if method == "ESC" else 0.5, 32, 2, 5) for method in evaluation.DYNAMIC]
    spec = "model_id string, dataset_name string, method string, budget_target long, parameter_type string, parameter double, cap long, min_valid long, buffer_size long"
    good = spark.createDataFrame(rows, spec)
    assert evaluation.scope_violations(good, settings, "m", "d").count() == 0
    assert {r.rule for r in evaluation.scope_violations(good, settings, "m", "other").collect()} == {"other_dataset"}
    assert {r.rule for r in evaluation.scope_violations(good.where("method <> 'ASC'").withColumn("cap", F.lit(16).cast("long")), settings, "m", "d").collect()} >= {"other_cap", "not_exactly_once"}


def test_partition_rows(spark):
    rows = spark.createDataFrame([(f"q{i}", "d", "old") for i in range(100)], "question_id string, dataset_name string, split string")
    parts = {role: hashing.partition_rows(rows, role, "n", 1, 0.3).collect() for role in ("validation", "test")}
    assert {r.question_id for part in parts.values() for r in part} == {f"q{i}" for i in range(100)} and 10 < len(parts["validation"]) < 50
    assert all(r.split == role and r.source_split == "old" for role, part in parts.items() for r in part)
    with pytest.raises(ValueError, match="validation or test"):
        hashing.partition_rows(rows, "train", "n", 1, 0.3)
    with pytest.raises(Exception, match="no question id"):
        hashing.partition_rows(rows.withColumn("question_id", F.lit("")), "test", "n", 1, 0.3).collect()


def test_wrong_consensus_ties_and_states(spark):
    spec = "question_id long, answer string, mass double, first_pos long, ssc double"
    own = spark.createDataFrame([(q, "W", 1.0, 0, 0.8) for q in range(1, 6)], spec)
    gold = spark.createDataFrame([(q, "G") for q in range(1, 6)], "question_id long, gold string")
    relations = [(1, "W", 0.9), (1, "G", 0.1), (2, "W", 0.5), (2, "G", 0.5), (3, "W", 0.2), (3, "G", 0.8), (4, "W", None)]
    got = {r.question_id: r for r in matching.wrong_consensus(own, spark.createDataFrame(relations, "question_id long, answer string, relsc double"), gold, 0.5).collect()}
    shown = lambda r: (r.status, r.broken, r.displaced, r.corrected)
    assert {q: shown(r) for q, r in got.items()} == {
        1: ("evaluated", False, False, False), 2: ("evaluated", True, False, True), 3: ("evaluated", True, True, True), 4: ("undefined", None, None, None), 5: ("unmatched", None, None, None),
    }
    total = matching.consensus_summary(spark.createDataFrame(list(got.values()), "question_id long, wrong string, gold string, ssc double, status string, relsc double, drop double, relative_drop double, broken boolean, displaced boolean, corrected boolean")).first()
    assert (total.candidates, total.evaluated, total.unmatched, total.undefined, total.broken_count, total.displaced_count) == (5, 3, 1, 1, 2, 1)
    assert abs(total.relative_drop_of_means - (0.8 - 1.6 / 3) / 0.8) < 1e-12
