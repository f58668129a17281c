"""Listings, checks of records, safe writes, and the whole evaluation's edges."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plurality.functions import views as V
from plurality.operators import evaluation as E
from plurality.operators import metrics as X
from plurality.sources import artifacts as A
from plurality.sources import converters as C
from plurality.sources import readers as R
from plurality.sources import sinks as K

SCHEMA = "question_id string, samples array<struct<s:int>>"


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def names(paths, root):
    return [p.split(str(root), 1)[1] for p in paths]


def test_question_discovery(spark, tmp_path):
    put(tmp_path / "d/a.json", {"question_id": "a", "samples": [{"s": 1}]})
    put(tmp_path / "d/sub/b.json", {"question_id": "b", "samples": []})
    put(tmp_path / "d/x_metadata.json", {"question_id": "m", "samples": []})
    put(tmp_path / "d/bad.json", "{not json")
    put(tmp_path / "d/other.json", {"k": 1})
    assert sorted(r.question_id for r in A.question_table(spark, str(tmp_path / "d"), SCHEMA).collect()) == ["a", "b"]
    assert names(A.raw_question_files(spark, str(tmp_path / "d")), tmp_path / "d") == ["/a.json", "/bad.json", "/other.json", "/sub/b.json"]
    put(tmp_path / "d/q/questions/c.json", {"question_id": "a", "samples": [{"s": 1}]})
    assert names(A.raw_question_files(spark, str(tmp_path / "d")), tmp_path / "d") == ["/q/questions/c.json"]
    with pytest.raises(ValueError, match="'a' stands in 2 files"):
        A.question_table(spark, str(tmp_path / "d"), SCHEMA)
    with pytest.raises(FileNotFoundError):
        A.question_table(spark, str(tmp_path / "none"), SCHEMA)
    put(tmp_path / "s/set/train.jsonl", '{"question_id": "t"}\n')
    assert A.split_table(spark, str(tmp_path / "s"), "set", "train", SCHEMA).count() == 1
    with pytest.raises(FileNotFoundError):
        A.split_table(spark, str(tmp_path / "s"), "set", "test", SCHEMA)


def test_response_and_confidence_sources(spark, tmp_path):
    put(tmp_path / "one/responses.jsonl", "")
    put(tmp_path / "one/chunks/chunk-0.jsonl", "")
    assert names(A.response_sources(spark, str(tmp_path / "one")), tmp_path) == ["/one/chunks/chunk-0.jsonl"]
    for i, file in enumerate(["chunks/chunk-1.jsonl", "responses.jsonl"]):
        put(tmp_path / f"many/shard{i}/response_metadata.json", "{}")
        put(tmp_path / f"many/shard{i}/{file}", "")
    assert names(A.response_sources(spark, str(tmp_path / "many")), tmp_path) == ["/many/shard0/chunks/chunk-1.jsonl", "/many/shard1/responses.jsonl"]
    put(tmp_path / "plain/x/responses.jsonl", "")
    assert len(A.response_sources(spark, str(tmp_path / "plain"))) == 1
    put(tmp_path / "c/a/confidence.jsonl", "")
    put(tmp_path / "c/b/confidence.jsonl", "")
    assert names(A.confidence_sources(spark, [str(tmp_path / "c"), str(tmp_path / "c")]), tmp_path) == ["/c/a/confidence.jsonl", "/c/b/confidence.jsonl"]
    put(tmp_path / "part/chunks/chunk-0.jsonl", "")
    with pytest.raises(ValueError, match="partial report"):
        A.confidence_sources(spark, [str(tmp_path / "part")])
    with pytest.raises(FileNotFoundError):
        A.confidence_sources(spark, [str(tmp_path / "s0")])


def test_writes_keep_what_was_there(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a")], "k int, t string")
    K.write_lines(rows, path)
    with pytest.raises(Exception, match="boom"):
        K.write_lines(rows.withColumn("k", F.raise_error(F.lit("boom"))), path)
    assert [tuple(r) for r in spark.read.json(path).select("k", "t").collect()] == [(1, "a")]
    K.write_lines(rows.withColumn("k", F.lit(2)), path)
    assert spark.read.json(path).first().k == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    K.write_report(rows, ["t", "none", "k"], str(tmp_path / "r"), "Title")
    assert spark.read.option("header", True).csv(str(tmp_path / "r/rows.csv")).columns == ["t", "none", "k"]
    assert (tmp_path / "r/report.md").read_text() == "# Title\n\n| t | k |\n| --- | --- |\n| a | 1 |\n"
    K.write_manifest(spark, str(tmp_path / "m.json"), "responses", {"samples": 3})
    assert A.record(spark, str(tmp_path / "m.json")) == {"schema_version": 1, "artifact_type": "responses", "samples": 3}
    put(tmp_path / "out/settings.json", {"a": 1})
    assert not A.may_resume(spark, str(tmp_path / "out"), {"a": 1}) and not A.may_resume(spark, path, {})
    put(tmp_path / "out/_SUCCESS", "")
    assert A.may_resume(spark, str(tmp_path / "out"), {"a": 1})
    with pytest.raises(ValueError, match="a"):
        A.may_resume(spark, str(tmp_path / "out"), {"a": 2})


def test_merged_chunks(spark):
    rows = spark.createDataFrame([(0, "q1", "s1", 0), (0, "q2", "s2", 1), (1, "q2", "s3", 2)], "chunk int, q string, s string, o int")
    _, total = K.merged_chunks(rows, "q", "s", "chunk", "o")
    a, b = total.first(), K.merged_chunks(rows.orderBy(F.desc("o")), "q", "s", "chunk", "o")[1].first()
    assert (a.questions, a.samples, a.chunks) == (2, 3, 2) and a == b
    assert K.merged_chunks(rows.withColumn("o", -F.col("o")), "q", "s", "chunk", "o")[1].first().digest != a.digest


def test_no_row_is_lost(spark, tmp_path):
    questions = spark.createDataFrame([("a", [1, 2]), ("b", []), ("c", None)], "question_id string, xs array<int>").withColumn("samples", F.transform("xs", lambda x: F.struct(x.alias("s")))).drop("xs")
    assert sorted((r.question_id, r.row_index) for r in R.samples(questions, strict=False).collect() if r.row_index is not None) == [("a", 0), ("a", 1)]
    assert sorted(r.question_id for r in R.samples(questions, strict=False).collect() if r.row_index is None) == ["b", "c"]
    with pytest.raises(Exception, match="no samples"):
        R.samples(questions).collect()
    for i, text in enumerate(["{bad", '{"k": "x"']):
        put(tmp_path / f"b{i}.json", text)
        with pytest.raises(Exception, match="(?i)malformed"):
            R.polymorphic(spark, str(tmp_path / f"b{i}.json"), "k:int").collect()
    old = A.legacy_rows(spark, _file(tmp_path), {"method": ["name", "method"], "ece": ["ece_paper", "ece"]}, "name:string,method:string,ece:double")
    assert [(r.method, r.ece) for r in old.collect()] == [("m", 0.5)]


def _file(tmp_path):
    put(tmp_path / "old.json", {"results": [{"method": "m", "ece": 0.5}]})
    return str(tmp_path / "old.json")


@pytest.mark.parametrize("n", [0, 1, 2, 6, 8, 20])
def test_views_of_any_number_of_options(spark, n):
    rows = spark.createDataFrame([(q, [str(i) for i in range(n)]) for q in range(40)], "question_id long, options array<string>")
    got = V.option_views(rows, 5, 1).select("*", V.permuted(F.col("options"), F.col("sources")).alias("shown")).collect()
    want = {0: 1, 1: 1, 2: 2}.get(n, 5)
    assert len(got) == 40 * want
    for r in got:
        assert sorted(r.sources) == list(range(n)) and (r.view_index > 0 or r.sources == list(range(n))) and sorted(r.shown) == sorted(r.options)
    assert len({(r.question_id, tuple(r.sources)) for r in got}) == len(got)
    if 0 < n < 3:
        with pytest.raises(Exception, match="fewer orders"):
            V.option_views(rows, 5, 1, strict=True).collect()
    if n == 6:
        every = V.option_views(rows.limit(1), 10_000, 1).collect()
        assert len({tuple(r.sources) for r in every}) == len(every) == 720
        with pytest.raises(Exception, match="too many"):
            V.option_views(rows.withColumn("options", F.array_repeat(F.lit("x"), 21)), 2, 1).collect()


def test_view_metadata_and_roll_up(spark):
    rows = spark.createDataFrame([("q", ["x", "y", "z"])], "question_id string, options array<string>")
    views = V.option_views(rows, 6, 3).select("*", V.view_metadata(F.col("sources")).alias("m")).select("question_id", "view_index", "sources", "m.forward", "m.inverse")
    assert V.direction_violations(views).count() == 0
    swapped = views.withColumn("f", F.col("inverse")).drop("forward").withColumnRenamed("f", "forward")
    assert {r.rule for r in V.direction_violations(swapped.where("sources = array(1, 2, 0)")).collect()} == {"wrong_forward"}
    assert {r.rule for r in V.direction_violations(views.withColumn("sources", F.array(F.lit(0), F.lit(0), F.lit(1)))).collect()} == {"not_an_order"}
    number = V.identity_views(rows.select("question_id"), 32).first()
    assert (number.view_index, number.relation_id, number.per_view, number.sources) == (0, "g0", 32, [])
    samples = spark.createDataFrame([("q", 1, 0, True), ("q", 0, 1, False), ("q", 0, 0, True)], "question_id string, view_index int, sample_index int, is_valid_answer boolean")
    rolled = V.rolled_up(samples).first()
    assert [(s.view_index, s.sample_index) for s in rolled.samples] == [(0, 0), (0, 1), (1, 0)] and (rolled.attempted_budget, rolled.valid_responses) == (3, 2)


def test_converters_report_failures(spark):
    rows = spark.createDataFrame([(0, "ctx", "q?", ["a", "b"], "B"), (1, "ctx", "q?", ["a", ""], "1"), (2, None, "q?", ["a", "b"], "7")], "source_index int, context string, query string, options array<string>, correct_option string")
    got = C.convert(rows, "logiqa", "test").orderBy("source_index").collect()
    assert [(r.correct_index, r.failure) for r in got] == [(1, None), (1, "empty option"), (7, "missing context")]
    assert got[0].stem == "Article:\nctx\n\nQuestion: q?" and got[0].correct_answer == "B"
    with pytest.raises(ValueError, match="2 rows not converted, first 1: empty option; 2: missing context"):
        C.accepted(C.convert(rows, "logiqa", "test"))
    assert C.accepted(C.convert(rows, "logiqa", "test", most=1)).count() == 1
    with pytest.raises(KeyError):
        C.convert(rows, "sciq", "test")
    with pytest.raises(ValueError):
        C.convert(rows, "unknown", "test")
    texts = spark.createDataFrame([("arc_easy", "3"), ("math_qa", "Answer: (b)"), ("gsm8k", "x #### 1,200"), ("sciq", "D")], "d string, t string")
    assert [r[0] for r in texts.select(C.gold_answer(F.col("d"), F.col("t"))).collect()] == ["C", "B", "1200", "D"]
    assert spark.range(1).select(C.stem_without_options(F.lit("Stem one\n(A) x\n  (B) y\n"))).first()[0] == "Stem one"


def test_settings_and_phases(spark):
    for wrong in ({"budgets": (1, 2)}, {"thresholds": (1.5,)}, {"cap": 0}, {"targets": (0,)}, {"window_sizes": (40,)}, {"temperature": 0.0}, {"scale": "x"}):
        with pytest.raises(ValueError):
            E.Settings(**wrong)
    settings = E.Settings(budgets=(1, 16), thresholds=(0.0, 0.5, 1.0), targets=(1, 4))
    assert settings.grid("ESC", 1) == [1.0] and settings.grid("ESC", 4) == [2.0, 3.0, 4.0] and settings.grid("ASC", 4) == [0.0, 0.5, 1.0]
    pool = spark.createDataFrame([("q1", i, "A" if i % 3 else None, 0.5 + i / 100) for i in range(16)], "question_id string, pos long, answer string, confidence double")
    expected = spark.createDataFrame([("q1", "A"), ("q2", "B"), ("q3", None)], "question_id string, gold string")
    report = E.evaluate(pool, expected, settings, "analysis").cache()
    assert report.columns == E.COLUMNS
    fixed = {(r.method, r.budget): r for r in report.where("row_type = 'fixed_budget'").collect()}
    one = fixed["SC", 16]
    assert (one.questions_total, one.questions_observed, one.correct, one.generated_samples, one.valid_samples, one.invalid_predictions, one.insufficient_sample_questions, one.invalid_gold_questions) == (3, 1, 1, 16, 10, 2, 2, 1)
    assert one.accuracy_percent == pytest.approx(100 / 3) and one.avg_samples_used_observed == 16
    assert fixed["SC", 1].correct == 0 and fixed["SC", 1].invalid_predictions == 3
    assert [r.method for r in E.by_method(report.where("row_type = 'fixed_budget' AND budget = 16")).collect()] == E.FIXED
    with pytest.raises(ValueError, match="artifact"):
        E.evaluate(pool, expected, settings, "test")
    with pytest.raises(ValueError):
        E.calibration_artifact(report.where("method <> 'ASC'"), settings, "m", "d")
    both = E.joined_reports(report.where("row_type = 'fixed_budget'"), report.where("row_type = 'fixed_budget' AND method <> 'SC'"), ["method", "budget"], ["accuracy"])
    assert both.where("accuracy_delta IS NULL").count() == 2 and both.where("accuracy_delta = 0").count() == 8


def test_hashed_bootstrap_has_calibration_errors(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"g": 1, "question_id": np.arange(200), "ref_score": rng.random(200), "ref_correct": rng.integers(0, 2, 200), "score": rng.random(200), "correct": rng.integers(0, 2, 200)})
    pairs = spark.createDataFrame(frame)
    for metric in ("ece_paper", "ece_strict"):
        h, e = X.hashed_bootstrap(pairs, ["g"], metric, 300).first(), X.paired_bootstrap(pairs, ["g"], metric, 300, 1).first()
        assert abs(h.low - e.low) < 4 and abs(h.high - e.high) < 4 and abs(h.p_improve - e.p_improve) < 0.2
