import json

import pytest
from pyspark.sql import functions as F

from plurality.sources import readers as R
from plurality.sources import sinks as K
from plurality.streaming.leaders import leaders, windowed_votes


def test_json_scans(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"question_id": "q1", "answer": "A"}\n\n{"question_id": "q2"}\n')
    rows = R.json_lines(spark, str(tmp_path / "a.jsonl"), "question_id string, answer string")
    assert [(r.question_id, r.answer) for r in rows.orderBy("question_id").collect()] == [("q1", "A"), ("q2", None)]
    (tmp_path / "bad.jsonl").write_text('{"question_id": "q1"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        R.json_lines(spark, str(tmp_path / "bad.jsonl"), "question_id string").collect()
    assert R.json_lines(spark, str(tmp_path / "bad.jsonl"), "question_id string", strict=False).count() == 0
    for d in ("x", "y"):
        (tmp_path / d / "questions").mkdir(parents=True)
        (tmp_path / d / "questions" / "1.json").write_text(json.dumps({"question_id": d, "samples": [{"s": 1}, {"s": 2}]}))
    found = R.question_files(spark, str(tmp_path), "question_id string, samples array<struct<s:int>>", ["x", "y"])
    assert sorted((r.dataset, r.row_index, r.s) for r in R.samples(found).collect()) == [("x", 0, 1), ("x", 1, 2), ("y", 0, 1), ("y", 1, 2)]
    with pytest.raises(FileNotFoundError, match="'z'"):
        R.question_files(spark, str(tmp_path), "question_id string", ["x", "z"])
    for i, text in enumerate(['{"k": 1}', '[{"k": 2}, {"k": 3}]', '{"results": [{"k": 4}]}']):
        (tmp_path / f"p{i}.json").write_text(text)
    assert sorted(r.k for r in R.polymorphic(spark, [str(tmp_path / f"p{i}.json") for i in range(3)], "k:int").collect()) == [1, 2, 3, 4]


def test_row_helpers(spark):
    rows = spark.createDataFrame([(i, None if i == 3 else f"q{i % 2}") for i in range(4)], "i long, question_id string")
    assert [r.i for r in R.shard(rows, "i", 3, 1).collect()] == [1]
    assert [r[0] for r in rows.select(R.batch_of("i", 2)).collect()] == [0, 0, 1, 1]
    assert {(r.id, r.blank) for r in R.duplicate_questions(rows).collect()} == {("q0", False), (None, True)}
    assert R.conversion_failures(rows, {"no id": F.col("question_id").isNull(), "large": F.col("i") > 1}) == ["large", "no id"]
    frame = spark.createDataFrame([(None, "b")], "correct_answer string, gold_answer string")
    assert [frame.select(R.logical(frame, "gold", first)).first()[0] for first in (True, False)] == [None, "b"]
    assert frame.select(R.logical(frame, "relation_weight")).first()[0] == 1.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.123456, "a"), (2, None, None)], "k int, v double, t string").coalesce(1)
    K.write_csv(rows, str(tmp_path / "c"), ["k", "v", "none"], digits=4)
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).orderBy("k").collect()] == [("1", "0.1235", None), ("2", None, None)]
    K.write_lines(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 2 and K.source_signature(spark.read.json(str(tmp_path / "l"))).count() >= 1
    assert K.markdown(rows.orderBy("k"), ["k", "v"]) == "| k | v |\n| --- | --- |\n| 1 | 0.1235 |\n| 2 | - |\n"
    both = K.union_by_name([rows.select("k"), rows.select("t", "k")])
    assert both.columns == ["k", "t"] and both.count() == 4
    path = str(tmp_path / "m.json")
    assert K.check_metadata(spark, path, {"a": 1}) and not K.check_metadata(spark, path, {"a": 1})
    with pytest.raises(ValueError, match="a"):
        K.check_metadata(spark, path, {"a": 2})
    data = spark.createDataFrame([(0, "q2", 1, "x"), (0, "q1", 0, "x"), (0, "q1", 0, None), (1, "q3", 2, "x")], "chunk int, q string, o int, f string")
    import hashlib

    summary = {r.chunk: (r.questions, r.samples, r.digest) for r in K.chunk_summary(data, "chunk", "q", "o").collect()}
    assert summary[0] == (2, 3, hashlib.sha256(b"q1\0q2\0").hexdigest())
    expected = spark.createDataFrame([(0, summary[0][2]), (1, "other"), (2, "gone")], "chunk int, digest string")
    assert {r.chunk for r in K.incomplete_chunks(data, "chunk", "q", "o", expected, ["f"]).collect()} == {0, 1, 2}
    assert K.number(float("nan")) == "-" and K.number(0.5, 1, True) == "50.0%"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id AS question_id", "ts", "event_type AS answer")
    want = {tuple(r) for r in leaders(windowed_votes(events)).collect()}
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = windowed_votes(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("votes").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in leaders(spark.table("votes")).collect()} == want
