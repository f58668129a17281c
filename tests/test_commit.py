"""Published versions: readers see a whole one, whatever step a write stops at."""

import json

import pytest
from pyspark.sql import functions as F

from plurality.operators import evaluation
from plurality.sources import sinks


def table(spark, shift=0):
    return spark.range(40).select(F.floor(F.col("id") / 10).alias("chunk"), "id", (F.col("id") + F.when(F.col("id") >= 30, shift).otherwise(0)).alias("x"), F.lit(None).cast("string").alias("n"))


@pytest.mark.parametrize("step", ["rows", "chunks", "pointer"])
def test_a_stopped_write_changes_nothing(spark, tmp_path, monkeypatch, step):
    root = str(tmp_path / "t")
    assert sinks.published(spark, root) is None
    first = sinks.publish(table(spark), root, "chunk", "id")
    assert first["rows"] == 40 and first["chunks"] == 4
    broken = table(spark, 1)
    if step == "rows":
        broken = broken.withColumn("x", F.when(F.col("id") == 35, F.raise_error(F.lit("stopped")).cast("long")).otherwise(F.col("x")))
    elif step == "chunks":
        monkeypatch.setattr(sinks, "_chunk_digests", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    else:
        monkeypatch.setattr(sinks, "write_text", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        sinks.publish(broken, root, "chunk", "id")
    monkeypatch.undo()
    rows, chunks = sinks.published(spark, root)
    assert rows.agg(F.sum("x")).first()[0] == sum(range(40)) and chunks.count() == 4
    # a resume looks at digests, and only one chunk is another
    assert [r.chunk for r in sinks.changed_chunks(chunks, table(spark, 1), "chunk", "id").collect()] == [3]
    assert sinks.changed_chunks(chunks, table(spark), "chunk", "id").count() == 0
    second = sinks.publish(table(spark, 1), root, "chunk", "id")
    assert second["digest"] != first["digest"] and sinks.publish(table(spark), root, "chunk", "id")["digest"] == first["digest"]


def test_records_are_renamed_into_place(spark, tmp_path):
    path = str(tmp_path / "m.json")
    sinks.write_manifest(spark, path, "pool", {"rows": 1})
    sinks.write_manifest(spark, path, "pool", {"rows": 2})
    assert json.loads((tmp_path / "m.json").read_text())["rows"] == 2
    assert sinks.check_metadata(spark, str(tmp_path / "c.json"), {"a": 1}) and not sinks.check_metadata(spark, str(tmp_path / "c.json"), {"a": 1})
    assert not [x for x in tmp_path.iterdir() if "staging" in x.name or "before" in x.name]


def test_comparison_in_three_forms(spark, tmp_path):
    pool = spark.createDataFrame([("q", i, "AB"[i % 3 == 0], 0.5) for i in range(16)], "question_id string, pos long, answer string, confidence double")
    right = spark.createDataFrame([("q", "A")], "question_id string, gold string")
    report = evaluation.evaluate(pool, right, evaluation.Settings(budgets=(1, 16)), row_types=["fixed_budget"]).cache()
    sinks.write_comparison(report, report, 16, ["method"], str(tmp_path / "c"), "Both")
    rows = spark.read.option("header", True).csv(str(tmp_path / "c" / "rows.csv")).collect()
    assert len(rows) == 5 and all(float(r.delta_accuracy) == 0 for r in rows)
    assert (tmp_path / "c" / "report.md").read_text().startswith("# Both") and (tmp_path / "c" / "rows.json").exists()
