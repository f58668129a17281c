"""Reports of several models: only missing ones are made, from their own partitions."""

from pyspark.sql import functions as F

from plurality.operators import evaluation as E
from plurality.operators import reaggregation as R

SETTINGS = E.Settings(budgets=(1, 16), thresholds=(0.0, 0.5, 1.0), targets=(4,), cap=8)


def samples(model, n):
    return [(model, "d", f"q{q}", i, "AB"[(i * (q + 1)) % 3 == 0], float(i % 10) / 10) for q in range(n) for i in range(16)]


def test_missing_reports_only(spark, tmp_path):
    spec = "model string, dataset_name string, question_id string, pos long, answer string, confidence double"
    pools, out = str(tmp_path / "pools"), str(tmp_path / "out")
    expected = spark.createDataFrame([("d", f"q{q}", "A") for q in range(5)], "dataset_name string, question_id string, gold string")
    spark.createDataFrame(samples("m1", 5) + samples("m2", 4), spec).write.partitionBy(*R.PARTS).parquet(pools)
    assert [x["model"] for x in R.reaggregate(spark, pools, expected, out, SETTINGS)] == ["m1", "m2"]
    spark.createDataFrame(samples("m3", 3), spec).write.partitionBy(*R.PARTS).mode("append").parquet(pools)
    assert [x["model"] for x in R.reaggregate(spark, pools, expected, out, SETTINGS)] == ["m3"]
    assert R.reaggregate(spark, pools, expected, out, SETTINGS) == []
    seen = {r.model: (r.questions_total, r.questions_observed) for r in spark.read.parquet(out).where("method = 'SC' AND budget = 16").collect()}
    assert seen == {"m1": (5, 5), "m2": (5, 4), "m3": (5, 3)}
    one = spark.read.parquet(pools).where("model = 'm2'").drop("model", "dataset_name")
    alone = E.evaluate(one, expected.drop("dataset_name"), SETTINGS)
    both = spark.read.parquet(out).where("model = 'm2'").select(*E.COLUMNS)
    assert sorted(map(str, alone.collect())) == sorted(map(str, both.collect()))
    plan = spark.read.parquet(pools).where(R.of_parts([{"model": "m2", "dataset_name": "d"}]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "m2" in plan.split("PartitionFilters")[1]


def test_gaps_in_positions_and_empty_pools(spark):
    pool = spark.createDataFrame([("q0", p, "A", 0.5) for p in (3, 7, 20)], "question_id string, pos long, answer string, confidence double")
    expected = spark.createDataFrame([("q0", "A"), ("q1", "B")], "question_id string, gold string")
    rows = {(r.method, r.budget): r for r in E.evaluate(pool, expected, SETTINGS, row_types=["fixed_budget"]).collect()}
    assert rows["SC", 1].correct == 1 and rows["SC", 16].insufficient_sample_questions == 2 and rows["SC", 16].generated_samples == 3
    nothing = E.evaluate(pool.where(F.lit(False)), expected, SETTINGS, row_types=["fixed_budget"]).collect()
    assert len(nothing) == 10 and all(r.correct == 0 and r.questions_total == 2 and r.invalid_predictions == 2 for r in nothing)
