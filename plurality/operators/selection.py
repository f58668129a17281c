"""Parameter choice on one split, its artifact, and checks before use on another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def match_budgets(curve: DataFrame, targets: list[int], by: list[str] | None = None, analysis: bool = False) -> DataFrame:
    """For each target the parameter whose average use comes nearest from below.

    Of several with the same gap the smallest parameter; accuracy is no key. With
    ``analysis`` the nearest on either side. A target no parameter can meet has no row:
    ``unmet_targets`` lists those.
    """
    by = by or []
    wanted = curve.withColumn("target", F.explode(F.array(*[F.lit(t).cast("long") for t in targets])))
    average = F.col("used") / F.col("questions")
    gap = F.col("target") - average
    rows = wanted.withColumn("average_used", average).withColumn("gap", F.abs(gap) if analysis else gap)
    if not analysis:
        rows = rows.where(F.col("average_used") <= F.col("target") + 1e-12)
    # curves are as long as the parameter grid
    order = Window.partitionBy("target", *by).orderBy("gap", "parameter")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "gap")


def unmet_targets(curve: DataFrame, targets: list[int], by: list[str] | None = None) -> DataFrame:
    """Targets below every average, with the smallest average there is."""
    by = by or []
    least = curve.groupBy(*by).agg(F.min(F.col("used") / F.col("questions")).alias("least"))
    wanted = least.withColumn("target", F.explode(F.array(*[F.lit(t).cast("long") for t in targets])))
    return wanted.where(F.col("least") > F.col("target") + 1e-12)


def artifact_violations(artifact: DataFrame, methods: list[str], targets: list[int], cap: int) -> DataFrame:
    """``rule, method, target`` for what breaks an artifact: every method and target once,
    a threshold in [0, 1] or a whole window size from 2 to the cap, and the stated cap."""
    spark = artifact.sparkSession
    wanted = spark.createDataFrame([(m, t) for m in methods for t in targets], "method string, target long")
    counts = artifact.groupBy("method", "target").agg(F.count("*").alias("n"))
    number = wanted.join(counts, ["method", "target"], "full").where(F.coalesce("n", F.lit(0)) != 1)
    unknown = F.array_contains(F.array(*map(F.lit, methods)), F.col("method"))
    p = F.col("parameter")
    window = F.col("parameter_type") == "window_size"
    bad = F.when(~unknown, "unknown_method").when(window & ~((p >= 2) & (p <= cap) & (p == F.floor(p))), "bad_window").when(~window & ~((p >= 0) & (p <= 1)), "bad_threshold").when(F.col("cap") != cap, "other_cap")
    rows = artifact.withColumn("rule", bad).where("rule IS NOT NULL").select("rule", "method", "target")
    return rows.unionByName(number.select(F.lit("not_exactly_once").alias("rule"), "method", "target"))
