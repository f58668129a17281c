"""Votes of a fixed number of samples, with first-seen ties and strict denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budgets(pool: DataFrame, budgets: list[int]) -> DataFrame:
    """Each row once for every budget that its position lies in, with the pool's size."""
    sized = pool.withColumn("size", F.count("*").over(Window.partitionBy("question_id")))
    return sized.withColumn("budget", F.explode(F.array(*[F.lit(b).cast("long") for b in sorted(set(budgets))]))).where("pos < budget")


def _outcomes(best: DataFrame) -> DataFrame:
    """Too few samples: no prediction, all of them used. No winner: no valid answer."""
    enough = F.col("size") >= F.col("budget")
    status = F.when(~enough, "insufficient_samples").when(F.col("winner").isNull(), "no_valid_answer").otherwise("ok")
    return best.select("question_id", "budget", F.when(enough, F.col("winner")).alias("prediction"), F.least("size", "budget").alias("used"), status.alias("status"))


def _largest(rows: DataFrame, weight: Column) -> DataFrame:
    """The answer of the largest sum of ``weight``; rows that do not vote tell the size only,
    so that votes and frame are one pass over one partitioning by question."""
    w = F.when(F.col("answer").isNotNull(), weight)
    sums = rows.withColumn("_w", w).groupBy("question_id", "budget", "answer").agg(F.max("size").alias("size"), F.sum("_w").alias("w"), F.min(F.when(F.col("_w").isNotNull(), F.col("pos"))).alias("first"))
    vote = F.when(F.col("w").isNotNull(), F.struct("w", -F.col("first"), "answer"))
    return _outcomes(sums.groupBy("question_id", "budget").agg(F.max("size").alias("size"), F.max(vote)["answer"].alias("winner")))


def sum_vote(pool: DataFrame, budgets: list[int], weight: Column) -> DataFrame:
    """The answer of the largest summed weight (negative ones count); first seen wins ties.

    ``weight`` should be integral or decimal, so that no sum depends on row order.
    """
    return _largest(within_budgets(pool, budgets), weight)


def majority(pool: DataFrame, budgets: list[int]) -> DataFrame:
    return sum_vote(pool, budgets, F.lit(1))


def best_sample(pool: DataFrame, budgets: list[int], score: Column) -> DataFrame:
    """The answer of the row with the largest score; the first row wins ties."""
    rows = within_budgets(pool, budgets)
    vote = F.when(F.col("answer").isNotNull() & score.isNotNull(), F.struct(score.alias("s"), -F.col("pos"), "answer"))
    return _outcomes(rows.groupBy("question_id", "budget").agg(F.max("size").alias("size"), F.max(vote)["answer"].alias("winner")))


def informed_vote(pool: DataFrame, budgets: list[int], score: Column, temperature: float = 1.0, scale: str = "softmax") -> DataFrame:
    """Scores turned to weights within the prefix: ``softmax``, ``linear`` or ``none``.

    Weights keep 12 decimals, so equal votes stay equal whatever the order of rows.
    """
    if not temperature > 0:
        raise ValueError("the temperature must be positive")
    rows = within_budgets(pool, budgets).withColumn("score", F.when(F.col("answer").isNotNull(), score.cast("double")))
    prefix = Window.partitionBy("question_id", "budget")
    if scale == "softmax":
        weight = F.exp((F.col("score") - F.max("score").over(prefix)) / temperature)
    elif scale == "linear":
        weight = (F.col("score") - F.min("score").over(prefix)) * temperature + 1
    elif scale == "none":
        weight = F.col("score")
    else:
        raise ValueError(f"unknown scale {scale!r}")
    return _largest(rows.withColumn("weight", F.round(weight, 12).cast("decimal(20,12)")), F.col("weight"))


def strict_score(predictions: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy over all expected questions: missing and invalid ones count as wrong."""
    groups = predictions.select(*by).distinct()
    frame = expected.crossJoin(F.broadcast(groups)) if by else expected
    joined = frame.join(predictions, ["question_id", *by], "left")
    right = F.coalesce(F.col("prediction") == F.col("gold"), F.lit(False))
    n = F.count("*")
    out = joined.groupBy(*by).agg(
        n.alias("questions"), F.count_if(right).alias("correct"), F.count_if(F.col("prediction").isNotNull()).alias("valid"), F.sum(F.coalesce("used", F.lit(0))).alias("used"), F.count_if(F.col("status") == "insufficient_samples").alias("insufficient")
    )
    return out.withColumn("accuracy", F.col("correct") / F.col("questions")).withColumn("average_used", F.col("used") / F.col("questions"))
