"""Comparisons of two ways to decide: disagreement, relation diagnostics, weight sweeps."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions.arrays import let
from plurality.operators import profiles


def observations(shares: DataFrame, score: str, gold: DataFrame) -> DataFrame:
    """``question_id, predicted, score, correct``: first-seen winner of each question."""
    best = F.max(F.struct("mass", -F.col("first_pos"), "answer", F.col(score).alias("score"))).alias("b")
    winners = shares.where(F.col(score).isNotNull()).groupBy("question_id").agg(best)
    rows = winners.select("question_id", F.col("b.answer").alias("predicted"), F.col("b.score").alias("score"))
    return rows.join(gold, "question_id").select("question_id", "predicted", "score", (F.col("predicted") == F.col("gold")).cast("int").alias("correct"))


def total_variation(left: DataFrame, right: DataFrame, left_score: str, right_score: str) -> DataFrame:
    """Half the summed difference of two answer distributions, per question in both."""
    a = left.where(F.col(left_score).isNotNull()).select("question_id", "answer", F.col(left_score).alias("p"))
    b = right.where(F.col(right_score).isNotNull()).select("question_id", "answer", F.col(right_score).alias("q"))
    joined = a.join(b, ["question_id", "answer"], "full")
    both = joined.groupBy("question_id").agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2).alias("tv"), F.count("p").alias("_a"), F.count("q").alias("_b"))
    return both.where("_a > 0 AND _b > 0").select("question_id", "tv")


def disagreement(ref: DataFrame, target: DataFrame, tv: DataFrame) -> DataFrame:
    """One row per question of both: outcome, winner change, shift, Brier difference."""
    a = ref.select("question_id", *[F.col(c).alias(f"ref_{c}") for c in ("predicted", "score", "correct")])
    rows = a.join(target, "question_id").join(tv, "question_id")
    ref_right, right = F.col("ref_correct") == 1, F.col("correct") == 1
    outcome = F.when(ref_right & right, "both_correct").when(ref_right, "reference_only").when(right, "target_only").otherwise("both_wrong")
    square = lambda s, c: (F.col(s) - F.col(c)) * (F.col(s) - F.col(c))
    return rows.select(
        "question_id", "tv", outcome.alias("outcome"), (F.col("ref_predicted") != F.col("predicted")).alias("changed"), (F.col("score") - F.col("ref_score")).alias("shift"), (square("score", "correct") - square("ref_score", "ref_correct")).alias("brier_delta"), "correct", "ref_correct"
    )


def tv_bin(tv: Column) -> Column:
    return F.when(tv <= 1e-12, "0").when(tv <= 0.02, "(0,0.02]").when(tv <= 0.05, "(0.02,0.05]").when(tv <= 0.10, "(0.05,0.10]").when(tv <= 0.20, "(0.10,0.20]").otherwise(">0.20")


def disagreement_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("changed").cast("int")).alias("changed_rate"), F.avg("tv").alias("mean_tv"), F.median("tv").alias("median_tv"), F.avg(F.abs("shift")).alias("mean_shift"),
        (100 * F.avg(F.col("correct") - F.col("ref_correct"))).alias("accuracy_delta"), (100 * F.avg("brier_delta")).alias("brier_delta"), F.count_if(F.col("outcome") == "reference_only").alias("reference_only"), F.count_if(F.col("outcome") == "target_only").alias("target_only"),
    )


def rate(part: Column, whole: Column) -> Column:
    """A quotient that is NaN over nothing."""
    return F.when(whole == 0, F.lit(float("nan"))).otherwise(part.cast("double") / whole)


def relation_diagnostics(identity: DataFrame, relation: DataFrame, by: list[str]) -> DataFrame:
    """What a relation does to right and wrong answers of the identity, per group.

    Both are observations; ``relation`` also has the ``by`` columns.
    """
    a = identity.select("question_id", F.col("predicted").alias("own"), (F.col("correct") == 1).alias("right"))
    rows = relation.join(a, "question_id").withColumn("good", F.col("correct") == 1).withColumn("same", F.col("predicted") == F.col("own"))
    n, right, wrong = F.count("*"), F.count_if("right"), F.count_if(~F.col("right"))
    return rows.groupBy(*by).agg(
        n.alias("questions"), rate(F.count_if("good"), n).alias("accuracy"), rate(F.count_if(F.col("right") & F.col("good")), right).alias("preserved"), rate(F.count_if(F.col("right") & ~F.col("good")), right).alias("harmed"),
        rate(F.count_if(~F.col("right") & F.col("good")), wrong).alias("repaired"), rate(F.count_if(~F.col("right") & ~F.col("same")), wrong).alias("broken"), rate(F.count_if(~F.col("right") & F.col("same")), wrong).alias("same_wrong"), rate(F.count_if("same"), n).alias("agreement"),
    )


def weight_sweep(pool: DataFrame, gold: DataFrame, grids: dict[str, list[float]], subtype: str = "view") -> DataFrame:
    """Observations for each combination of subtype weights: ``question_id, w_*, predicted,
    score, correct``.

    Masses are summed per question, answer and subtype once and stand in one row a question;
    all combinations are weighed in that row. ``grids``: weights of each subtype, 0 to 9.
    """
    names = sorted(grids)
    valid = pool.where("answer IS NOT NULL AND confidence IS NOT NULL")
    masses = valid.groupBy("question_id", "answer", subtype).agg(F.sum("confidence").cast("double").alias("m"), F.min("pos").alias("first"))
    own = F.array(*(F.coalesce(F.sum(F.when(F.col(subtype).cast("string") == n, F.col("m"))), F.lit(0.0)) for n in names))
    sums = masses.groupBy("question_id", "answer").agg((-F.min("first")).alias("f"), own.alias("m"))
    rows = sums.groupBy("question_id").agg(F.collect_list(F.struct("f", "answer", "m")).alias("answers"))
    configs = F.array(*(F.array(*(F.lit(float(w)) for w in c)) for c in itertools.product(*(grids[n] for n in names))))

    def weighed(config: Column) -> Column:
        mass = lambda a: F.round(F.aggregate(F.zip_with(a["m"], config, lambda m, w: m * w), F.lit(0.0), lambda acc, x: acc + x), 9)
        votes = F.transform("answers", lambda a: F.struct(mass(a).alias("mass"), a["f"].alias("f"), a["answer"].alias("answer")))
        total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x["mass"])
        return let(votes, lambda v: F.struct(config.alias("w"), F.array_max(v).alias("b"), total(v).alias("total")))

    each = rows.join(gold, "question_id").select("question_id", "gold", F.explode(F.filter(F.transform(configs, weighed), lambda x: x["total"] > 0)).alias("x"))
    weights = [F.get("x.w", F.lit(i)).alias(f"w_{n}") for i, n in enumerate(names)]
    return each.select("question_id", *weights, F.col("x.b.answer").alias("predicted"), (F.col("x.b.mass") / F.col("x.total")).alias("score"), (F.col("x.b.answer") == F.col("gold")).cast("int").alias("correct"))


def best_weights(sweep: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` combinations with the lowest calibration error (bins by the score's product),
    then the highest accuracy, then the smallest weights: ``w_*, n, ece, accuracy``."""
    names = [c for c in sweep.columns if c.startswith("w_")]
    rows = profiles.metric_rows(sweep, names).select(*names, "n", F.round("ece_strict", 9).alias("ece"), F.round("accuracy", 9).alias("accuracy"))
    return rows.orderBy("ece", F.desc("accuracy"), *names).limit(k)


def micro_average(rows: DataFrame, by: list[str]) -> DataFrame:
    """Sums over data sets first, ratios after."""
    return rows.groupBy(*by).agg(F.sum("questions").alias("questions"), F.sum("correct").alias("correct"), F.sum("used").alias("used")).withColumn("accuracy", F.col("correct") / F.col("questions")).withColumn("average_used", F.col("used") / F.col("questions"))
