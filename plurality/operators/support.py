"""Support of each answer, targets, fragility: weighted shares per question.

All take a pool with ``question_id, pos, answer`` and the named weight columns. Each keeps
its work on one partitioning by question. A row without answer, or with a null weight, is
invalid: it adds nothing, and gets no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_question():
    return Window.partitionBy("question_id")


def double(value: Column) -> Column:
    return value.cast("double")


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(double(part), double(whole))


def answer_shares(pool: DataFrame, weight: Column, score: str) -> DataFrame:
    """``question_id, answer, mass, total, score``: each answer's part of the weights.

    A question whose total is zero is undefined: its score is null, not zero.
    """
    valid = pool.where(F.col("answer").isNotNull() & weight.isNotNull())
    masses = valid.groupBy("question_id", "answer").agg(F.sum(weight).alias("mass"), F.min("pos").alias("first_pos"))
    total = F.sum("mass").over(per_question())
    return masses.select("question_id", "answer", "mass", total.alias("total"), F.when(total > 0, share(F.col("mass"), total)).alias(score), "first_pos")


def relational_support(pool: DataFrame, weights: bool = True) -> DataFrame:
    """Confidence times relation and dependency weight, or confidence alone."""
    w = F.col("confidence")
    if weights:
        w = w * F.col("relation_weight") * F.col("dependency_weight")
    return answer_shares(pool, w, "relssc")


def top_answer(shares: DataFrame, score: str, by_first: bool = False) -> DataFrame:
    """The answer of the largest mass: of several the smallest text, or the first seen."""
    key = F.col("first_pos") if by_first else F.col("answer")
    best = F.min(F.struct((-F.col("mass")).alias("m"), key.alias("k"), F.col("answer").alias("answer"), F.col(score).alias(score))).alias("best")
    return shares.where(F.col(score).isNotNull()).groupBy("question_id").agg(best).select("question_id", F.col("best.answer").alias("answer"), F.col(f"best.{score}").alias(score))


def attach_targets(pool: DataFrame, shares: DataFrame, score: str) -> DataFrame:
    """Each row with its answer's score; null for invalid rows and undefined questions."""
    return pool.join(shares.select("question_id", "answer", score), ["question_id", "answer"], "left")


def counted_identity(pool: DataFrame) -> DataFrame:
    """Per answer: ``ssc``, its share of the valid identity rows (duplicates left out), and
    per question the valid share of the other views' rows (0 if there are none)."""
    rows = pool.where(~F.col("duplicate_view")).withColumn("identity", F.col("view") == 0)
    ok = F.col("answer").isNotNull()
    per = rows.groupBy("question_id", "answer").agg(
        F.count_if(ok & F.col("identity")).alias("hits"), F.count_if(~F.col("identity")).alias("others"), F.count_if(~F.col("identity") & ok).alias("others_ok")
    )
    hits, others = F.sum("hits").over(per_question()), F.sum("others").over(per_question())
    ratio = F.coalesce(share(F.sum("others_ok").over(per_question()), others), F.lit(0.0))
    return per.select("question_id", "answer", F.coalesce(share(F.col("hits"), hits), F.lit(0.0)).alias("ssc"), ratio.alias("relation_valid_ratio")).where("answer IS NOT NULL")


def resolve_target(mode: str, ssc: Column, relssc: Column, ratio: Column, strength: float = 0.5) -> Column:
    """``ssc``, ``relssc_replace``, or ``residual``; only the last is clipped."""
    if mode == "ssc":
        return ssc
    if mode == "relssc_replace":
        return relssc
    if mode != "residual":
        raise ValueError(f"unknown target mode {mode!r}")
    pulled = ssc - F.lit(strength) * ratio * F.greatest(ssc - relssc, F.lit(0.0))
    return F.when(relssc.isNotNull() & ssc.isNotNull(), F.least(F.greatest(pulled, F.lit(0.01)), F.lit(0.99)))


def counted_relations(pool: DataFrame) -> DataFrame:
    """Each answer's share of the valid rows of all views."""
    return answer_shares(pool, F.lit(1), "relsc")


def paired_scores(identity: DataFrame, relations: DataFrame) -> DataFrame:
    """Answers of the relation pool with both scores; one absent from a pool scores 0."""
    joined = identity.select("question_id", "answer", "ssc").join(relations.select("question_id", "answer", "relsc"), ["question_id", "answer"], "full")
    return joined.select("question_id", "answer", F.coalesce("ssc", F.lit(0.0)).alias("ssc"), F.coalesce("relsc", F.lit(0.0)).alias("relsc"))


def cluster_weights(pool: DataFrame, cluster: str, beta: float = 0.5) -> DataFrame:
    """Rows with ``cluster_size`` and ``dependency = size ** -beta``; invalid rows get 0.

    The weight is a decimal of nine digits, so masses do not depend on the order of rows.
    """
    ok = F.col("answer").isNotNull() & F.col(cluster).isNotNull()
    size = F.count_if(ok).over(Window.partitionBy("question_id", cluster))
    return pool.withColumn("cluster_size", F.when(ok, size)).withColumn("dependency", F.when(ok, F.round(F.pow(double(size), F.lit(-beta)), 9)).otherwise(0.0).cast("decimal(18,9)"))


def cluster_summary(pool: DataFrame, cluster: str, beta: float = 0.5) -> DataFrame:
    """Per question: clusters, mean and largest size, and the mass ``sum size**(1-beta)``."""
    sizes = pool.where(F.col("answer").isNotNull() & F.col(cluster).isNotNull()).groupBy("question_id", cluster).agg(F.count("*").alias("n"))
    return sizes.groupBy("question_id").agg(
        F.count("*").alias("clusters"), F.sum("n").alias("rows"), F.max("n").alias("largest"), share(F.sum("n"), F.count("*")).alias("mean_size"), F.sum(F.pow(double(F.col("n")), F.lit(1 - beta))).alias("effective_mass")
    )


def view_support(pool: DataFrame) -> DataFrame:
    """Per question, view and answer the share of ``dependency * confidence`` in the view.

    ``view_weight`` is the mean relation weight of all its rows, invalid ones included;
    views without positive mass do not appear.
    """
    w = F.when(F.col("answer").isNotNull(), F.col("confidence") * F.col("dependency_weight"))
    per = pool.groupBy("question_id", "view", "answer").agg(F.sum(w).alias("mass"), F.sum("relation_weight").alias("rw"), F.count("*").alias("n"))
    one = Window.partitionBy("question_id", "view")
    out = per.select("question_id", "view", "answer", "mass", F.sum("mass").over(one).alias("total"), share(F.sum("rw").over(one), F.sum("n").over(one)).alias("view_weight"))
    return out.where("answer IS NOT NULL AND mass IS NOT NULL AND total > 0").select("question_id", "view", "answer", share(F.col("mass"), F.col("total")).alias("support"), "view_weight")


def fragility(pool: DataFrame, strength: float = 0.5) -> DataFrame:
    """Per answer ``clip(max(s_0 - s_R, 0) + strength * sqrt(var), 0, 1)``.

    ``s_0`` is the identity view's support, ``s_R`` and ``var`` the weighted mean and
    variance over active views, where an absent answer has support 0. Questions without an
    identity view of positive mass, or without positive view weights, are left out. Sums
    over views come from aggregates alone, so the grid of views and answers is not built.
    """
    support = view_support(pool)
    views = support.select("question_id", "view", "view_weight").distinct()
    totals = views.groupBy("question_id").agg(F.sum("view_weight").alias("weight"), F.max((F.col("view") == 0).cast("int")).alias("identity"), F.count_if(F.col("view_weight") > 0).alias("active")).where("weight > 0 AND identity = 1")
    active = F.when(F.col("view_weight") > 0, F.col("view_weight")).otherwise(0.0)
    sums = support.groupBy("question_id", "answer").agg(
        F.sum(active * F.col("support")).alias("first"), F.sum(active * F.col("support") * F.col("support")).alias("second"), F.max(F.when(F.col("view") == 0, F.col("support"))).alias("own")
    )
    joined = sums.join(totals, "question_id")
    mean = F.col("first") / F.col("weight")
    spread = F.greatest(F.col("second") / F.col("weight") - mean * mean, F.lit(0.0))
    own = F.coalesce("own", F.lit(0.0))
    value = F.greatest(own - mean, F.lit(0.0)) + F.lit(strength) * F.sqrt(spread)
    return joined.select("question_id", "answer", own.alias("identity_support"), mean.alias("relational_support"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias("fragility"), "active")


def question_summary(pool: DataFrame, shares: DataFrame, score: str) -> DataFrame:
    """Per question: rows, valid and invalid ones, best score, and how many pass 0.75."""
    ok = F.col("answer").isNotNull() & F.col("confidence").isNotNull()
    counts = pool.groupBy("question_id").agg(F.count("*").alias("rows"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("invalid"))
    best = shares.groupBy("question_id").agg(F.max(score).alias("best"), F.count_if(F.col(score) > 0.75).alias("over"))
    return counts.join(best, "question_id", "left").select("question_id", "rows", "valid", "invalid", "best", F.coalesce("over", F.lit(0)).alias("over"))
