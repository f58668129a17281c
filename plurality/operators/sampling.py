"""Training mixes: exact allocations, bin-balanced samples, admission, pair terms.

Draws are by hash of the row's id, so they repeat and need no global order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions.hashing import stable_id


def largest_remainder(weights: DataFrame, total: int, key: str, weight: str = "weight") -> DataFrame:
    """``allocation`` of a whole number over few weighted rows: floors of the quotas, then
    one more for the largest remainders, smaller keys first.

    The rows are a configuration (one per data set), so one window orders them.
    """
    every = Window.partitionBy(F.lit(1))
    quota = F.lit(float(total)) * F.col(weight) / F.sum(weight).over(every)
    rows = weights.withColumn("_q", quota).withColumn("_f", F.floor("_q"))
    rank = F.row_number().over(every.orderBy((F.col("_f") - F.col("_q")), key))
    left = F.lit(total) - F.sum("_f").over(every)
    return rows.select(key, (F.col("_f") + (rank <= left).cast("int")).cast("long").alias("allocation"))


def target_bin(target: Column) -> Column:
    """21 bins of 0.05, the last for 1 alone."""
    return F.least(F.floor(target / 0.05), F.lit(20)).cast("int")


def dataset_counts(specs: DataFrame, requested: int, causal_ratio: float) -> DataFrame:
    """``dataset, total, calibration, causal`` from ``dataset, weight, percentage``.

    An explicit percentage is the set's fraction, else its part of all weights. Products are
    rounded half to even.
    """
    every = Window.partitionBy(F.lit(1))  # one row a data set
    fraction = F.coalesce(F.col("percentage").cast("double"), F.try_divide(F.col("weight").cast("double"), F.sum(F.col("weight").cast("double")).over(every)), F.lit(0.0))
    total = F.rint(F.lit(float(requested)) * fraction).cast("long")
    calibration = F.rint(F.col("total") * F.lit(1.0 - causal_ratio)).cast("long")
    rows = specs.select("dataset", total.alias("total")).withColumn("calibration", calibration)
    return rows.withColumn("causal", F.greatest(F.lit(0), F.col("total") - F.col("calibration")))


def bin_balanced(rows: DataFrame, count: int | Column, target: str, key: str, group: str, seed: int = 0) -> DataFrame:
    """``count`` rows of each group, evenly from the 21 target bins, topped up from the rest.

    ``count`` is a number, or a column with each group's own.     Each bin first gives ``max(1, count // 21)``. The rows taken are the first by (filled
    from bins, bin, hash), as many as ``count``; a group with fewer rows gives all. Ranks
    are cut inside hash slots before groups are ranked, so no task ranks a whole group.
    """
    count = F.lit(count) if isinstance(count, int) else count
    per_bin = F.when(count > 0, F.greatest(F.lit(1), F.floor(count / 21))).otherwise(0)
    h = rows.withColumn("_h", stable_id(F.lit(seed), F.col(key), length=32)).withColumn("_bin", target_bin(F.col(target))).withColumn("_slot", F.substring("_h", -2, 2))
    keep = F.row_number().over(Window.partitionBy(group, "_bin", "_slot").orderBy("_h", key))
    h = h.withColumn("_k", keep).where(F.col("_k") <= count)
    in_bin = F.row_number().over(Window.partitionBy(group, "_bin").orderBy("_h", key))
    h = h.withColumn("_b", in_bin).where(F.col("_b") <= count)
    first = F.col("_b") <= per_bin
    order = Window.partitionBy(group).orderBy((~first), F.when(first, F.col("_bin")).otherwise(0), "_h", key)
    out = h.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= count)
    return out.select(*rows.columns, F.col("_bin").alias("target_bin"))


def hashed_sample(rows: DataFrame, count: int | Column, key: str, group: str, seed: int = 0) -> DataFrame:
    """The first ``count`` rows of each group by hash; cut in slots before the last rank."""
    h = rows.withColumn("_h", stable_id(F.lit(seed), F.col(key), length=32)).withColumn("_slot", F.substring("_h", -2, 2))
    h = h.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_slot").orderBy("_h", key))).where(F.col("_k") <= count)
    return h.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).where(F.col("_r") <= count).select(*rows.columns)


def admitted(mode: str, ssc: Column, relssc: Column, fragility: Column, threshold: float = 0.75, support: float = 0.5, fragile: float = 0.3, named: Column | None = None) -> Column:
    """Rows a generation loss may learn from: high count support, robust support, or a
    ``named`` field over the threshold."""
    if mode == "field" and named is not None:
        return F.coalesce(named > threshold, F.lit(False))
    if mode == "ssc":
        return F.coalesce(ssc > threshold, F.lit(False))
    if mode == "robust":
        return F.coalesce((relssc > support) & (fragility < fragile), F.lit(False))
    raise ValueError(f"unknown admission mode {mode!r}")


def task_mix(calibration: DataFrame, causal: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Both tasks tagged and united; ``shuffle_key`` orders them by hash."""
    both = calibration.withColumn("task", F.lit("calibration")).unionByName(causal.withColumn("task", F.lit("causal_lm")), allowMissingColumns=True)
    return both.withColumn("shuffle_key", stable_id(F.lit(seed), F.col("task"), F.col(key), length=32))


def mixed_examples(rows: DataFrame, counts: DataFrame, target: str, key: str, admission: Column, seed: int = 0) -> DataFrame:
    """Calibration and generation examples of all data sets, tagged, with a shuffle key.

    ``counts`` is ``dataset_counts``. Calibration rows come evenly from the target's bins;
    generation rows from those that ``admission`` (never the target) lets in. Rows without a
    target, or of a data set without counts, are not used.
    """
    sized = rows.where(F.col(target).isNotNull()).join(F.broadcast(counts.select("dataset", F.col("calibration").alias("_cal"), F.col("causal").alias("_gen"))), "dataset")
    own = bin_balanced(sized, F.col("_cal"), target, key, "dataset", seed).drop("target_bin", "_cal", "_gen")
    generation = hashed_sample(sized.where(admission), F.col("_gen"), key, "dataset", seed + 1).drop("_cal", "_gen")
    return task_mix(own, generation.withColumn(target, F.lit(-1.0)), key, seed)


def hybrid_target(mode: str, ssc: Column, relssc: Column, ratio: Column, strength: float = 0.5) -> Column:
    """A target with one more mode: ``hybrid`` takes a relational score from 0 to 1 as it is,
    anything else in it is an error."""
    if mode != "hybrid":
        from plurality.operators.support import resolve_target

        return resolve_target(mode, ssc, relssc, ratio, strength)
    value = relssc.cast("double")
    return F.when(F.coalesce(value.between(0, 1), F.lit(False)), value).otherwise(F.raise_error(F.lit("a hybrid target lies in [0, 1]")))


def mixed_loss(rows: DataFrame, task: str = "task", loss: str = "loss") -> DataFrame:
    """The mean loss of each task, and of both weighted by their records."""
    sums = rows.groupBy(task).agg(F.count(loss).alias("records"), F.sum(loss).alias("s"))
    total = sums.agg(F.lit("all").alias(task), F.sum("records").alias("records"), F.sum("s").alias("s"))
    return sums.unionByName(total).select(task, "records", F.try_divide(F.col("s"), F.col("records")).alias("loss"))


def rank_pair_loss(rows: DataFrame, target: str, score: str) -> DataFrame:
    """Per question the mean of ``log(1 + exp(-(s_i - s_j)))`` over pairs of its rows with
    ``target_i > target_j``, and the number of pairs.

    Equal rows are counted first; distinct (target, score) values of a question pair up,
    weighted by their counts.
    """
    cells = rows.where(F.col(target).isNotNull() & F.col(score).isNotNull()).groupBy("question_id", F.col(target).alias("t"), F.col(score).alias("s")).agg(F.count("*").alias("n"))
    low = cells.select("question_id", *[F.col(c).alias(f"{c}2") for c in "tsn"])
    pairs = cells.join(low, "question_id").where("t > t2")
    weight = F.col("n") * F.col("n2")
    gap = (F.col("s") - F.col("s2")).cast("double")
    return pairs.groupBy("question_id").agg((F.sum(weight * F.log1p(F.exp(-gap))) / F.sum(weight)).alias("loss"), F.sum(weight).alias("pairs"))


def smooth_l1(prediction: Column, target: Column, beta: float = 1.0) -> Column:
    gap = F.abs(prediction - target)
    return F.when(gap < beta, gap * gap / (2 * beta)).otherwise(gap - beta / 2)


def binary_cross_entropy(prediction: Column, target: Column, eps: float = 1e-6) -> Column:
    p = F.least(F.greatest(prediction, F.lit(eps)), F.lit(1 - eps))
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))
