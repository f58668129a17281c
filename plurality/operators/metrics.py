"""Calibration metrics, ranking quality, and paired bootstraps over observations.

Observations have ``score`` in [0, 1] and ``correct`` 0 or 1; ``by`` names the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Paired rows of one comparison that the exact bootstrap takes; more go to the hashed one.
MAX_EXACT_ROWS = 1_000_000


def edges(bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0, 1, bins + 1)]


def bin_by_edges(score: Column, bins: int) -> Column:
    """Bin by the literal edges; a score of exactly 1 has bin ``bins`` and is dropped."""
    out = F.lit(None).cast("int")
    for i, low in enumerate(edges(bins)):
        out = F.when(score >= low, F.lit(i)).otherwise(out)
    return F.when(score < edges(bins)[-1], out)


def bin_by_product(score: Column, bins: int) -> Column:
    """``min(floor(score * bins), bins - 1)`` of the clipped score."""
    clipped = F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))
    return F.least(F.floor(clipped * bins), F.lit(bins - 1)).cast("int")


def bin_by_quotients(score: Column, bins: int) -> Column:
    """``i / bins <= score < (i + 1) / bins``; 1 is in the last bin."""
    out = F.lit(None).cast("int")
    for i in range(bins):
        out = F.when(score >= i / bins, F.lit(i)).otherwise(out)
    return F.when(score <= 1, out)


BINNINGS = {"edges": bin_by_edges, "product": bin_by_product, "quotients": bin_by_quotients}


def calibration_error(rows: DataFrame, by: list[str], binning: str = "product", bins: int = 10) -> DataFrame:
    """Weighted gap of accuracy and mean score over bins; weights are of all rows.

    Two small aggregates: by group and bin, then by group.
    """
    binned = rows.withColumn("_bin", BINNINGS[binning](F.col("score"), bins))
    per = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"), F.sum("score").alias("_s"), F.sum("correct").alias("_c"))
    gap = F.when(F.col("_bin").isNotNull(), F.abs(F.col("_c") - F.col("_s"))).otherwise(0.0)
    return per.groupBy(*by).agg((F.sum(gap) / F.sum("_n")).alias("ece"), F.sum("_n").alias("n"))


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    gap = F.col("score") - F.col("correct")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (100 * F.avg("correct")).alias("accuracy"), (100 * F.avg(gap * gap)).alias("brier"), F.avg("score").alias("mean_score"))


def auroc(rows: DataFrame, by: list[str], slots: int = 4096) -> DataFrame:
    """Area under the ROC curve, ties counting half; null if a group has one class.

    Rows are counted by score first. Scores fall into ordered slots; ranks inside a slot
    and totals of the slots before it give what lies below each score, so a group of any
    size is ranked in parts.
    """
    counts = rows.groupBy(*by, "score").agg(F.sum("correct").alias("p"), F.sum(1 - F.col("correct")).alias("m"))
    counts = counts.withColumn("slot", F.floor(F.col("score") * slots))
    inside = Window.partitionBy(*by, "slot").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    slot_sums = counts.groupBy(*by, "slot").agg(F.sum("m").alias("sm"))
    before = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_sums.select(*by, "slot", F.coalesce(F.sum("sm").over(before), F.lit(0)).alias("below"))
    placed = counts.withColumn("inside", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(offsets, [*by, "slot"])
    wins = F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("m") / 2))
    return placed.groupBy(*by).agg(wins.alias("_u"), F.sum("p").alias("positives"), F.sum("m").alias("negatives")).select(*by, "positives", "negatives", F.try_divide(F.col("_u"), F.col("positives") * F.col("negatives")).alias("auroc"))


def _values(correct: np.ndarray, score: np.ndarray, metric: str, bins: int) -> float:
    if metric == "accuracy":
        return 100 * float(correct.mean())
    if metric == "brier":
        return 100 * float(((score - correct) ** 2).mean())
    place = np.digitize(score, np.linspace(0, 1, bins + 1)) - 1 if metric == "ece_paper" else np.minimum((np.clip(score, 0, 1) * bins).astype(int), bins - 1)
    keep = place < bins
    gaps = np.abs(np.bincount(place[keep], correct[keep], bins) - np.bincount(place[keep], score[keep], bins))
    return 100 * float(gaps.sum() / len(score))


def paired_bootstrap(pairs: DataFrame, by: list[str], metric: str, replicates: int = 2000, seed: int = 0, bins: int = 10) -> DataFrame:
    """Percentile interval of the metric's difference over resampled pairs, per group.

    ``pairs``: ``by, question_id, ref_score, ref_correct, score, correct``. Ids are sorted
    and drawn with NumPy's generator, so results repeat exactly. A group is resampled in one
    task, at most ``MAX_EXACT_ROWS`` rows of it; ``hashed_bootstrap`` has no such bound.
    """
    spec = ", ".join(f"`{c}` {dict(pairs.dtypes)[c]}" for c in by)
    out = f"{spec}, n long, reference double, target double, delta double, low double, high double, p_improve double, excludes_zero boolean"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) > MAX_EXACT_ROWS:
            raise ValueError(f"{len(rows)} pairs in one comparison: use hashed_bootstrap")
        rows = rows.sort_values("question_id", kind="stable")
        cols = [rows[c].to_numpy(float) for c in ("ref_correct", "ref_score", "correct", "score")]
        n, rng = len(rows), np.random.default_rng(seed)
        deltas = np.empty(replicates)
        for i in range(replicates):
            at = rng.integers(0, n, size=n)
            deltas[i] = _values(cols[2][at], cols[3][at], metric, bins) - _values(cols[0][at], cols[1][at], metric, bins)
        low, high = np.percentile(deltas, [2.5, 97.5])
        better = deltas > 0 if metric == "accuracy" else deltas < 0
        ref, target = _values(cols[0], cols[1], metric, bins), _values(cols[2], cols[3], metric, bins)
        row = [n, ref, target, target - ref, low, high, float(better.mean() + 0.5 * (deltas == 0).mean()), bool(low > 0 or high < 0)]
        return pd.DataFrame([[*rows[by].iloc[0], *row]], columns=[*by, "n", "reference", "target", "delta", "low", "high", "p_improve", "excludes_zero"])

    return pairs.groupBy(*by).applyInPandas(run, out)


def _poisson_levels() -> np.ndarray:
    """Chances of at most 0, 1, 2, ... of a Poisson count with mean 1."""
    terms = np.exp(-1) / np.cumprod([1.0, *range(1, 9)])
    return np.cumsum(terms)


def resampled_counts(hashes: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """``[pair, replicate]``: how often a replicate has a pair, Poisson with mean 1.

    Two rounds of 32-bit multiplication and shifts mix a pair's hash with the replicate's
    number, so any engine can form the same counts.
    """
    low = np.uint64(0xFFFFFFFF)
    u = (hashes.astype(np.uint64)[:, None] + np.arange(replicates, dtype=np.uint64) * np.uint64(2654435761) + np.uint64(seed) * np.uint64(40503)) & low
    u = (u * np.uint64(2246822519)) & low
    u ^= u >> np.uint64(15)
    u = (u * np.uint64(3266489917)) & low
    u ^= u >> np.uint64(13)
    return np.searchsorted(_poisson_levels(), u / 2.0**32, "right").astype(np.int64)


def _bootstrap_terms(metric: str, bins: int, ref_score: np.ndarray, ref_correct: np.ndarray, score: np.ndarray, correct: np.ndarray) -> np.ndarray:
    """``[pair, term]``: what a pair adds to a replicate's sums. The first term counts pairs,
    the others are a difference, or gaps by bin of the target and then of the reference."""
    one = np.ones((len(score), 1))
    if metric == "accuracy":
        return np.hstack([one, (correct - ref_correct)[:, None]])
    if metric == "brier":
        return np.hstack([one, ((score - correct) ** 2 - (ref_score - ref_correct) ** 2)[:, None]])
    sides = []
    for p, c in ((score, correct), (ref_score, ref_correct)):
        place = np.digitize(p, np.linspace(0, 1, bins + 1)) - 1 if metric == "ece_paper" else np.minimum((np.clip(p, 0, 1) * bins).astype(int), bins - 1)
        side = np.zeros((len(p), bins))
        inside = np.flatnonzero((place >= 0) & (place < bins))
        side[inside, place[inside]] = (c - p)[inside]
        sides.append(side)
    return np.hstack([one, *sides])


#: Comparisons whose sums a task holds before it hands them on.
HELD_GROUPS = 64


def hashed_bootstrap(pairs: DataFrame, by: list[str], metric: str, replicates: int = 200, seed: int = 0, bins: int = 10) -> DataFrame:
    """The same interval for pairs of any number: ``accuracy``, ``brier``, ``ece_paper`` or
    ``ece_strict``.

    A replicate is a row of a matrix of sums: tasks multiply their pairs' resampled counts
    with what the pairs add to the metric, and hand on one matrix for each comparison. Pairs
    are not multiplied, nothing of theirs is shuffled, and a comparison never comes together.
    """
    width = 2 if metric in ("accuracy", "brier") else 1 + 2 * bins
    kinds = dict(pairs.dtypes)
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in by)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def shown() -> pd.DataFrame:
            rows = [(*group, at, float(x)) for group, sums in held.items() for at, x in enumerate(sums.ravel())]
            held.clear()
            return pd.DataFrame(rows, columns=[*by, "at", "x"])

        for frame in frames:
            for group, rows in frame.groupby(by, dropna=False, sort=False):
                terms = _bootstrap_terms(metric, bins, *(rows[c].to_numpy(float) for c in ("ref_score", "ref_correct", "score", "correct")))
                sums = resampled_counts(rows["_h"].to_numpy(np.uint64), replicates, seed).T @ terms
                key = tuple(None if pd.isna(g) else g for g in group)
                held[key] = held[key] + sums if key in held else sums
            if len(held) >= HELD_GROUPS:
                yield shown()
        if held:
            yield shown()

    digest = F.conv(F.substring(F.md5(F.col("question_id").cast("string")), 1, 8), 16, 10).cast("long")
    numbers = [F.col(c).cast("double").alias(c) for c in ("ref_score", "ref_correct", "score", "correct")]
    sums = pairs.select(*by, digest.alias("_h"), *numbers).mapInPandas(run, f"{spec}, at int, x double").groupBy(*by, "at").agg(F.sum("x").alias("x"))
    cell = F.pmod("at", F.lit(width))
    held = sums.groupBy(*by, F.floor(F.col("at") / width).alias("replicate")).agg(F.sum(F.when(cell == 0, F.col("x"))).alias("n"), F.map_from_entries(F.collect_list(F.struct(cell.alias("k"), F.col("x").alias("v")))).alias("terms"))
    if width == 2:
        d = F.try_divide(100 * F.col("terms")[F.lit(1)], F.col("n"))
    else:
        gaps = lambda first: sum((F.abs(F.col("terms")[F.lit(first + i)]) for i in range(bins)), F.lit(0.0))
        d = F.try_divide(100 * (gaps(1) - gaps(1 + bins)), F.col("n"))
    if metric == "accuracy":
        d = F.round(d, 9)  # equal counts are equal
    return _interval(held.select(*by, d.alias("d")), by, metric)


def _interval(means: DataFrame, by: list[str], metric: str) -> DataFrame:
    """95 % of the replicates' differences ``d``, and how many of them are better."""
    better = (F.col("d") > 0) if metric == "accuracy" else (F.col("d") < 0)
    return means.groupBy(*by).agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("ci"), F.avg(F.when(better, 1.0).when(F.col("d") == 0, 0.5).otherwise(0.0)).alias("p_improve")).select(*by, F.col("ci")[0].alias("low"), F.col("ci")[1].alias("high"), "p_improve")
