"""Ablations: which relations a pool is allowed to use, against baselines of equal budget.

A profile is a set of relation subtypes. Samples are counted per question, subtype and answer
once; profiles then add these few counts, so no sample is copied for each profile.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.operators import folds, metrics

# The subtypes of a relation, the profiles, and the mark of an invalid answer.
SUBTYPES = ("identity", "layout_wrapper", "number_representation", "equivalent_quantity")
PROFILES = {
    "Identity-only (stored g0)": ("identity",),
    "Layout-only": ("layout_wrapper",),
    "Number-only": ("number_representation",),
    "Equivalent-only": ("equivalent_quantity",),
    "Identity+Layout": ("identity", "layout_wrapper"),
    "Identity+Number": ("identity", "number_representation"),
    "Identity+Equivalent": ("identity", "equivalent_quantity"),
    "Drop-Layout": ("identity", "number_representation", "equivalent_quantity"),
    "Drop-Number": ("identity", "layout_wrapper", "equivalent_quantity"),
    "Drop-Equivalent": ("identity", "layout_wrapper", "number_representation"),
    "All-Relations": SUBTYPES,
}
INVALID = "<INVALID>"
# Published calibration errors of the reference methods.
PUBLISHED_ECE = {("gsm8k", "P(True)"): 12.03, ("gsm8k", "SC"): 4.48, ("gsm8k", "SSC"): 3.42, ("svamp", "P(True)"): 28.94, ("svamp", "SC"): 4.94, ("svamp", "SSC"): 3.75}


def relation_subtype(explicit: Column, relation_id: Column, relation_type: Column) -> Column:
    """What is given; else ``identity`` for the first relation or type, else type or id."""
    plain = lambda c: F.lower(F.trim(c.cast("string")))
    name, kind = F.coalesce(plain(relation_id), F.lit("g0")), F.coalesce(plain(relation_type), F.lit(""))
    other = F.when((name == "g0") | (kind == "identity"), "identity").when(kind != "", kind).otherwise(name)
    return F.coalesce(F.nullif(plain(explicit), F.lit("")), other)


def profile_table(spark: SparkSession, profiles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(name, subtype) for name, subtypes in (profiles or PROFILES).items() for subtype in subtypes]
    return spark.createDataFrame(rows, "profile string, subtype string")


def profile_observations(pool: DataFrame, gold: DataFrame, profiles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``profile, question_id, selected, valid, predicted, score, correct`` of a pool with
    ``subtype``: counted votes of the samples that a profile selects. A question whose
    selected samples are all invalid has null in the last three."""
    cells = pool.groupBy("question_id", "subtype", "answer").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    chosen = cells.join(F.broadcast(profile_table(pool.sparkSession, profiles)), "subtype")
    sums = chosen.groupBy("profile", "question_id", "answer").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    vote = F.when(F.col("answer").isNotNull(), F.struct("n", -F.col("first"), "answer"))
    per = sums.groupBy("profile", "question_id").agg(F.sum("n").alias("selected"), F.coalesce(F.sum(F.when(F.col("answer").isNotNull(), F.col("n"))), F.lit(0)).alias("valid"), F.max(vote).alias("b"))
    right = F.when(F.col("b").isNotNull(), F.coalesce((F.col("b.answer") == F.col("gold")).cast("int"), F.lit(0)))
    return per.join(gold, "question_id").select("profile", "question_id", "selected", "valid", F.col("b.answer").alias("predicted"), (F.col("b.n") / F.col("valid")).alias("score"), right.alias("correct"))


def _states(baseline: DataFrame) -> DataFrame:
    """Baseline samples with what is said after each: ``count`` and ``weight`` of the answers
    given, ``paper`` with missing answers as a class of their own; ``struct<w, answer, total>``.
    Votes that only grow have their leader as a running maximum."""
    c, kept = F.col, F.coalesce("answer", F.lit(INVALID))
    rows = baseline.select("question_id", "pos", "answer", "confidence", kept.alias("_a"))
    given = c("answer").isNotNull()
    votes = {"count": F.when(given, F.lit(1.0)), "weight": F.when(given, c("confidence")), "paper": c("confidence")}
    own = Window.partitionBy("question_id", "_a").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = lambda of: {f"_{k}_{name}": v for name in votes for k, v in of(name).items()}
    rows = rows.withColumns(each(lambda n: {"w": votes[n]}))
    rows = rows.withColumns(each(lambda n: {"m": F.sum(f"_w_{n}").over(own), "f": F.min(F.when(c(f"_w_{n}").isNotNull(), c("pos"))).over(own)}))
    lead = lambda n: F.when(c(f"_w_{n}").isNotNull(), F.struct(c(f"_m_{n}").alias("w"), (-c(f"_f_{n}")).alias("f"), c("_a").alias("answer")))
    rows = rows.withColumns(each(lambda n: {"l": F.max(lead(n)).over(so_far), "t": F.sum(f"_w_{n}").over(so_far)}))
    state = lambda n: F.struct(c(f"_l_{n}.w").cast("double").alias("w"), c(f"_l_{n}.answer").alias("answer"), c(f"_t_{n}").cast("double").alias("total")).alias(n)
    return rows.select("question_id", F.struct("pos", "answer", "confidence", *map(state, votes)).alias("x"))


def _question_rows(relations: DataFrame, baseline: DataFrame, gold: DataFrame) -> tuple[DataFrame, str]:
    """``question_id, gold, own, base``: counts of a question's relation samples by subtype and
    answer, and its baseline samples with what is said after each, as arrays; and the type of
    their confidence. ``falls`` tells that a weight is negative, where masses do not only grow."""
    cells = relations.groupBy("question_id", "subtype", "answer").agg(F.count("*").alias("n"), (-F.min("pos")).alias("f"))
    own = cells.groupBy("question_id").agg(F.collect_list(F.struct("subtype", "answer", "n", "f")).alias("own"))
    base = _states(baseline).groupBy("question_id").agg(F.array_sort(F.collect_list("x")).alias("base"), F.max(F.col("x.confidence") < 0).alias("falls"))
    return gold.join(own, "question_id").join(base, "question_id", "left"), dict(baseline.dtypes)["confidence"]


def _verdict(best: Column, gold: Column) -> Column:
    """``struct<score, correct>`` of a vote; null if nothing has positive mass."""
    right = F.coalesce(((best["answer"] != INVALID) & (best["answer"] == gold)).cast("int"), F.lit(0))
    return F.when(best["total"] > 0, F.struct((best["w"].cast("double") / best["total"].cast("double")).alias("score"), right.alias("correct")))


def _judged(best: Column, gold: Column) -> Column:
    return folds.let(best, lambda b: _verdict(b, gold))


def _lattice(rows: DataFrame, kind: str, profiles: dict[str, tuple[str, ...]] | None, verdicts: Callable[[Column, Column, Column], dict[str, Column]]) -> DataFrame:
    """``profile, question_id, selected, valid, v``: all profiles of a question from its own
    arrays. ``v`` is a struct of the verdicts on (counts of own samples selected, baseline
    samples of equal number, gold). Profiles that select nothing are left out."""
    wanted = F.array(*(F.struct(F.lit(name).alias("profile"), F.array(*map(F.lit, subtypes)).alias("subtypes")) for name, subtypes in (profiles or PROFILES).items()))

    def of(p: Column) -> Column:
        def counted(chosen: Column) -> Column:
            sizes = F.struct(_total_n(chosen).alias("selected"), _total_n(F.filter(chosen, lambda x: x["answer"].isNotNull())).alias("valid"))
            return folds.let(sizes, lambda z: told(chosen, z["selected"], z["valid"]))

        def told(chosen: Column, selected: Column, valid: Column) -> Column:
            equal = F.filter("base", lambda x: x["pos"] < selected)
            every = folds.let(equal, lambda e: F.struct(*(v.alias(name) for name, v in verdicts(chosen, e, F.col("gold")).items())))
            return F.struct(p["profile"].alias("profile"), selected.alias("selected"), valid.alias("valid"), every.alias("v"))

        return folds.let(F.filter("own", lambda x: F.array_contains(p["subtypes"], x["subtype"])), counted)

    return rows.select("question_id", F.explode(F.filter(F.transform(wanted, of), lambda x: x["selected"] > 0)).alias("p")).select("question_id", "p.*")


def _kept(samples: Column) -> Column:
    """Samples whose missing answers are a class of their own."""
    return F.transform(samples, lambda x: F.struct(x["pos"].alias("pos"), F.coalesce(x["answer"], F.lit(INVALID)).alias("answer"), x["confidence"].alias("confidence")))


def _total_n(cells: Column) -> Column:
    return F.aggregate(cells, F.lit(0).cast("long"), lambda acc, x: acc + x["n"])


def _counted(cells: Column, gold: Column) -> Column:
    """The verdict of counts by subtype and answer."""

    def best(valid: Column) -> Column:
        def one(answer: Column) -> Column:
            own = F.filter(valid, lambda x: x["answer"] == answer)
            return F.struct(_total_n(own).alias("w"), F.array_max(F.transform(own, lambda x: x["f"])).alias("f"), answer.alias("answer"))

        top = F.array_max(F.transform(F.array_distinct(F.transform(valid, lambda x: x["answer"])), one))
        return folds.let(top, lambda t: F.when(t.isNotNull(), F.struct(t["w"].alias("w"), t["answer"].alias("answer"), _total_n(valid).alias("total"))))

    return _judged(folds.let(F.filter(cells, lambda x: x["answer"].isNotNull()), best), gold)


def _said(samples: Column, name: str, gold: Column, kind: str) -> Column:
    """The verdict of a vote of all ``samples``: what stands at the last of them, or, where
    masses may fall, the vote taken anew."""
    stands = _judged(F.get(samples, F.size(samples) - 1)[name], gold)
    if name == "count":
        return stands
    rows = _kept(samples) if name == "paper" else samples
    anew = folds.let(rows, lambda e: _judged(folds.vote(e, lambda x: x["confidence"], kind), gold))
    return F.when(F.col("falls"), anew).otherwise(stands)


def decomposition(relations: DataFrame, baseline: DataFrame, gold: DataFrame, profiles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``profile, method, question_id, selected, score, correct`` over the questions that all
    four methods of a profile have. Both pools are read once."""
    rows, kind = _question_rows(relations, baseline, gold)
    verdicts = lambda own, equal, truth: {
        "RelSC-profile": _counted(own, truth),
        "SC-k-valid": _said(equal, "count", truth, kind),
        "SSC-k-valid": _said(equal, "weight", truth, kind),
        "SSC-k-paper": _said(equal, "paper", truth, kind),
    }
    per = _lattice(rows, kind, profiles, verdicts)
    names = ["RelSC-profile", "SC-k-valid", "SSC-k-valid", "SSC-k-paper"]
    all_four = functools.reduce(lambda a, b: a & b, (F.col("v")[n].isNotNull() for n in names))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("method"), F.col("v")[n].alias("x")) for n in names)))
    return per.where(all_four).select("profile", "question_id", "selected", each.alias("m")).select("profile", "m.method", "question_id", "selected", "m.x.score", "m.x.correct")


def metric_rows(rows: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """``n``, accuracy, both calibration errors and Brier score in percent, per group.

    Rows are summed once by both binnings; all metrics come from a group's few cells (at most
    ``(bins + 1) ** 2``), which stand in one row.
    """
    gap = F.col("score") - F.col("correct")
    binned = rows.withColumns({"_b1": metrics.bin_by_edges(F.col("score"), bins), "_b2": metrics.bin_by_product(F.col("score"), bins)})
    cells = binned.groupBy(*by, "_b1", "_b2").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("correct").alias("c"), F.sum(gap * gap).alias("q"))
    held = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.sum("q").alias("q"), F.array_sort(F.collect_list(F.struct("_b1", "_b2", "s", "c"))).alias("cells"))

    def error(name: str) -> Column:
        apart = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + (y["c"] - y["s"]))
        gaps = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.abs(apart(F.filter("cells", lambda x: x[name] == b))))
        return 100 * F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / F.col("n")

    return held.select(*by, "n", (100 * F.col("c") / F.col("n")).alias("accuracy"), (100 * F.col("q") / F.col("n")).alias("brier"), error("_b1").alias("ece_paper"), error("_b2").alias("ece_strict"))


#: Effects told apart: name, the method before, the method after.
EFFECTS = [("relation", "SC-k-valid", "RelSC-profile"), ("weighting", "SSC-k-valid", "SC-k-valid"), ("invalid_policy", "SSC-k-paper", "SSC-k-valid")]


def _beside(table: DataFrame, names: list[str], values: list[str]) -> DataFrame:
    """One row a profile: a struct of ``values`` for each method of ``names``."""
    return table.groupBy("profile").agg(*(F.max(F.when(F.col("method") == n, F.struct(*values))).alias(n) for n in names))


def effects(table: DataFrame, metrics_of: tuple[str, ...] = ("accuracy", "ece_paper", "ece_strict", "brier")) -> DataFrame:
    """Per profile and effect the difference of each metric, from ``metric_rows``."""
    names = list(dict.fromkeys(m for _, *pair in EFFECTS for m in pair))
    one = lambda name, a, b: F.struct(F.lit(name).alias("effect"), F.col(f"`{a}`").isNotNull().alias("_a"), F.col(f"`{b}`").isNotNull().alias("_b"), *((F.col(f"`{b}`")[m] - F.col(f"`{a}`")[m]).alias(m) for m in metrics_of))
    rows = _beside(table, names, list(metrics_of)).select("profile", F.explode(F.array(*(one(*e) for e in EFFECTS))).alias("e"))
    return rows.where("e._a AND e._b").select("profile", "e.effect", *(f"e.{m}" for m in metrics_of))


def best_profiles(effect_rows: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` profiles whose relation effect lowers calibration error most."""
    rows = effect_rows.where("effect = 'relation'")
    return rows.orderBy("ece_paper", "brier", F.desc("accuracy"), "profile").limit(k)


def profile_report(relations: DataFrame, baseline: DataFrame, gold: DataFrame, profiles: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """Metrics of each profile beside the full baseline and the one of equal budget, over
    the questions that all three have, and what the profile adds to either."""
    rows, kind = _question_rows(relations, baseline, gold)
    paper = lambda samples, truth: _said(samples, "paper", truth, kind)
    per = _lattice(rows.withColumn("full", paper(F.col("base"), F.col("gold"))), kind, profiles, lambda own, equal, truth: {"own": _counted(own, truth), "full": F.col("full"), "equal": paper(equal, truth)})
    names = ["own", "full", "equal"]
    all_three = functools.reduce(lambda a, b: a & b, (F.col("v")[n].isNotNull() for n in names))
    measured = ["n", "accuracy", "brier", "ece_paper", "ece_strict"]
    each = F.array(*(F.struct(F.lit(n).alias("method"), F.col("v")[n].alias("x")) for n in names))
    flat = per.where(all_three).select("profile", F.explode(each).alias("m")).select("profile", "m.method", "m.x.score", "m.x.correct")
    means = per.groupBy("profile").agg(F.avg("selected").alias("mean_selected"), F.avg("valid").alias("mean_valid"))
    beside = _beside(metric_rows(flat, ["profile", "method"]), names, measured).join(means, "profile")
    shown = [F.col("own")[m].alias(m) for m in measured]
    for name in ("full", "equal"):
        for m in ("accuracy", "ece_paper", "brier"):
            shown += [F.col(name)[m].alias(f"{name}_{m}"), (F.col("own")[m] - F.col(name)[m]).alias(f"delta_{m}_{name}")]
    return beside.where("own IS NOT NULL").select("profile", *shown, "mean_selected", "mean_valid")


def slot_observations(pool: DataFrame, gold: DataFrame, slot: int) -> DataFrame:
    """The confidence of one sample per question: the one at ``slot`` modulo their number.

    A missing confidence leaves the question out; a missing answer is wrong.
    """
    size = F.count("*").over(Window.partitionBy("question_id"))
    rows = pool.withColumn("_n", size).where(F.col("pos") == F.lit(slot) % F.col("_n")).where("confidence IS NOT NULL")
    return single_observations(rows, gold)


def single_observations(pool: DataFrame, gold: DataFrame) -> DataFrame:
    """Every sample with a confidence as an observation of its own."""
    rows = pool.where("confidence IS NOT NULL").join(gold, "question_id")
    return rows.select("question_id", "pos", F.col("answer").alias("predicted"), F.col("confidence").cast("double").alias("score"), F.coalesce((F.col("answer") == F.col("gold")).cast("int"), F.lit(0)).alias("correct"))


def against_published(rows: DataFrame, published: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """``dataset, method, ece`` rows with the published error and the difference, null where
    none is published."""
    known = rows.sparkSession.createDataFrame([(d, m, v) for (d, m), v in (published or PUBLISHED_ECE).items()], "dataset string, method string, published double")
    return rows.join(F.broadcast(known), ["dataset", "method"], "left").withColumn("delta", F.col("ece") - F.col("published"))
