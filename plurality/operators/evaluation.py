"""The whole evaluation of a pool: fixed budgets, threshold curves, budget matches.

A question's samples become one row (``folds``), in which every method is folded; what a
report row adds up over questions is the same for all of them (``MEASURES``). Expected
questions that the pool lacks are wrong, use nothing, and are insufficient. Curves add the
fall-back of all questions once and changes where a threshold stops, so questions are not
multiplied by the grid, but for window sizes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.operators import folds, selection, stopping

# The methods, in order of display, and the columns of a report.
FIXED = ["SC", "CISC", "Self-Certainty", "Best-of-N", "weighted-SC"]
DYNAMIC = ["confident-stop", "ASC", "weighted-ASC", "ESC", "RASC"]
PHASES = ["validation", "test", "analysis"]
COLUMNS = (
    "row_type method budget budget_target budget_cap threshold parameter_type window_size questions_total questions_observed correct accuracy "
    "accuracy_percent actual_avg_samples avg_samples_used avg_samples_used_observed generated_samples valid_samples invalid_samples invalid_rate "
    "invalid_predictions insufficient_sample_questions invalid_gold_questions early_stop_questions budget_gap budget_compliant selection_split "
    "selection_rule validation_actual_avg_samples"
).split()
MEASURES = folds.MEASURES
RULES = {
    "validation": "closest validation average at or below the target; accuracy not used",
    "test": "fixed parameter of the validation artifact",
    "analysis": "closest average of the curve itself; not reportable as test",
}


@dataclass(frozen=True)
class Settings:
    """Budgets and grids of an evaluation; a value out of range is an error."""

    budgets: tuple[int, ...] = (1, 2, 4, 8, 16, 32)
    thresholds: tuple[float, ...] = field(default_factory=lambda: tuple(i / 100 for i in range(101)))
    cap: int = 32
    targets: tuple[int, ...] = (16,)
    min_valid: int = 2
    buffer_size: int = 5
    window_sizes: tuple[int, ...] = ()
    temperature: float = 1.0
    scale: str = "softmax"

    def __post_init__(self):
        checks = [
            (bool(self.budgets) and all(b > 0 for b in self.budgets), "budgets must be positive"),
            (16 in self.budgets, "the budgets must include 16"),
            (self.cap > 0, "the cap must be positive"),
            (bool(self.thresholds) and all(0 <= t <= 1 for t in self.thresholds), "thresholds lie in [0, 1]"),
            (all(t > 0 for t in self.targets), "targets must be positive"),
            (self.min_valid > 0 and self.buffer_size > 0, "the least valid rows and the buffer must be positive"),
            (all(0 < s <= self.cap for s in self.window_sizes), "window sizes lie between 1 and the cap"),
            (math.isfinite(self.temperature) and self.temperature > 0, "the temperature must be positive"),
            (self.scale in ("softmax", "linear", "none"), "the scale is softmax, linear or none"),
        ]
        for good, text in checks:
            if not good:
                raise ValueError(text)

    def grid(self, method: str, cap: int) -> list[float]:
        """Parameters of a method under a cap: thresholds, or window sizes up to the cap."""
        if method != "ESC":
            return sorted(set(self.thresholds))
        sizes = [s for s in (self.window_sizes or range(2, self.cap + 1)) if s <= cap]
        return [float(s) for s in sorted(set(sizes)) or [cap]]


#: Kinds of a report's rows.
ROW_TYPES = ["fixed_budget", "threshold_curve", "dynamic_budget_match"]
FIXED_SERIES, CURVE_SERIES, TOTALS = "fixed", "curve", "totals"


@dataclass(frozen=True)
class Series:
    """A group of report rows: methods under one cap, for a target or for the whole curve."""

    name: str
    cap: int
    target: int | None = None


def _wanted_series(settings: Settings, phase: str, row_types: list[str]) -> list[Series]:
    out = []
    if phase != "test" and "threshold_curve" in row_types:
        out.append(Series(CURVE_SERIES, settings.cap))
    if phase == "test" or "dynamic_budget_match" in row_types:
        out += [Series(f"match:{t}", min(settings.cap, t), t) for t in settings.targets]
    return out


def _parameters(settings: Settings, method: str, cap: int) -> list[float]:
    grid = settings.grid(method, cap)
    return sorted({float(min(max(2, stopping.window_size(s, cap)), cap)) for s in grid}) if method == "ESC" else grid


def _entry(method: str, at: Column, m: Column) -> Column:
    return F.struct(F.lit(method).alias("method"), at.cast("int").alias("at"), m.alias("m"))


def _fixed_entries(settings: Settings, methods: list[str], kinds: dict[str, str], alike: bool) -> Column:
    """Entries of every vote under every budget. Where both weights are ``alike`` their vote is
    taken once."""
    said = {
        "SC": lambda p: F.get(p, F.size(p) - 1)["by_count"]["leader"],
        "CISC": lambda p: folds.informed_winner(p, settings.temperature, settings.scale),
        "Self-Certainty": lambda p: folds.winner(p, lambda x: x["n"], kinds["n"]),
        "Best-of-N": folds.best_sample,
        "weighted-SC": lambda p: folds.winner(p, lambda x: x["c"], kinds["c"]),
    }
    samples, size, gold = F.col("samples"), F.col("size"), F.col("gold")

    def of(budget: Column, at: Column) -> Column:
        def told(prefix: Column) -> Column:
            # one expression of the measures for all methods, as they differ in what is said
            both = {"Self-Certainty", "weighted-SC"}
            one = lambda m, w: F.struct(F.lit(m).alias("method"), (said[m](prefix) if w is None or m not in both else w).alias("prediction"))
            told_of = lambda w: F.array(*(one(m, w) for m in FIXED if m in methods))
            votes = folds.let(said["weighted-SC"](prefix), told_of) if alike and both <= set(methods) else told_of(None)
            return F.transform(votes, lambda v: F.struct(v["method"].alias("method"), at.cast("int").alias("at"), folds.fixed_measures(budget, v["prediction"], samples, size, gold).alias("m")))

        return folds.let(F.slice(samples, 1, budget), told)

    return F.flatten(F.transform(F.array(*map(F.lit, sorted(set(settings.budgets)))), of))


def _rule_entries(rules: list[str], settings: Settings, kind: str) -> Column:
    """Entries of every stopping rule, for rows with ``prefix, voted`` and ``spec``."""
    prefix, size, gold, spec = F.col("prefix"), F.col("size"), F.col("gold"), F.col("spec")
    cap = spec["cap"]
    leader = lambda name: F.get(prefix, F.size(prefix) - 1)[name]["leader"]
    last = {"ASC": leader("by_count"), "weighted-ASC": leader("by_weight"), "confident-stop": F.col("voted"), "RASC": F.col("voted")}
    lifts = {"ASC": "by_count", "weighted-ASC": "by_weight", "confident-stop": "alone"}
    found = []
    for method in rules:
        grid = spec["grids"][method]
        if method == "ESC":
            out = folds.window_measures(cap, grid, prefix, size, gold)
        else:
            reached = folds.buffer_lifts(prefix, settings.buffer_size, kind, gold) if method == "RASC" else folds.lifts(prefix, lifts[method], gold)
            out = _changed(reached, folds.fallback_measures(cap, last[method], cap, prefix, size, gold), grid)
        found.append(_named(method, out))
    return F.concat(*found)


def _changed(lifts: Column, base: Column, grid: Column) -> Column:
    return folds.let(base, lambda b: folds.changes(lifts, b, grid))


def _named(method: str, found: Column) -> Column:
    return F.transform(found, lambda x: _entry(method, x["at"], x["m"]))


def _spec(name: str, cap: int, grids: dict[str, Column]) -> Column:
    every = [(grids[m] if m in grids else F.array().cast("array<double>")).alias(m) for m in DYNAMIC]
    return F.struct(F.lit(name).alias("series"), F.lit(cap).cast("int").alias("cap"), F.struct(*every).alias("grids"))


def _chosen(artifact: DataFrame, by: list[str], targets: list[int], methods: list[str]) -> DataFrame:
    """An artifact as one map a group (``method:target`` to parameter and average before).

    A parameter that is given twice is an error, and one that is not, where the map is read.
    """
    rows = artifact.where(F.col("budget_target").isin(targets) & F.col("method").isin(methods))
    value = F.struct(F.col("parameter").cast("double").alias("parameter"), F.col("validation_actual_avg_samples").cast("double").alias("before"))
    entry = F.struct(F.concat_ws(":", "method", F.col("budget_target").cast("string")).alias("k"), value.alias("v"))
    return rows.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("chosen"))


def _grid_of(method: str, target: int) -> Column:
    lost = F.raise_error(F.lit(f"the artifact must have every method once for target {target}: {method} has none"))
    return F.array(F.coalesce(F.try_element_at("chosen", F.lit(f"{method}:{target}"))["parameter"], lost.cast("double")))


KEYS = ["parameter double", "cap long", "target long", "before double"]
COUNTS = ["questions_total", "questions_observed", "invalid_gold_questions"]


def _summed(rows: DataFrame, wanted: DataFrame | None, by: list[str], key: Column) -> DataFrame:
    """Sums of measures by ``series, method, at``, with the parameter that stands there.

    ``rows`` have ``entries`` and ``key`` (a struct of ``KEYS``); ``wanted`` adds the
    parameters of whole grids as rows without measures, so that each place has one. What is
    expected and observed is summed in the same way, and stands beside every row.
    """
    names = [k.split()[0] for k in KEYS]
    each = rows.select(*by, "series", key.alias("k"), F.explode("entries").alias("e")).select(*by, "series", "e.method", "e.at", *(F.get("e.m", F.lit(i)).alias(m) for i, m in enumerate(MEASURES)), "k.*")
    if wanted is not None:
        each = each.unionByName(wanted, allowMissingColumns=True)
    sums = each.groupBy(*by, "series", "method", "at").agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES), *(F.max(k).alias(k) for k in names))
    group = Window.partitionBy(*by)  # a row for each place of the grids
    total = lambda m: F.max(F.when(F.col("series") == TOTALS, F.col(m))).over(group)
    order = Window.partitionBy(*by, "series", "method").orderBy("at")
    whole = (F.col("series") == FIXED_SERIES) | (F.col("method") == "ESC")
    along = {m: F.when(whole, F.col(m)).otherwise(F.sum(m).over(order)).alias(m) for m in MEASURES}
    counts = [total(m).alias(c) for m, c in zip(MEASURES, COUNTS, strict=False)]
    return sums.select(*by, "series", "method", *names, *along.values(), *counts).where("parameter IS NOT NULL AND questions_total IS NOT NULL")


def report_rows(rows: DataFrame) -> DataFrame:
    """Sums of the observed questions, with missing ones added and ratios formed."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    c = F.col
    missing, invalid = c("questions_total") - c("questions_observed"), c("generated_samples") - c("valid_samples")
    average = ratio(c("generated_samples"), c("questions_total"))
    more = {
        "invalid_predictions": c("invalid_predictions") + missing, "insufficient_sample_questions": c("insufficient_sample_questions") + missing, "accuracy": ratio(c("correct"), c("questions_total")), "accuracy_percent": 100 * ratio(c("correct"), c("questions_total")),
        "actual_avg_samples": average, "avg_samples_used": average, "avg_samples_used_observed": ratio(c("generated_samples"), c("questions_observed")), "invalid_samples": invalid, "invalid_rate": ratio(invalid, c("generated_samples")),
    }
    return rows.withColumns(more)


def _shown(rows: DataFrame, by: list[str], phase: str) -> DataFrame:
    """Rows of all kinds from those of the series: budgets, curves, and matches."""
    fixed, curve = F.col("series") == FIXED_SERIES, F.col("series") == CURVE_SERIES
    target = F.col("target")
    gap = F.col("actual_avg_samples") - target
    within = F.col("actual_avg_samples") <= target + 1e-12
    if phase != "test":  # of a target's grid the parameter nearest to it
        order = [F.abs(gap)] if phase == "analysis" else [within.desc(), -gap]
        nearest = F.row_number().over(Window.partitionBy(*by, "series", "method").orderBy(*order, "parameter"))
        allowed = (nearest == 1) if phase == "analysis" else (nearest == 1) & within
        rows = rows.withColumn("_keep", F.when(target.isNull(), True).otherwise(allowed)).where("_keep").drop("_keep")
        rows = rows.withColumn("row_type", F.when(fixed, ROW_TYPES[0]).when(curve, ROW_TYPES[1]).otherwise(ROW_TYPES[2]))
    else:
        kinds = F.when(fixed, F.array(F.lit(ROW_TYPES[0]))).otherwise(F.array(F.lit(ROW_TYPES[1]), F.lit(ROW_TYPES[2])))
        rows = rows.withColumn("row_type", F.explode(kinds))
    match, window = F.col("row_type") == ROW_TYPES[2], F.col("method") == "ESC"
    budget, phase_of = F.col("parameter").cast("long"), F.lit("analysis" if phase == "analysis" else "validation")
    return rows.withColumns({
        "budget": F.when(fixed, budget).when(match, target), "budget_cap": F.when(fixed, budget).otherwise(F.col("cap")), "threshold": F.when(~fixed, F.col("parameter")),
        "parameter_type": F.when(~fixed, F.when(window, "window_size").otherwise("confidence_threshold")), "window_size": F.when(~fixed & window, budget),
        "budget_target": F.when(match, target), "budget_gap": F.when(match, gap), "budget_compliant": F.when(match, gap <= 0),
        "selection_split": F.when(match, phase_of), "selection_rule": F.when(match, F.lit(RULES[phase])), "validation_actual_avg_samples": F.when(match, F.col("before")),
    })


def with_columns(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and exactly the report's columns, in order; absent ones are null."""
    text = {"row_type", "method", "parameter_type", "selection_split", "selection_rule"}
    real = {"threshold", "accuracy", "accuracy_percent", "actual_avg_samples", "avg_samples_used", "avg_samples_used_observed", "invalid_rate", "budget_gap", "validation_actual_avg_samples"}
    kind = lambda c: "string" if c in text else "double" if c in real else "boolean" if c == "budget_compliant" else "long"
    return rows.select(*by, *((F.col(c) if c in rows.columns else F.lit(None)).cast(kind(c)).alias(c) for c in COLUMNS))


def evaluate(
    pool: DataFrame, expected: DataFrame, settings: Settings | None = None, phase: str = "analysis", artifact: DataFrame | None = None, certainty: str = "confidence",
    by: list[str] | None = None, row_types: list[str] | None = None, methods: list[str] | None = None, tasks: int | None = None,
) -> DataFrame:
    """All report rows of a pool (``question_id, pos, answer, confidence``) over expected
    questions (``question_id, gold``).

    ``validation`` and ``analysis`` have curves of every method at ``settings.cap`` and, for
    each target, the parameter matched on curves capped by the target; ``validation`` never
    goes over a target, and a method that can not meet one has no row (``unmatched``).
    ``test`` only evaluates the parameters of ``artifact`` at their targets. Questions of the
    pool that are not expected do not count: ``matching.coverage`` lists them. ``by`` names
    columns of both tables (a model, a data set) that reports are made for, ``row_types`` and
    ``methods`` what is needed of them. The pool is read once, whatever is asked for; nothing
    runs before the result does. Samples are dealt by question to ``tasks`` tasks (without it
    the session's shuffle partitions), so that many make a task small; 0 leaves a pool as it
    is, where it is dealt by ``question_id`` already and ``by`` is empty.
    """
    settings, by = settings or Settings(), by or []
    row_types, methods = row_types or ROW_TYPES, methods or [*FIXED, *DYNAMIC]
    if phase not in PHASES:
        raise ValueError(f"the phase is one of {PHASES}")
    if (phase == "test") != (artifact is not None):
        raise ValueError("the test phase, and only it, takes an artifact")
    rules, key = [m for m in DYNAMIC if m in methods], [*by, "question_id"]
    series = _wanted_series(settings, phase, row_types) if rules else []
    budgets = sorted(set(settings.budgets)) if "fixed_budget" in row_types else []
    most = max([*budgets, *(x.cap for x in series), 1])
    kinds = {"c": folds.exact(dict(pool.dtypes)["confidence"], most), "n": folds.exact(dict(pool.dtypes)[certainty], most)}
    spark, wanted = pool.sparkSession, []
    # folds take far longer than a shuffle of plain samples, so these are dealt before they grow
    if tasks != 0:
        pool = pool.select(*dict.fromkeys([*key, "pos", "answer", "confidence", certainty])).repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), *key)
    rows = expected.select(*key, "gold").join(folds.question_rows(pool, key, most, settings.min_valid, certainty).hint("merge"), key, "left")
    specs = [_spec(TOTALS, 0, {})]
    if budgets:
        specs.append(_spec(FIXED_SERIES, 0, {}))
        wanted = [(FIXED_SERIES, m, i, float(b), b, None) for m in FIXED if m in methods for i, b in enumerate(budgets)]
    if phase == "test":
        given = _chosen(artifact, by, list(settings.targets), rules)
        rows = rows.join(F.broadcast(given), by, "left") if by else rows.crossJoin(F.broadcast(given))
    else:
        rows = rows.withColumn("chosen", F.lit(None))
    for one in series:
        if phase == "test":
            grids = {m: _grid_of(m, one.target) for m in rules}
        else:
            grids = {m: F.array(*map(F.lit, _parameters(settings, m, one.cap))) for m in rules}
            wanted += [(one.name, m, i, p, one.cap, one.target) for m in rules for i, p in enumerate(_parameters(settings, m, one.cap))]
        specs.append(_spec(one.name, one.cap, grids))
    # a row for each group of report rows, so that rules are said once for all caps
    seen, flag = F.col("samples").isNotNull(), lambda c: c.cast("long")
    rows = rows.select(*by, "gold", "size", "samples", "chosen", F.explode(F.array(*specs)).alias("spec")).withColumn("series", F.col("spec.series")).where(seen | (F.col("series") == TOTALS))
    rows = rows.withColumn("prefix", F.slice("samples", F.lit(1), F.col("spec.cap")))
    rows = rows.withColumn("voted", folds.winner(F.col("prefix"), lambda x: x["c"], kinds["c"]))
    total = _entry("", F.lit(0), F.array(F.lit(1).cast("long"), flag(seen), flag(F.col("gold").isNull()), *[F.lit(0).cast("long")] * 3))
    entries = F.when(F.col("series") == TOTALS, F.array(total))
    if budgets:
        entries = entries.when(F.col("series") == FIXED_SERIES, _fixed_entries(settings, methods, kinds, certainty == "confidence"))
    if series:
        entries = entries.otherwise(_rule_entries(rules, settings, kinds["c"]))
    rows = rows.withColumn("entries", entries)
    named = ", ".join(KEYS)
    if phase == "test":  # a grid is one parameter, which the artifact's map has for the entry
        target = F.substring_index("series", ":", -1)
        own = F.transform("entries", lambda e: F.struct(e["method"], e["at"], e["m"], F.try_element_at("chosen", F.concat_ws(":", e["method"], target)).alias("v")))
        each = rows.select(*by, "series", "spec.cap", F.explode(own).alias("e"))
        at_target = F.when(F.col("series").startswith("match:"), F.substring_index("series", ":", -1)).cast("long")
        rows = each.select(*by, "series", F.array("e").alias("entries"), F.struct(F.when(F.col("e.at") == 0, F.col("e.v.parameter")).alias("parameter"), F.col("cap").cast("long").alias("cap"), at_target.alias("target"), F.col("e.v.before").alias("before")).alias("key"))
    else:
        rows = rows.withColumn("key", F.lit(None).cast(f"struct<{named.replace(' ', ':').replace(',:', ',')}>"))
    frame = spark.createDataFrame(wanted, "series string, method string, at int, parameter double, cap long, target long") if wanted else None
    if by and wanted:
        frame = expected.select(*by).distinct().crossJoin(F.broadcast(frame))
    report = report_rows(_summed(rows, frame, by, F.col("key")))
    return with_columns(_shown(report, by, phase), by)


def unmatched(report: DataFrame, settings: Settings) -> DataFrame:
    """``method, target`` without exactly one match in a report."""
    spark = report.sparkSession
    wanted = spark.createDataFrame([(m, t) for m in DYNAMIC for t in settings.targets], "method string, target long")
    found = report.where("row_type = 'dynamic_budget_match'").groupBy("method", F.col("budget_target").alias("target")).agg(F.count("*").alias("n"))
    return wanted.join(found, ["method", "target"], "left").where(F.coalesce("n", F.lit(0)) != 1).select("method", "target")


def calibration_artifact(report: DataFrame, settings: Settings, model: str, dataset: str, now: bool = True) -> DataFrame:
    """The parameters that a validation report chose, for use on a test pool.

    One row for each method and target (else an error), scoped to a model and a data set.
    With ``now`` the error comes at once, which runs the report; else when rows are read.
    """
    if not model.strip() or not dataset.strip():
        raise ValueError("an artifact is of a model and a data set")
    if now and (lost := unmatched(report, settings).collect()):
        raise ValueError(f"not exactly one match for {sorted((r.method, r.target) for r in lost)}")
    found = report.where("row_type = 'dynamic_budget_match' AND selection_split = 'validation'")
    wanted = report.sparkSession.createDataFrame([(m, t) for m in DYNAMIC for t in settings.targets], "method string, budget_target long")
    one = F.count("row_type").over(Window.partitionBy("method", "budget_target")) == 1
    wrong = F.raise_error(F.concat(F.lit("not exactly one match for "), F.col("method"), F.lit(" at "), F.col("budget_target").cast("string")))
    rows = wanted.join(found, ["method", "budget_target"], "left").withColumn("method", F.when(one, F.col("method")).otherwise(wrong))
    return rows.select(
        F.lit(model).alias("model_id"), F.lit(dataset).alias("dataset_name"), "method", "budget_target", "parameter_type", F.coalesce(F.col("window_size").cast("double"), F.col("threshold")).alias("parameter"), "budget_cap",
        F.lit(settings.cap).cast("long").alias("cap"), F.lit(settings.min_valid).cast("long").alias("min_valid"), F.lit(settings.buffer_size).cast("long").alias("buffer_size"),
        F.col("actual_avg_samples").alias("validation_actual_avg_samples"), F.col("valid_samples").alias("validation_valid_samples"), F.col("invalid_rate").alias("validation_invalid_rate"),
    )


def scope_violations(artifact: DataFrame, settings: Settings, model: str, dataset: str) -> DataFrame:
    """``rule, method, target`` of artifact rows of another model, data set or setting."""
    wrong = F.when(F.col("model_id") != model, "other_model").when(F.col("dataset_name") != dataset, "other_dataset").when(F.col("cap") != settings.cap, "other_cap").when(F.col("min_valid") != settings.min_valid, "other_min_valid").when(F.col("buffer_size") != settings.buffer_size, "other_buffer")
    rows = artifact.withColumn("rule", wrong).where("rule IS NOT NULL").select("rule", "method", F.col("budget_target").alias("target"))
    checked = artifact.select("method", F.col("budget_target").alias("target"), "parameter", "parameter_type", "cap")
    return rows.unionByName(selection.artifact_violations(checked, DYNAMIC, list(settings.targets), settings.cap))


def method_metadata(pool: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """Per method: rows with a native score, the fields they have it in, and ``exact`` or
    ``proxy``. ``fields``: score columns of a method, the first one present counting."""
    spark = pool.sparkSession
    out = None
    for method, names in fields.items():
        there = [c for c in names if c in pool.columns]
        first = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in there]) if there else F.lit(None).cast("string")
        one = pool.select(first.alias("f")).agg(F.count("f").alias("native_records"), F.array_sort(F.collect_set("f")).alias("native_fields"))
        one = one.select(F.lit(method).alias("method"), "native_records", "native_fields", F.when(F.col("native_records") > 0, "exact").otherwise("proxy").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "method string, native_records long, native_fields array<string>, status string")


def by_method(report: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Report rows sorted by the methods' order; a method not in it is an error."""
    order = order or [*FIXED, *DYNAMIC]
    place = F.array_position(F.array(*map(F.lit, order)), F.col("method"))
    checked = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("unknown method "), F.col("method"))))
    return report.withColumn("_o", checked).orderBy("_o", "row_type", "budget_target", "budget", "threshold").drop("_o")


def joined_reports(left: DataFrame, right: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Two reports side by side with differences; what only the left one has stays, with
    null differences."""
    other = right.select(*keys, *(F.col(m).alias(f"{m}_after") for m in metrics))
    rows = left.select(*keys, *(F.col(m).alias(f"{m}_before") for m in metrics)).join(other, keys, "left")
    return rows.select("*", *((F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in metrics))
