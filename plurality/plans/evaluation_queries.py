"""The whole evaluation, its artifact and its use on other questions, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.operators import evaluation as V
from plurality.operators import reaggregation
from plurality.plans import vote_queries as Q
from plurality.plans.registry import ORACLES, query
from plurality.sources.adapters import gold, pool, read, tasks

SETTINGS = V.Settings(budgets=(1, 4, 16), thresholds=tuple(i / 10 for i in range(11)), targets=(8,))
GRID_SQL = "grid AS (SELECT i / 10 AS parameter FROM range(0, 11) t(i))"


def _capped(sql: str, cap: int) -> str:
    return sql.replace(f"pos < {Q.CAP}", f"pos < {cap}").replace(f"size >= {Q.CAP}", f"size >= {cap}").replace(f"size < {Q.CAP}", f"size < {cap}").replace(f"ELSE {Q.CAP} END", f"ELSE {cap} END").replace(f"range(2, {Q.CAP + 1})", f"range(2, {cap + 1})").replace(f"max(size), {Q.CAP})", f"max(size), {cap})").replace("'other'", f"CASE WHEN u.size < {cap} THEN 'insufficient_samples' ELSE 'ok' END")


def _dynamic_sql(cap: int) -> str:
    """``method, question_id, parameter, prediction, used, status`` of the five methods."""
    asc = lambda w: f"""WITH {Q._running_sql(w)}, {GRID_SQL},
stops AS (SELECT question_id, parameter, min(pos) AS pos, arg_min(leader, pos) AS answer FROM leaders, grid WHERE valid >= 2 AND share >= parameter GROUP BY ALL),
final AS (SELECT question_id, arg_max(leader, pos) AS answer FROM leaders GROUP BY ALL), {Q.DECIDED_SQL}"""  # noqa: E731
    confident = f"""WITH {Q.SCORED_SQL}, {GRID_SQL}, stops AS (SELECT question_id, parameter, min(pos) AS pos, arg_min(answer, pos) AS answer FROM voting, grid WHERE CAST(confidence AS DOUBLE) >= parameter GROUP BY ALL), {Q.DECIDED_SQL}"""
    own = lambda name: ORACLES[name][ORACLES[name].index("sized AS") :].rsplit(Q.CURVE_SQL, 1)[0]
    parts = {"confident-stop": confident, "ASC": asc("1"), "weighted-ASC": asc("confidence"), "ESC": "WITH " + own("unanimous_window_curve"), "RASC": "WITH " + own("buffered_stop_curve").replace(Q.GRID_SQL, GRID_SQL)}
    return " UNION ALL ".join(f"SELECT '{m}' AS method, question_id, CAST(parameter AS DOUBLE) AS parameter, prediction, CAST(used AS BIGINT) AS used, status FROM ({_capped(sql, cap)} SELECT * FROM decided)" for m, sql in parts.items())


def _fixed_sql() -> str:
    prefix = Q.PREFIX_SQL.replace("(VALUES (1), (2), (4), (8), (16), (32))", "(VALUES (1), (4), (16))")
    vote = lambda w, where: Q._winner_sql(w, where).replace(Q.PREFIX_SQL, prefix)
    informed = Q._informed_sql("exp((c - hi) / 1.0)").replace(Q.PREFIX_SQL, prefix)
    best = f"WITH {prefix}, best AS (SELECT question_id, budget, answer, row_number() OVER (PARTITION BY question_id, budget ORDER BY confidence DESC, pos) AS r FROM prefix WHERE answer IS NOT NULL AND confidence IS NOT NULL), {Q.OUTCOME_SQL}"
    parts = {"SC": vote("1", "TRUE"), "CISC": informed, "Self-Certainty": vote("confidence", "confidence IS NOT NULL"), "Best-of-N": best, "weighted-SC": vote("confidence", "confidence IS NOT NULL")}
    return " UNION ALL ".join(f"SELECT '{m}' AS method, question_id, CAST(budget AS DOUBLE) AS parameter, prediction, CAST(used AS BIGINT) AS used, status FROM ({sql})" for m, sql in parts.items())


def _rows_sql(name: str, decided: str, expected: str) -> str:
    """Report measures of decisions over expected questions, every one of them counted."""
    return f"""{name}_decided AS ({decided}), {name} AS (
  SELECT p.method, p.parameter, count(*) AS questions_total, count(f.answered) AS questions_observed, count(*) FILTER (WHERE d.prediction = e.gold) AS correct,
    CAST(sum(coalesce(d.used, 0)) AS BIGINT) AS generated_samples, CAST(sum(len(list_filter(coalesce(f.answered, []), lambda p: p < coalesce(d.used, 0)))) AS BIGINT) AS valid_samples,
    count(*) FILTER (WHERE d.prediction IS NULL) AS invalid_predictions, count(*) FILTER (WHERE d.status IS NULL OR d.status = 'insufficient_samples') AS insufficient_sample_questions, count(*) FILTER (WHERE d.status = 'early_stop') AS early_stop_questions
  FROM {expected} e CROSS JOIN (SELECT DISTINCT method, parameter FROM {name}_decided) p
  LEFT JOIN {name}_decided d ON d.question_id = e.question_id AND d.method = p.method AND d.parameter = p.parameter LEFT JOIN answered f ON f.question_id = e.question_id GROUP BY ALL)"""


ANSWERED_SQL = "answered AS (SELECT question_id, coalesce(list(pos) FILTER (WHERE answer IS NOT NULL), []) AS answered FROM pool GROUP BY question_id)"
SHOWN = ["row_type", "method", "budget", "budget_target", "budget_cap", "threshold", "window_size", "questions_total", "questions_observed", "correct", "generated_samples", "valid_samples", "invalid_predictions", "insufficient_sample_questions", "early_stop_questions"]
SUMS = ", ".join(SHOWN[7:])
ROUNDED = "round(correct / questions_total, 6) AS accuracy, round(generated_samples / questions_total, 6) AS actual_avg_samples, round((generated_samples - valid_samples) / generated_samples, 6) AS invalid_rate"
WINDOW = "CASE WHEN method = 'ESC' THEN CAST(parameter AS BIGINT) END AS window_size"
MATCH_SQL = "(SELECT *, row_number() OVER (PARTITION BY method ORDER BY 8 - generated_samples / questions_total, parameter) AS r FROM capped_rows WHERE generated_samples / questions_total <= 8 + 1e-12)"


def _shown(report, *more):
    return report.select(*more, *SHOWN, *(F.round(c, 6).alias(c) for c in ("accuracy", "actual_avg_samples", "invalid_rate")))


@query(f"""WITH {ANSWERED_SQL}, {_rows_sql("fixed_rows", _fixed_sql(), "gold")}, {_rows_sql("curve_rows", _dynamic_sql(32), "gold")}, {_rows_sql("capped_rows", _dynamic_sql(8), "gold")}
SELECT 'fixed_budget' AS row_type, method, CAST(parameter AS BIGINT) AS budget, NULL::BIGINT AS budget_target, CAST(parameter AS BIGINT) AS budget_cap, NULL::DOUBLE AS threshold, NULL::BIGINT AS window_size, {SUMS}, {ROUNDED} FROM fixed_rows
UNION ALL SELECT 'threshold_curve', method, NULL, NULL, 32, parameter, {WINDOW}, {SUMS}, {ROUNDED} FROM curve_rows
UNION ALL SELECT 'dynamic_budget_match', method, 8, 8, 8, parameter, {WINDOW}, {SUMS}, {ROUNDED} FROM {MATCH_SQL} WHERE r = 1""")
def evaluation_report(spark, sf_dir):
    return _shown(V.evaluate(pool(spark, sf_dir), gold(spark, sf_dir), SETTINGS, "validation", tasks=0))


def _by_model(sql: str) -> str:
    return sql.replace("SELECT p.method", "SELECT CAST(e.question_id % 3 AS VARCHAR) AS model, p.method")


@query(f"""WITH {ANSWERED_SQL}, {_by_model(_rows_sql("fixed_rows", _fixed_sql(), "gold"))}, {_by_model(_rows_sql("capped_rows", _dynamic_sql(8), "gold"))}
SELECT 'fixed_budget' AS row_type, model, method, CAST(parameter AS BIGINT) AS budget, NULL::DOUBLE AS threshold, {SUMS}, {ROUNDED} FROM fixed_rows
UNION ALL SELECT 'dynamic_budget_match', model, method, 8, parameter, {SUMS}, {ROUNDED} FROM {MATCH_SQL.replace("PARTITION BY method", "PARTITION BY model, method")} WHERE r = 1""")
def reports_by_model(spark, sf_dir):
    """Three models, each with questions of its own, in one pass."""
    model = (F.col("question_id") % 3).cast("string")
    pools, expected = (x.withColumn("model", model) for x in (pool(spark, sf_dir), gold(spark, sf_dir)))
    out = reaggregation.reports(pools, expected, SETTINGS, "validation", parts=["model"], row_types=["fixed_budget", "dynamic_budget_match"], tasks=tasks(read(spark, sf_dir, "lineitem")))
    return _shown(out, "model").drop("budget_target", "budget_cap", "window_size")


def _split(spark, sf_dir):
    rows, truth = pool(spark, sf_dir), gold(spark, sf_dir)
    half = F.col("question_id") % 2
    return (rows.where(half == 0), truth.where(half == 0)), (rows.where(half == 1), truth.where(half == 1))


def _artifact(rows, truth):
    report = V.evaluate(rows, truth, SETTINGS, "validation", row_types=["dynamic_budget_match"], tasks=0)
    return V.calibration_artifact(report, SETTINGS, "m", "d", now=False)


HALF_SQL = "half AS (SELECT * FROM gold WHERE question_id % 2 = 0), other AS (SELECT * FROM gold WHERE question_id % 2 = 1)"


@query(f"""WITH {HALF_SQL}, {ANSWERED_SQL}, {_rows_sql("capped_rows", _dynamic_sql(8), "half")}
SELECT 'm' AS model_id, 'd' AS dataset_name, method, CAST(8 AS BIGINT) AS budget_target, CASE WHEN method = 'ESC' THEN 'window_size' ELSE 'confidence_threshold' END AS parameter_type, parameter, CAST(8 AS BIGINT) AS budget_cap, CAST(32 AS BIGINT) AS cap,
  CAST(2 AS BIGINT) AS min_valid, CAST(5 AS BIGINT) AS buffer_size, round(generated_samples / questions_total, 6) AS validation_actual_avg_samples, valid_samples AS validation_valid_samples, round((generated_samples - valid_samples) / generated_samples, 6) AS validation_invalid_rate FROM {MATCH_SQL} WHERE r = 1""")
def calibration_artifact(spark, sf_dir):
    (rows, truth), _ = _split(spark, sf_dir)
    out = _artifact(rows, truth)
    return out.withColumn("validation_actual_avg_samples", F.round("validation_actual_avg_samples", 6)).withColumn("validation_invalid_rate", F.round("validation_invalid_rate", 6))


@query(f"""WITH {HALF_SQL}, {ANSWERED_SQL}, {_rows_sql("capped_rows", _dynamic_sql(8), "half")}, chosen AS (SELECT method, parameter, generated_samples / questions_total AS before FROM {MATCH_SQL} WHERE r = 1), {_rows_sql("test_rows", _dynamic_sql(8), "other")}
SELECT t.method, CAST(8 AS BIGINT) AS budget_target, t.parameter AS threshold, questions_total, correct, generated_samples, valid_samples, early_stop_questions, round(generated_samples / questions_total - 8, 6) AS budget_gap, generated_samples / questions_total <= 8 AS budget_compliant, round(before, 6) AS validation_actual_avg_samples
FROM test_rows t JOIN chosen c ON c.method = t.method AND c.parameter = t.parameter""")
def test_report(spark, sf_dir):
    (rows, truth), (other, other_truth) = _split(spark, sf_dir)
    out = V.evaluate(other, other_truth, SETTINGS, "test", _artifact(rows, truth), row_types=["dynamic_budget_match"], tasks=0).where("row_type = 'dynamic_budget_match'")
    return out.select("method", "budget_target", "threshold", "questions_total", "correct", "generated_samples", "valid_samples", "early_stop_questions", F.round("budget_gap", 6).alias("budget_gap"), "budget_compliant", F.round("validation_actual_avg_samples", 6).alias("validation_actual_avg_samples"))


@query("""WITH picked AS (SELECT *, CASE WHEN l_tax <> 0.07 THEN 'native' WHEN l_quantity > 25 THEN 'late' END AS f FROM lineitem)
SELECT 'CISC' AS method, count(f) AS native_records, list_sort(list(DISTINCT f) FILTER (WHERE f IS NOT NULL)) AS native_fields, CASE WHEN count(f) > 0 THEN 'exact' ELSE 'proxy' END AS status FROM picked
UNION ALL SELECT 'RASC', 0, [], 'proxy'""", views=False)
def method_metadata(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.when(F.col("l_tax") != 0.07, F.col("l_discount")).alias("native"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("late"))
    return V.method_metadata(rows, {"CISC": ["native", "late"], "RASC": ["absent"]})
