"""Fixed-budget votes, early-stopping curves and budget matching over the adapter pools."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.operators import stopping as E
from plurality.operators import votes as V
from plurality.plans.registry import query
from plurality.sources.adapters import events_pool, gold, pool

BUDGETS = [1, 2, 4, 8, 16, 32]
GRID = [i / 100 for i in range(101)]
CAP = 32

PREFIX_SQL = """sized AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS size FROM pool),
prefix AS (SELECT s.*, budget FROM sized s, (VALUES (1), (2), (4), (8), (16), (32)) b(budget) WHERE pos < budget)"""


def _winner_sql(weight: str, where: str = "TRUE") -> str:
    return f"""WITH {PREFIX_SQL}, sums AS (SELECT question_id, budget, answer, sum({weight}) AS w, min(pos) AS first FROM prefix WHERE answer IS NOT NULL AND {where} GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id, budget ORDER BY w DESC, first) AS r FROM sums), {OUTCOME_SQL}"""


OUTCOME_SQL = """frame AS (SELECT question_id, CAST(budget AS BIGINT) AS budget, max(size) AS size FROM prefix GROUP BY ALL)
SELECT f.question_id, f.budget, CASE WHEN f.size >= f.budget THEN b.answer END AS prediction, least(f.size, f.budget) AS used,
  CASE WHEN f.size < f.budget THEN 'insufficient_samples' WHEN b.answer IS NULL THEN 'no_valid_answer' ELSE 'ok' END AS status
FROM frame f LEFT JOIN best b ON f.question_id = b.question_id AND f.budget = b.budget AND b.r = 1"""


@query(_winner_sql("1"))
def vote_majority_fixed(spark, sf_dir):
    return V.majority(pool(spark, sf_dir), BUDGETS)


@query(_winner_sql("confidence", "confidence IS NOT NULL"))
def vote_weighted_fixed(spark, sf_dir):
    return V.sum_vote(pool(spark, sf_dir), BUDGETS, F.col("confidence"))


def _informed_sql(weight: str) -> str:
    return f"""WITH {PREFIX_SQL}, scaled AS (SELECT *, CAST(round({weight}, 12) AS DECIMAL(20,12)) AS weight FROM (
    SELECT *, CAST(confidence AS DOUBLE) AS c, max(CAST(confidence AS DOUBLE)) OVER p AS hi, min(CAST(confidence AS DOUBLE)) OVER p AS lo FROM prefix
    WHERE answer IS NOT NULL AND confidence IS NOT NULL WINDOW p AS (PARTITION BY question_id, budget))),
sums AS (SELECT question_id, budget, answer, sum(weight) AS w, min(pos) AS first FROM scaled GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id, budget ORDER BY w DESC, first) AS r FROM sums), {OUTCOME_SQL}"""


@query(_informed_sql("exp((c - hi) / 1.0)"))
def vote_informed_softmax(spark, sf_dir):
    return V.informed_vote(pool(spark, sf_dir), BUDGETS, F.col("confidence"), scale="softmax")


@query(_informed_sql("(c - lo) * 2.0 + 1"))
def vote_informed_linear(spark, sf_dir):
    return V.informed_vote(pool(spark, sf_dir), BUDGETS, F.col("confidence"), temperature=2.0, scale="linear")


@query(_informed_sql("c"))
def vote_informed_plain(spark, sf_dir):
    return V.informed_vote(pool(spark, sf_dir), BUDGETS, F.col("confidence"), scale="none")


@query(f"""WITH {PREFIX_SQL}, best AS (SELECT question_id, budget, answer, row_number() OVER (PARTITION BY question_id, budget ORDER BY confidence DESC, pos) AS r FROM prefix WHERE answer IS NOT NULL AND confidence IS NOT NULL), {OUTCOME_SQL}""")
def best_of_n_fixed(spark, sf_dir):
    return V.best_sample(pool(spark, sf_dir), BUDGETS, F.col("confidence"))


@query(f"""WITH {PREFIX_SQL}, sums AS (SELECT question_id, budget, answer, count(*) AS w, min(pos) AS first FROM prefix WHERE answer IS NOT NULL GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id, budget ORDER BY w DESC, first) AS r FROM sums), size AS (SELECT question_id, count(*) AS size FROM pool GROUP BY ALL),
preds AS (SELECT s.question_id, b.budget, s.size, x.answer FROM size s, (VALUES (1), (2), (4), (8), (16), (32)) b(budget) LEFT JOIN best x ON x.question_id = s.question_id AND x.budget = b.budget AND x.r = 1)
SELECT CAST(b.budget AS BIGINT) AS budget, count(*) AS questions, count(*) FILTER (WHERE p.size >= p.budget AND p.answer = g.gold) AS correct, count(*) FILTER (WHERE p.size >= p.budget AND p.answer IS NOT NULL) AS valid,
  CAST(sum(coalesce(least(p.size, p.budget), 0)) AS BIGINT) AS used, count(*) FILTER (WHERE p.size < p.budget) AS insufficient,
  round(count(*) FILTER (WHERE p.size >= p.budget AND p.answer = g.gold) / count(*), 6) AS accuracy, round(sum(coalesce(least(p.size, p.budget), 0)) / count(*), 6) AS average_used
FROM gold g CROSS JOIN (VALUES (1), (2), (4), (8), (16), (32)) b(budget) LEFT JOIN preds p ON p.question_id = g.question_id AND p.budget = b.budget GROUP BY b.budget""")
def strict_score(spark, sf_dir):
    out = V.strict_score(V.majority(pool(spark, sf_dir), BUDGETS), gold(spark, sf_dir), ["budget"])
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("average_used", F.round("average_used", 6))


def _running_sql(weight: str) -> str:
    """Votes after each row from a self-join of prefixes: slow, and plain to read."""
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS size FROM pool), capped AS (SELECT * FROM sized WHERE pos < {CAP}),
voting AS (SELECT *, {weight} AS w FROM capped WHERE answer IS NOT NULL AND {weight} >= 0),
votes AS (SELECT c.question_id, c.pos, v.answer, sum(v.w) AS mass, min(v.pos) AS first, count(*) AS n FROM capped c JOIN voting v ON v.question_id = c.question_id AND v.pos <= c.pos GROUP BY ALL),
states AS (SELECT question_id, pos, sum(n) OVER q AS valid, sum(mass) OVER q AS total, mass, answer, row_number() OVER (PARTITION BY question_id, pos ORDER BY mass DESC, first) AS r FROM votes WINDOW q AS (PARTITION BY question_id, pos)),
leaders AS (SELECT question_id, pos, valid, answer AS leader, CASE WHEN total > 0 THEN CAST(mass AS DOUBLE) / CAST(total AS DOUBLE) ELSE 0 END AS share FROM states WHERE r = 1)"""


GRID_SQL = "grid AS (SELECT i / 100 AS parameter FROM range(0, 101) t(i))"
CURVE_SQL = """SELECT g2.parameter, count(*) AS questions, count(*) FILTER (WHERE prediction = g.gold) AS correct, CAST(sum(coalesce(used, 0)) AS BIGINT) AS used, count(*) FILTER (WHERE status = 'early_stop') AS early
FROM gold g CROSS JOIN (SELECT DISTINCT parameter FROM grid) g2 LEFT JOIN decided d ON d.question_id = g.question_id AND d.parameter = g2.parameter GROUP BY g2.parameter"""
#: stops(question_id, parameter, pos, answer) and final(question_id, answer) to decisions
DECIDED_SQL = f"""sizes AS (SELECT question_id, max(size) AS size FROM capped GROUP BY ALL),
decided AS (SELECT z.question_id, g.parameter, CASE WHEN s.pos IS NOT NULL THEN s.answer WHEN z.size >= {CAP} THEN f.answer END AS prediction,
  CASE WHEN s.pos IS NOT NULL THEN s.pos + 1 WHEN z.size < {CAP} THEN z.size ELSE {CAP} END AS used, CASE WHEN s.pos IS NOT NULL THEN 'early_stop' WHEN z.size < {CAP} THEN 'insufficient_samples' WHEN f.answer IS NULL THEN 'no_valid_answer' ELSE 'ok' END AS status
  FROM sizes z CROSS JOIN grid g LEFT JOIN stops s ON s.question_id = z.question_id AND s.parameter = g.parameter LEFT JOIN final f ON f.question_id = z.question_id)"""


def _adaptive_sql(weight: str) -> str:
    return f"""WITH {_running_sql(weight)}, {GRID_SQL},
stops AS (SELECT question_id, parameter, min(pos) AS pos, arg_min(leader, pos) AS answer FROM leaders, grid WHERE valid >= 2 AND share >= parameter GROUP BY ALL),
final AS (SELECT question_id, arg_max(leader, pos) AS answer FROM leaders GROUP BY ALL), {DECIDED_SQL}
{CURVE_SQL}"""


def _adaptive(spark, sf_dir, weight):
    return E.curve(E.adaptive(pool(spark, sf_dir), CAP, GRID, weight), gold(spark, sf_dir), GRID)


@query(_adaptive_sql("1"))
def adaptive_count_curve(spark, sf_dir):
    return _adaptive(spark, sf_dir, F.lit(1))


@query(_adaptive_sql("confidence"))
def adaptive_weighted_curve(spark, sf_dir):
    return _adaptive(spark, sf_dir, F.col("confidence"))


SCORED_SQL = f"""sized AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS size FROM pool), capped AS (SELECT * FROM sized WHERE pos < {CAP}),
voting AS (SELECT * FROM capped WHERE answer IS NOT NULL AND confidence IS NOT NULL),
tally AS (SELECT question_id, answer, sum(confidence) AS w, min(pos) AS first FROM voting GROUP BY ALL),
final AS (SELECT question_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY w DESC, first) AS r FROM tally) WHERE r = 1)"""


@query(f"""WITH {SCORED_SQL}, {GRID_SQL}, stops AS (SELECT question_id, parameter, min(pos) AS pos, arg_min(answer, pos) AS answer FROM voting, grid WHERE CAST(confidence AS DOUBLE) >= parameter GROUP BY ALL), {DECIDED_SQL}
{CURVE_SQL}""")
def confident_stop_curve(spark, sf_dir):
    return E.curve(E.confident(pool(spark, sf_dir), CAP, GRID, F.col("confidence")), gold(spark, sf_dir), GRID)


SIZES = list(range(2, CAP + 1))


@query(f"""WITH sized AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS size FROM pool), grid AS (SELECT CAST(i AS DOUBLE) AS parameter FROM range(2, {CAP + 1}) t(i)),
capped AS (SELECT * FROM sized, grid WHERE pos < {CAP}),
windows AS (SELECT question_id, parameter, floor(pos / parameter) AS win, min(answer) AS answer FROM capped GROUP BY ALL HAVING count(*) = parameter AND count(answer) = parameter AND count(DISTINCT answer) = 1),
stops AS (SELECT question_id, parameter, min(win) AS win, arg_min(answer, win) AS answer FROM windows GROUP BY ALL),
usable AS (SELECT question_id, parameter, max(size) AS size, floor(least(max(size), {CAP}) / parameter) * parameter AS usable FROM capped GROUP BY question_id, parameter),
tally AS (SELECT c.question_id, c.parameter, answer, count(*) AS w, min(pos) AS first FROM capped c JOIN usable u ON c.question_id = u.question_id AND c.parameter = u.parameter WHERE pos < usable AND answer IS NOT NULL GROUP BY ALL),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, parameter ORDER BY w DESC, first) AS r FROM tally) WHERE r = 1),
decided AS (SELECT u.question_id, u.parameter, CASE WHEN s.win IS NOT NULL THEN s.answer WHEN u.size >= {CAP} THEN f.answer END AS prediction,
  CASE WHEN s.win IS NOT NULL THEN (s.win + 1) * u.parameter WHEN u.size < {CAP} THEN u.size ELSE u.usable END AS used, CASE WHEN s.win IS NOT NULL THEN 'early_stop' ELSE 'other' END AS status
  FROM usable u LEFT JOIN stops s ON s.question_id = u.question_id AND s.parameter = u.parameter LEFT JOIN final f ON f.question_id = u.question_id AND f.parameter = u.parameter)
{CURVE_SQL}""")
def unanimous_window_curve(spark, sf_dir):
    return E.window_curve(pool(spark, sf_dir), CAP, SIZES, gold(spark, sf_dir))


@query(f"""WITH {SCORED_SQL}, {GRID_SQL}, entered AS (SELECT *, row_number() OVER (PARTITION BY question_id, parameter ORDER BY pos) AS slot FROM voting, grid WHERE CAST(confidence AS DOUBLE) >= parameter),
kept AS (SELECT * FROM entered WHERE slot <= 5), ended AS (SELECT question_id, parameter, pos FROM kept WHERE slot = 5),
sums AS (SELECT question_id, parameter, answer, sum(confidence) AS w, min(pos) AS first FROM kept GROUP BY ALL), lead AS (SELECT *, row_number() OVER (PARTITION BY question_id, parameter ORDER BY w DESC, first) AS r FROM sums),
stops AS (SELECT e.question_id, e.parameter, e.pos, l.answer FROM ended e JOIN lead l ON l.question_id = e.question_id AND l.parameter = e.parameter AND l.r = 1), {DECIDED_SQL}
{CURVE_SQL}""")
def buffered_stop_curve(spark, sf_dir):
    return E.curve(E.buffered(pool(spark, sf_dir), CAP, GRID, F.col("confidence")), gold(spark, sf_dir), GRID)


@query(f"""WITH {_running_sql("1").replace("FROM pool", "FROM events_pool")}, grid AS (SELECT * FROM (VALUES (0.4), (0.5), (0.75)) t(parameter)),
stops AS (SELECT question_id, parameter, min(pos) AS pos, arg_min(leader, pos) AS answer FROM leaders, grid WHERE valid >= 2 AND share >= parameter GROUP BY ALL),
final AS (SELECT question_id, arg_max(leader, pos) AS answer FROM leaders GROUP BY ALL), {DECIDED_SQL}
SELECT question_id, CAST(parameter AS DOUBLE) AS parameter, prediction, used, status FROM decided""")
def adaptive_event_predictions(spark, sf_dir):
    grid = [0.4, 0.5, 0.75]
    return E.outcomes(E.adaptive(events_pool(spark, sf_dir), CAP, grid, F.lit(1)), grid)


@query(f"""WITH {_running_sql("1")}, {GRID_SQL},
stops AS (SELECT question_id, parameter, min(pos) AS pos, arg_min(leader, pos) AS answer FROM leaders, grid WHERE valid >= 2 AND share >= parameter GROUP BY ALL),
final AS (SELECT question_id, arg_max(leader, pos) AS answer FROM leaders GROUP BY ALL), {DECIDED_SQL}, curve AS ({CURVE_SQL}),
gaps AS (SELECT target, parameter, used / questions AS average_used, correct, row_number() OVER (PARTITION BY target ORDER BY target - used / questions, parameter) AS r FROM curve, (VALUES (4), (8), (16)) t(target) WHERE used / questions <= target + 1e-12)
SELECT CAST(target AS BIGINT) AS target, parameter, round(average_used, 6) AS average_used, correct FROM gaps WHERE r = 1""")
def budget_match(spark, sf_dir):
    from plurality.operators.selection import match_budgets

    curve = _adaptive(spark, sf_dir, F.lit(1))
    return match_budgets(curve, [4, 8, 16]).select("target", "parameter", F.round("average_used", 6).alias("average_used"), "correct")
