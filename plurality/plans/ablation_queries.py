"""Converters, ablation profiles, reparsing and training mixes over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.operators import profiles as P
from plurality.operators import reparse as R
from plurality.operators import sampling as T
from plurality.plans.registry import query
from plurality.sources import converters as C
from plurality.sources.adapters import gold, pool, read

KEY = "p_partkey"
OPTION_SHOWN = ["dataset_name", "source_index", "question_id", "stem", "options", "correct_index", "correct_answer", "failure"]


@query("""WITH base AS (SELECT p_partkey AS k, p_name AS w, p_size AS n FROM part),
rows_ AS (
  SELECT 'math_qa' AS dataset_name, k, 'Problem: ' || w AS stem, [CAST(n AS VARCHAR), 'two ' || k, 'none'] AS options, CASE k % 5 WHEN 4 THEN NULL ELSE CASE WHEN k % 5 = 3 THEN 2 ELSE k % 5 END END AS place FROM base WHERE k % 4 = 0
  UNION ALL SELECT 'sciq', k, 'Question: ' || w, list_transform(list_sort([{'t': 'b' || n, 'i': 0}, {'t': 'a', 'i': 1}, {'t': 'c', 'i': 2}, {'t': 'b' || (k % 50), 'i': 3}]), lambda x: x.t),
    list_position(list_transform(list_sort([{'t': 'b' || n, 'i': 0}, {'t': 'a', 'i': 1}, {'t': 'c', 'i': 2}, {'t': 'b' || (k % 50), 'i': 3}]), lambda x: x.i), 3) - 1 FROM base WHERE k % 4 = 1
  UNION ALL SELECT 'winogrande', k, 'Question: ' || w, ['left', 'right'], CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END FROM base WHERE k % 4 = 2
  UNION ALL SELECT 'arc_easy', k, 'Question: ' || w, ['x', 'y' || n, 'z'], CASE WHEN k % 3 < 2 THEN k % 3 END FROM base WHERE k % 4 = 3)
SELECT dataset_name, k AS source_index, dataset_name || ':train:' || k || ':' || substr(sha256(stem || chr(0) || array_to_string(options, chr(0))), 1, 12) AS question_id, stem, options, CAST(place AS BIGINT) AS correct_index, chr(CAST(65 + place AS INT)) AS correct_answer,
  CASE WHEN place IS NULL THEN 'answer not found' END AS failure FROM rows_""", views=False)
def convert_options(spark, sf_dir):
    part = read(spark, sf_dir, "part").withColumn("source_index", F.col(KEY))
    k, n, w = F.col(KEY), F.col("p_size").cast("string"), F.col("p_name")
    of = lambda i: part.where(k % 4 == i)
    text = lambda c: c.cast("string")
    joined = F.concat(F.lit("a ) "), n, F.lit(" , b ) two "), text(k), F.lit(", c) none"))
    right = F.when(k % 5 == 0, "a").when(k % 5 == 1, " B ").when(k % 5 == 2, "c").when(k % 5 == 3, "3").otherwise("q")
    frames = [
        C.convert(of(0).select("source_index", w.alias("Problem"), joined.alias("options"), right.alias("correct")), "math_qa", "train"),
        C.convert(of(1).select("source_index", F.concat(w, F.lit(" ")).alias("question"), F.concat(F.lit("b"), n).alias("distractor1"), F.lit("a").alias("distractor2"), F.lit("c").alias("distractor3"), F.concat(F.lit("b"), text(k % 50)).alias("correct_answer")), "sciq", "train"),
        C.convert(of(2).select("source_index", w.alias("sentence"), F.lit(" left").alias("option1"), F.lit("right").alias("option2"), F.when(k % 3 == 0, "1").when(k % 3 == 1, "b").otherwise("3").alias("answer")), "winogrande", "train"),
        C.convert(of(3).select("source_index", w.alias("question"), F.struct(F.array(*map(F.lit, "ABC")).alias("label"), F.array(F.lit("x"), F.concat(F.lit("y"), n), F.lit("z")).alias("text")).alias("choices"), F.when(k % 3 == 0, "a").when(k % 3 == 1, "2").otherwise("D").alias("answerKey")), "arc_easy", "train"),
    ]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame)
    return rows.select(*OPTION_SHOWN)


@query("""WITH base AS (SELECT o_orderkey AS k, o_orderpriority AS w FROM orders), rows_ AS (
  SELECT 'gsm8k' AS dataset_name, k, 'Question: ' || w AS stem, CASE k % 3 WHEN 0 THEN CAST(k AS VARCHAR) WHEN 1 THEN CAST(k AS VARCHAR) || '.5' END AS answer FROM base WHERE k % 2 = 0
  UNION ALL SELECT 'svamp', k, 'Question: ' || w || 'How many?', CASE WHEN k % 5 < 4 THEN CAST(k AS VARCHAR) END FROM base WHERE k % 2 = 1)
SELECT dataset_name, k AS source_index, dataset_name || ':test:' || k || ':' || substr(sha256(stem), 1, 12) AS question_id, stem, answer AS correct_answer, CASE WHEN answer IS NULL THEN 'no number' END AS failure FROM rows_""", views=False)
def convert_numbers(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("source_index", F.col("o_orderkey"))
    k, w = F.col("o_orderkey"), F.col("o_orderpriority")
    shown = F.when(k % 3 == 0, F.concat(F.lit("1 + 2\n#### $"), F.format_number(k, 0))).when(k % 3 == 1, F.concat(F.lit("so 7 then "), k.cast("string"), F.lit(".50"))).otherwise("none")
    a = C.convert(orders.where(k % 2 == 0).select("source_index", w.alias("question"), shown.alias("answer")), "gsm8k", "test")
    b = C.convert(orders.where(k % 2 == 1).select("source_index", w.alias("Body"), F.lit("How many?").alias("Question"), F.when(k % 5 < 4, F.concat(k.cast("string"), F.lit(".0"))).otherwise("few").alias("Answer")), "svamp", "test")
    return a.unionByName(b).select("dataset_name", "source_index", "question_id", "stem", "correct_answer", "failure")


NAMES = "CASE \"view\" WHEN 0 THEN 'identity' WHEN 1 THEN 'layout_wrapper' WHEN 2 THEN 'number_representation' ELSE 'equivalent_quantity' END"
PROFILES_SQL = "profiles(profile, subtype) AS (VALUES " + ", ".join(f"('{name}', '{s}')" for name, subtypes in P.PROFILES.items() for s in subtypes) + ")"


def _related(spark, sf_dir):
    """Views as relations: the subtype is given, or follows from the id or the type."""
    rows, view = pool(spark, sf_dir), F.col("view")
    given = F.when(view == 2, " Number_Representation ").otherwise("")
    kind = F.when(view == 1, "layout_wrapper").when(view == 0, "identity")
    name = F.when(view == 0, "g7").when(view == 3, "EQUIVALENT_quantity").otherwise("g1")
    return rows.withColumn("subtype", P.relation_subtype(given, name, kind))


@query(f"""WITH named AS (SELECT *, {NAMES} AS subtype FROM pool) SELECT subtype, count(*) AS samples, count(DISTINCT question_id) AS questions FROM named GROUP BY subtype""")
def relation_subtypes(spark, sf_dir):
    return _related(spark, sf_dir).groupBy("subtype").agg(F.count("*").alias("samples"), F.count_distinct("question_id").alias("questions"))


OBSERVED_SQL = f"""named AS (SELECT *, {NAMES} AS subtype FROM pool), {PROFILES_SQL},
chosen AS (SELECT p.profile, n.* FROM named n JOIN profiles p USING (subtype)),
tally AS (SELECT profile, question_id, answer, count(*) AS n, min(pos) AS first FROM chosen GROUP BY ALL),
won AS (SELECT *, row_number() OVER (PARTITION BY profile, question_id ORDER BY n DESC, first) AS r FROM tally WHERE answer IS NOT NULL),
sizes AS (SELECT profile, question_id, count(*) AS selected, count(answer) AS valid FROM chosen GROUP BY ALL),
own AS (SELECT s.profile, s.question_id, s.selected, s.valid, w.answer AS predicted, w.n / s.valid AS score, CASE WHEN w.answer IS NOT NULL THEN CAST(w.answer = g.gold AS INT) END AS correct
  FROM sizes s JOIN gold g USING (question_id) LEFT JOIN won w ON w.profile = s.profile AND w.question_id = s.question_id AND w.r = 1)"""


@query(f"WITH {OBSERVED_SQL} SELECT profile, question_id, selected, valid, predicted, round(score, 9) AS score, correct FROM own")
def profile_observations(spark, sf_dir):
    return P.profile_observations(_related(spark, sf_dir), gold(spark, sf_dir)).withColumn("score", F.round("score", 9))


def _matched_sql(name: str, mass: str, answer: str) -> str:
    """Winner of the first ``selected`` samples, one row for each profile and question."""
    return f"""{name}_sums AS (SELECT o.profile, o.question_id, {answer} AS a, sum({mass}) AS m, min(b.pos) AS first FROM sizes o JOIN pool b ON b.question_id = o.question_id AND b.pos < o.selected WHERE {answer} IS NOT NULL AND {mass} IS NOT NULL GROUP BY ALL),
{name} AS (SELECT x.profile, x.question_id, CASE WHEN a <> '<INVALID>' THEN a END AS predicted, CAST(m AS DOUBLE) / CAST(total AS DOUBLE) AS score, CAST(coalesce(a = g.gold, FALSE) AS INT) AS correct
  FROM (SELECT *, sum(m) OVER q AS total, row_number() OVER (PARTITION BY profile, question_id ORDER BY m DESC, first) AS r FROM {name}_sums WINDOW q AS (PARTITION BY profile, question_id)) x JOIN gold g USING (question_id) WHERE r = 1 AND total > 0)"""


EDGES = ", ".join(repr(i / 10) for i in range(11))
METRICS_SQL = """SELECT profile, method, n, round(accuracy, 6) AS accuracy, round(brier, 6) AS brier, round(ece_paper, 6) AS ece_paper, round(ece_strict, 6) AS ece_strict FROM (
  SELECT profile, method, count(*) AS n, 100 * avg(correct) AS accuracy, 100 * avg((score - correct) ** 2) AS brier FROM all_rows GROUP BY ALL) a
JOIN (SELECT profile, method, 100 * sum(CASE WHEN b < 10 THEN abs(c - s) ELSE 0 END) / sum(k) AS ece_paper FROM (SELECT profile, method, CASE WHEN score < 1 THEN len(list_filter(EDGELIST, lambda e: e <= score)) - 1 ELSE 10 END AS b, count(*) AS k, sum(correct) AS c, sum(score) AS s FROM all_rows GROUP BY ALL) GROUP BY ALL) USING (profile, method)
JOIN (SELECT profile, method, 100 * sum(abs(c - s)) / sum(k) AS ece_strict FROM (SELECT profile, method, least(floor(least(greatest(score, 0), 1) * 10), 9) AS b, count(*) AS k, sum(correct) AS c, sum(score) AS s FROM all_rows GROUP BY ALL) GROUP BY ALL) USING (profile, method)"""


def _decomposed_sql() -> str:
    from plurality.operators.metrics import edges

    four = ["scv", "ssv", "ssp"]
    inner = " ".join(f"JOIN {t} USING (profile, question_id)" for t in four)
    both = f"both_ AS (SELECT o.profile, o.question_id FROM own o {inner} WHERE o.predicted IS NOT NULL)"
    union = " UNION ALL ".join(f"SELECT profile, '{m}' AS method, question_id, score, correct FROM {t} JOIN both_ USING (profile, question_id)" for m, t in zip(["RelSC-profile", "SC-k-valid", "SSC-k-valid", "SSC-k-paper"], ["own", *four], strict=True))
    return f"""WITH {OBSERVED_SQL}, {_matched_sql("scv", "1", "b.answer")}, {_matched_sql("ssv", "b.confidence", "b.answer")}, {_matched_sql("ssp", "b.confidence", "coalesce(b.answer, '<INVALID>')")}, {both}, all_rows AS ({union}),
measured AS ({METRICS_SQL.replace("EDGELIST", "[" + ", ".join(repr(e) for e in edges(10)) + "]::DOUBLE[]")})"""


def _metrics(spark, sf_dir):
    rows = pool(spark, sf_dir)
    return P.metric_rows(P.decomposition(_related(spark, sf_dir), rows, gold(spark, sf_dir)), ["profile", "method"])


ROUNDED = ["accuracy", "brier", "ece_paper", "ece_strict"]


@query(f"{_decomposed_sql()} SELECT * FROM measured")
def profile_decomposition(spark, sf_dir):
    return _metrics(spark, sf_dir).select("profile", "method", "n", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(_decomposed_sql() + " " + " UNION ALL ".join(f"SELECT b.profile, '{e}' AS effect, " + ", ".join(f"round(b.{c} - a.{c}, 6) AS {c}" for c in ROUNDED) + f" FROM measured a JOIN measured b ON a.profile = b.profile AND a.method = '{x}' AND b.method = '{y}'" for e, x, y in P.EFFECTS))
def profile_effects(spark, sf_dir):
    table = _metrics(spark, sf_dir).select("profile", "method", *[F.round(c, 6).alias(c) for c in ROUNDED])
    return P.effects(table).select("profile", "effect", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(f"""WITH {OBSERVED_SQL}, {_matched_sql("equal_", "b.confidence", "coalesce(b.answer, '<INVALID>')")},
full_sums AS (SELECT question_id, coalesce(answer, '<INVALID>') AS a, sum(confidence) AS m, min(pos) AS first FROM pool WHERE confidence IS NOT NULL GROUP BY ALL),
full_ AS (SELECT question_id, CAST(m AS DOUBLE) / CAST(total AS DOUBLE) AS score, CAST(coalesce(a = g.gold, FALSE) AS INT) AS correct FROM (SELECT *, sum(m) OVER (PARTITION BY question_id) AS total, row_number() OVER (PARTITION BY question_id ORDER BY m DESC, first) AS r FROM full_sums) JOIN gold g USING (question_id) WHERE r = 1 AND total > 0),
means AS (SELECT profile, avg(selected) AS mean_selected, avg(valid) AS mean_valid FROM sizes s JOIN gold USING (question_id) GROUP BY ALL)
SELECT profile, count(*) AS n, round(any_value(mean_selected), 6) AS mean_selected, round(any_value(mean_valid), 6) AS mean_valid, round(100 * avg(o.correct), 6) AS accuracy, round(100 * (avg(o.correct) - avg(f.correct)), 6) AS delta_accuracy_full,
  round(100 * (avg((o.score - o.correct) ** 2) - avg((f.score - f.correct) ** 2)), 6) AS delta_brier_full, round(100 * (avg(o.correct) - avg(e.correct)), 6) AS delta_accuracy_equal, round(100 * (avg((o.score - o.correct) ** 2) - avg((e.score - e.correct) ** 2)), 6) AS delta_brier_equal
FROM own o JOIN full_ f USING (question_id) JOIN equal_ e USING (profile, question_id) JOIN means USING (profile) WHERE o.predicted IS NOT NULL GROUP BY profile""")
def profile_report(spark, sf_dir):
    out = P.profile_report(_related(spark, sf_dir), pool(spark, sf_dir), gold(spark, sf_dir))
    shown = ["mean_selected", "mean_valid", "accuracy", "delta_accuracy_full", "delta_brier_full", "delta_accuracy_equal", "delta_brier_equal"]
    return out.select("profile", "n", *[F.round(c, 6).alias(c) for c in shown])


@query("""WITH sized AS (SELECT *, count(*) OVER (PARTITION BY question_id) AS n FROM pool)
SELECT question_id, pos, answer AS predicted, CAST(confidence AS DOUBLE) AS score, CAST(coalesce(answer = g.gold, FALSE) AS INT) AS correct FROM sized JOIN gold g USING (question_id) WHERE pos = 37 % n AND confidence IS NOT NULL""")
def slot_observations(spark, sf_dir):
    return P.slot_observations(pool(spark, sf_dir), gold(spark, sf_dir), 37)


@query("""WITH seen AS (SELECT CASE WHEN question_id % 2 = 0 THEN 'gsm8k' ELSE 'svamp' END AS dataset, question_id % 4 AS m, confidence, coalesce(answer = g.gold, FALSE) AS ok FROM pool JOIN gold g USING (question_id) WHERE confidence IS NOT NULL),
rows_ AS (SELECT dataset, CASE m // 2 WHEN 0 THEN 'P(True)' ELSE 'other' END AS method, 100 * abs(avg(CAST(ok AS INT)) - avg(CAST(confidence AS DOUBLE))) AS ece FROM seen GROUP BY ALL)
SELECT dataset, method, round(ece, 6) AS ece, p AS published, round(ece - p, 6) AS delta FROM rows_ LEFT JOIN (VALUES ('gsm8k', 'P(True)', 12.03::DOUBLE), ('svamp', 'P(True)', 28.94::DOUBLE)) t(d, w, p) ON d = dataset AND w = method""")
def published_deltas(spark, sf_dir):
    rows = P.single_observations(pool(spark, sf_dir), gold(spark, sf_dir))
    half = F.floor(F.col("question_id") % 4 / 2)
    named = rows.groupBy(F.when(F.col("question_id") % 2 == 0, "gsm8k").otherwise("svamp").alias("dataset"), F.when(half == 0, "P(True)").otherwise("other").alias("method"))
    out = P.against_published(named.agg((100 * F.abs(F.avg("correct") - F.avg("score"))).alias("ece")))
    return out.select("dataset", "method", F.round("ece", 6).alias("ece"), "published", F.round("delta", 6).alias("delta"))


REPARSE_SQL = """base AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey % 3 AS d, (l_orderkey + l_linenumber) % 6 AS form FROM lineitem),
parsed AS (SELECT *, form IN (0, 1, 4) AS old_valid, form IN (0, 1, 2) AS new_valid, form = 1 AS changed FROM base)"""


@query(f"""WITH {REPARSE_SQL} SELECT d, count(*) AS samples, count(*) FILTER (WHERE old_valid) AS old_valid, count(*) FILTER (WHERE new_valid) AS strict_valid, count(*) FILTER (WHERE old_valid AND NOT new_valid) AS lost_by_strict,
  count(*) FILTER (WHERE NOT old_valid AND new_valid) AS recovered_by_strict, count(*) FILTER (WHERE old_valid AND new_valid AND changed) AS canonical_changed FROM parsed GROUP BY d""", views=False)
def strict_reparse(spark, sf_dir):
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 6
    inverse = F.create_map(*[F.lit(x) for x in ("A", "C", "B", "A", "C", "B")])
    text = F.when(form == 0, "so\nAnswer: (A)").when(form == 1, "**Answer:** b").when(form == 2, "final answer: C.").when(form == 3, "Answer: D").when(form == 4, "it is A").otherwise(F.lit(None))
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 3).alias("d"), F.lit("math_qa").alias("dataset_name"), F.lit("option letter").alias("answer_type"), F.lit(3).alias("n_labels"), inverse.alias("inverse"), text.alias("response"),
        form.isin(0, 1, 4).alias("is_valid_answer"), F.when(form == 0, " C ").otherwise("C").alias("canonicalized_answer"),
    )
    return R.reparse_counters(R.strict_reparse(rows), ["d"])


@query("""WITH sizes AS (SELECT question_id, "view", count(*) AS n FROM pool GROUP BY ALL), per AS (SELECT question_id, count(*) AS views, min(n) AS low, max(n) AS high FROM sizes GROUP BY ALL)
SELECT CASE WHEN low = high THEN views || 'x' || low ELSE 'mixed' END AS profile, count(*) AS questions FROM per GROUP BY ALL""")
def profile_histogram(spark, sf_dir):
    return R.profile_histogram(pool(spark, sf_dir), [])


@query("""SELECT dataset_id, question_id, pos, rank FROM (SELECT dataset_id, question_id, pos, row_number() OVER (PARTITION BY dataset_id ORDER BY question_id, pos) AS rank FROM pool WHERE answer IS NULL) WHERE rank <= 20""")
def first_examples(spark, sf_dir):
    return R.first_examples(pool(spark, sf_dir), F.col("answer").isNull(), ["dataset_id"], ["question_id", "pos"]).select("dataset_id", "question_id", "pos", F.col("rank").cast("long").alias("rank"))


@query("""WITH sums AS (SELECT question_id, answer, sum(confidence) AS m, count(*) AS n FROM pool WHERE answer IS NULL OR confidence IS NOT NULL GROUP BY ALL),
found AS (SELECT question_id, arg_min(answer, (-m, answer)) FILTER (WHERE answer IS NOT NULL) AS a, max(m) FILTER (WHERE answer IS NOT NULL) AS top, sum(m) FILTER (WHERE answer IS NOT NULL) AS total, CAST(sum(n) AS BIGINT) AS samples, CAST(coalesce(sum(n) FILTER (WHERE answer IS NULL), 0) AS BIGINT) AS invalid FROM sums GROUP BY ALL)
SELECT question_id, CASE WHEN question_id % 10 = 0 THEN 'RF' WHEN total > 0 THEN a END AS answer, round(CASE WHEN question_id % 10 = 0 THEN 0.75 WHEN total > 0 THEN CAST(top AS DOUBLE) / CAST(total AS DOUBLE) END, 9) AS support, samples, invalid, CASE WHEN question_id % 10 = 0 THEN 'stored' ELSE 'recomputed' END AS source FROM found""")
def weighted_consensus(spark, sf_dir):
    rows = pool(spark, sf_dir).where("answer IS NULL OR confidence IS NOT NULL")
    stored = gold(spark, sf_dir).where(F.col("question_id") % 10 == 0).select("question_id", F.lit("RF").alias("answer"), F.lit(0.75).alias("support"))
    return R.weighted_consensus(rows, stored).withColumn("support", F.round("support", 9))


@query("""WITH specs AS (SELECT n_name AS dataset, n_nationkey + 1 AS weight, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey / 100.0 END AS percentage FROM nation),
totals AS (SELECT dataset, CAST(round_even(1001 * coalesce(percentage, weight / sum(weight) OVER ()), 0) AS BIGINT) AS total FROM specs)
SELECT dataset, total, CAST(round_even(total * 0.75, 0) AS BIGINT) AS calibration, total - CAST(round_even(total * 0.75, 0) AS BIGINT) AS causal FROM totals""", views=False)
def dataset_counts(spark, sf_dir):
    specs = read(spark, sf_dir, "nation").select(F.col("n_name").alias("dataset"), (F.col("n_nationkey") + 1).alias("weight"), F.when(F.col("n_nationkey") % 5 == 0, F.col("n_nationkey") / 100.0).alias("percentage"))
    return T.dataset_counts(specs, 1001, 0.25)


@query("""WITH eligible AS (SELECT dataset_id, count(*) AS n, count(*) FILTER (WHERE ssc > 0.75) AS high FROM (
  SELECT question_id % 3 AS dataset_id, max(c) / nullif(sum(c), 0) AS ssc FROM (SELECT question_id, answer, count(answer) AS c FROM pool GROUP BY question_id, answer) GROUP BY question_id) WHERE ssc IS NOT NULL GROUP BY dataset_id)
SELECT dataset_id AS dataset, 'calibration' AS task, least(n, 20 + 10 * dataset_id) AS records FROM eligible UNION ALL SELECT dataset_id, 'causal_lm', least(high, 5) FROM eligible WHERE high > 0""")
def mixed_examples(spark, sf_dir):
    per = pool(spark, sf_dir).where("answer IS NOT NULL").groupBy("question_id", "answer").agg(F.count("*").alias("c")).groupBy("question_id").agg((F.max("c") / F.sum("c")).alias("ssc"))
    rows = per.withColumn("dataset", F.col("question_id") % 3).withColumn("target", F.col("ssc"))
    counts = spark.createDataFrame([(i, 25 + 10 * i, 20 + 10 * i, 5) for i in range(3)], "dataset long, total long, calibration long, causal long")
    return T.mixed_examples(rows, counts, "target", "question_id", F.col("ssc") > 0.75).groupBy("dataset", "task").agg(F.count("*").alias("records"))
