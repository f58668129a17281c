"""Metrics, comparisons, sampling, splits and checks over the adapter tables."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from plurality.functions import hashing as H
from plurality.operators import comparison as C
from plurality.operators import controller as K
from plurality.operators import matching as M
from plurality.operators import metrics as X
from plurality.operators import sampling as T
from plurality.operators import support as S
from plurality.plans.registry import query
from plurality.plans.support_queries import RELSC_SQL, RELSSC_SQL
from plurality.sources.adapters import gold, pool, read


def scored(spark, sf_dir):
    """Line items as scored responses of a data set: discount * 10 against returned goods."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_linestatus").alias("dataset"), F.col("l_orderkey").alias("question_id"), F.round(F.col("l_discount") * 10, 6).alias("score"), (F.col("l_returnflag") == "A").cast("int").alias("correct"))


SCORED_SQL = "scored AS (SELECT l_linestatus AS dataset, round(l_discount * 10, 6) AS score, CAST(l_returnflag = 'A' AS INT) AS correct FROM lineitem)"


def _ece_sql(bin_sql: str) -> str:
    return f"""WITH {SCORED_SQL}, binned AS (SELECT *, {bin_sql} AS b FROM scored), per AS (SELECT dataset, b, count(*) AS n, sum(score) AS s, sum(correct) AS c FROM binned GROUP BY ALL)
SELECT dataset, round(sum(CASE WHEN b IS NOT NULL THEN abs(c - s) ELSE 0 END) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM per GROUP BY dataset"""


EDGE_LIST = ", ".join(repr(e) for e in X.edges(10))


@query(_ece_sql(f"CASE WHEN score < 1 THEN len(list_filter([{EDGE_LIST}]::DOUBLE[], lambda e: e <= score)) - 1 END"), views=False)
def ece_paper(spark, sf_dir):
    return X.calibration_error(scored(spark, sf_dir), ["dataset"], "edges").withColumn("ece", F.round("ece", 6))


@query(_ece_sql("least(floor(least(greatest(score, 0), 1) * 10), 9)"), views=False)
def ece_strict(spark, sf_dir):
    return X.calibration_error(scored(spark, sf_dir), ["dataset"], "product").withColumn("ece", F.round("ece", 6))


@query(_ece_sql("CASE WHEN score = 1 THEN 9 ELSE len(list_filter(range(0, 10), lambda i: i / 10 <= score)) - 1 END"), views=False)
def ece_edges(spark, sf_dir):
    return X.calibration_error(scored(spark, sf_dir), ["dataset"], "quotients").withColumn("ece", F.round("ece", 6))


@query(f"WITH {SCORED_SQL} SELECT dataset, count(*) AS n, round(100 * avg(correct), 6) AS accuracy, round(100 * avg((score - correct) ** 2), 6) AS brier, round(avg(score), 6) AS mean_score FROM scored GROUP BY dataset", views=False)
def brier(spark, sf_dir):
    return X.summary(scored(spark, sf_dir), ["dataset"]).select("dataset", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "mean_score")])


@query(f"""WITH {SCORED_SQL}, ranked AS (SELECT dataset, correct, rank() OVER (PARTITION BY dataset ORDER BY score) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2 AS r FROM scored)
SELECT dataset, CAST(sum(correct) AS BIGINT) AS positives, CAST(sum(1 - correct) AS BIGINT) AS negatives, round((sum(CASE WHEN correct = 1 THEN r END) - sum(correct) * (sum(correct) + 1) / 2) / (sum(correct) * sum(1 - correct)), 6) AS auroc FROM ranked GROUP BY dataset""", views=False)
def auroc(spark, sf_dir):
    return X.auroc(scored(spark, sf_dir), ["dataset"]).withColumn("auroc", F.round("auroc", 6))


def _pair(spark, sf_dir):
    rows, truth = pool(spark, sf_dir), gold(spark, sf_dir)
    relsc, relssc = S.counted_relations(rows), S.relational_support(rows, weights=False)
    return C.observations(relsc, "relsc", truth), C.observations(relssc, "relssc", truth), C.total_variation(relsc, relssc, "relsc", "relssc")


PAIR_SQL = f"""firsts AS (SELECT question_id, answer, min(pos) AS f1, min(CASE WHEN confidence IS NOT NULL THEN pos END) AS f2, count(*) AS n, sum(confidence) AS m FROM pool WHERE answer IS NOT NULL GROUP BY ALL),
dist AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER q AS p, CASE WHEN sum(m) OVER q > 0 THEN CAST(m AS DOUBLE) / CAST(sum(m) OVER q AS DOUBLE) END AS q FROM firsts WINDOW q AS (PARTITION BY question_id)),
win1 AS (SELECT question_id, answer, p FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, f1) AS r FROM dist) WHERE r = 1),
win2 AS (SELECT question_id, answer, q FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY m DESC NULLS LAST, f2) AS r FROM dist WHERE q IS NOT NULL) WHERE r = 1),
rows_ AS (SELECT g.question_id, CAST(a.answer = g.gold AS INT) AS rc, CAST(b.answer = g.gold AS INT) AS c, a.answer <> b.answer AS changed, b.q - a.p AS shift,
  (b.q - CAST(b.answer = g.gold AS INT)) ** 2 - (a.p - CAST(a.answer = g.gold AS INT)) ** 2 AS bd, t.tv
  FROM gold g JOIN win1 a USING (question_id) JOIN win2 b USING (question_id) JOIN (SELECT question_id, sum(abs(p - coalesce(q, 0))) / 2 AS tv FROM dist GROUP BY ALL) t USING (question_id))"""


@query(f"""WITH {PAIR_SQL} SELECT question_id % 3 AS dataset_id, count(*) AS n, round(avg(CAST(changed AS INT)), 6) AS changed_rate, round(avg(tv), 6) AS mean_tv, round(median(tv), 6) AS median_tv, round(avg(abs(shift)), 6) AS mean_shift,
  round(100 * avg(c - rc), 6) AS accuracy_delta, round(100 * avg(bd), 6) AS brier_delta, count(*) FILTER (WHERE rc = 1 AND c = 0) AS reference_only, count(*) FILTER (WHERE rc = 0 AND c = 1) AS target_only FROM rows_ GROUP BY ALL""")
def disagreement_summary(spark, sf_dir):
    rows = C.disagreement(*_pair(spark, sf_dir)).withColumn("dataset_id", F.col("question_id") % 3)
    out = C.disagreement_summary(rows, ["dataset_id"])
    return out.select("dataset_id", "n", *[F.round(c, 6).alias(c) for c in ("changed_rate", "mean_tv", "median_tv", "mean_shift", "accuracy_delta", "brier_delta")], "reference_only", "target_only")


@query(f"""WITH {PAIR_SQL} SELECT CASE WHEN round(tv, 9) <= 1e-12 THEN '0' WHEN round(tv, 9) <= 0.02 THEN '(0,0.02]' WHEN round(tv, 9) <= 0.05 THEN '(0.02,0.05]' WHEN round(tv, 9) <= 0.1 THEN '(0.05,0.10]' WHEN round(tv, 9) <= 0.2 THEN '(0.10,0.20]' ELSE '>0.20' END AS tv_bin,
  count(*) AS n, round(avg(tv), 6) AS mean_tv, round(100 * avg(c - rc), 6) AS accuracy_delta FROM rows_ GROUP BY ALL""")
def tv_bins(spark, sf_dir):
    rows = C.disagreement(*_pair(spark, sf_dir)).withColumn("tv_bin", C.tv_bin(F.round("tv", 9)))
    return C.disagreement_summary(rows, ["tv_bin"]).select("tv_bin", "n", F.round("mean_tv", 6).alias("mean_tv"), F.round("accuracy_delta", 6).alias("accuracy_delta"))


VIEW_WIN_SQL = """tally AS (SELECT question_id, "view", answer, count(*) AS n, min(pos) AS f FROM pool WHERE answer IS NOT NULL GROUP BY ALL),
wins AS (SELECT question_id, "view", answer FROM (SELECT *, row_number() OVER (PARTITION BY question_id, "view" ORDER BY n DESC, f) AS r FROM tally) WHERE r = 1),
diag AS (SELECT w."view", w.answer = g.gold AS good, i.answer = g.gold AS r0, w.answer = i.answer AS same FROM wins w JOIN wins i ON i.question_id = w.question_id AND i."view" = 0 JOIN gold g ON g.question_id = w.question_id WHERE w."view" > 0)"""


@query(f"""WITH {VIEW_WIN_SQL} SELECT "view", count(*) AS questions, round(avg(CAST(good AS INT)), 6) AS accuracy, round(avg(CAST(good AS INT)) FILTER (WHERE r0), 6) AS preserved, round(avg(CAST(NOT good AS INT)) FILTER (WHERE r0), 6) AS harmed,
  round(avg(CAST(good AS INT)) FILTER (WHERE NOT r0), 6) AS repaired, round(avg(CAST(NOT same AS INT)) FILTER (WHERE NOT r0), 6) AS broken, round(avg(CAST(same AS INT)) FILTER (WHERE NOT r0), 6) AS same_wrong, round(avg(CAST(same AS INT)), 6) AS agreement FROM diag GROUP BY "view" """)
def relation_diagnostics(spark, sf_dir):
    rows, truth = pool(spark, sf_dir).where("answer IS NOT NULL"), gold(spark, sf_dir)
    sums = rows.groupBy("question_id", "view", "answer").agg(F.count("*").alias("mass"), F.min("pos").alias("first_pos"))
    best = sums.groupBy("question_id", "view").agg(F.max(F.struct("mass", -F.col("first_pos"), "answer"))["answer"].alias("predicted"))
    seen = best.join(truth, "question_id").select("question_id", "view", "predicted", (F.col("predicted") == F.col("gold")).cast("int").alias("correct"))
    out = C.relation_diagnostics(seen.where("view = 0"), seen.where("view > 0"), ["view"])
    return out.select("view", "questions", *[F.round(c, 6).alias(c) for c in ("accuracy", "preserved", "harmed", "repaired", "broken", "same_wrong", "agreement")])


GRIDS = {"0": [1.0], "1": [0.0, 0.5, 1.0], "2": [0.5], "3": [0.0, 1.0]}


@query("""WITH configs AS (SELECT * FROM (VALUES (0.0), (0.5), (1.0)) a(w_1), (VALUES (0.0), (1.0)) b(w_3)),
masses AS (SELECT question_id, answer, w_1, w_3, round(sum(CAST(confidence AS DOUBLE) * CASE "view" WHEN 0 THEN 1.0 WHEN 1 THEN w_1 WHEN 2 THEN 0.5 ELSE w_3 END), 9) AS m, min(pos) AS f FROM pool, configs WHERE answer IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, w_1, w_3 ORDER BY m DESC, f) AS r, sum(m) OVER (PARTITION BY question_id, w_1, w_3) AS total FROM masses)
SELECT CAST(w_1 AS DOUBLE) AS w_1, CAST(w_3 AS DOUBLE) AS w_3, count(*) AS n, round(100 * avg(CAST(answer = g.gold AS INT)), 6) AS accuracy, round(avg(m / total), 5) AS mean_score FROM ranked JOIN gold g USING (question_id) WHERE r = 1 AND total > 0 GROUP BY ALL""")
def weight_sweep(spark, sf_dir):
    out = X.summary(C.weight_sweep(pool(spark, sf_dir), gold(spark, sf_dir), GRIDS), ["w_1", "w_3"])
    return out.select("w_1", "w_3", "n", F.round("accuracy", 6).alias("accuracy"), F.round("mean_score", 5).alias("mean_score"))


@query("""WITH configs AS (SELECT * FROM (VALUES (0.0), (0.5), (1.0)) a(w_1), (VALUES (0.0), (1.0)) b(w_3)),
masses AS (SELECT question_id, answer, w_1, w_3, round(sum(CAST(confidence AS DOUBLE) * CASE "view" WHEN 0 THEN 1.0 WHEN 1 THEN w_1 WHEN 2 THEN 0.5 ELSE w_3 END), 9) AS m, min(pos) AS f FROM pool, configs WHERE answer IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id, w_1, w_3 ORDER BY m DESC, f) AS r, sum(m) OVER (PARTITION BY question_id, w_1, w_3) AS total FROM masses),
won AS (SELECT w_1, w_3, m / total AS score, CAST(answer = g.gold AS INT) AS c FROM ranked JOIN gold g USING (question_id) WHERE r = 1 AND total > 0),
bins AS (SELECT w_1, w_3, least(floor(score * 10), 9) AS b, count(*) AS n, sum(c) AS c, sum(score) AS s FROM won GROUP BY ALL)
SELECT CAST(w_1 AS DOUBLE) AS w_1, CAST(w_3 AS DOUBLE) AS w_3, CAST(sum(n) AS BIGINT) AS n, round(100 * sum(abs(c - s)) / sum(n), 6) AS ece, round(100 * sum(c) / sum(n), 6) AS accuracy FROM bins GROUP BY w_1, w_3 ORDER BY ece, accuracy DESC, w_1, w_3 LIMIT 3""")
def best_weights(spark, sf_dir):
    """A top-k report: the weights with the lowest calibration error."""
    out = C.best_weights(C.weight_sweep(pool(spark, sf_dir), gold(spark, sf_dir), GRIDS), 3)
    return out.select("w_1", "w_3", "n", F.round("ece", 6).alias("ece"), F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT flag, CAST(sum(q) AS BIGINT) AS questions, CAST(sum(c) AS BIGINT) AS correct, CAST(sum(u) AS BIGINT) AS used, round(sum(c) / sum(q), 6) AS accuracy, round(sum(u) / sum(q), 6) AS average_used
FROM (SELECT l_returnflag AS flag, l_linestatus, count(*) AS q, count(*) FILTER (WHERE l_discount > 0.05) AS c, sum(l_linenumber) AS u FROM lineitem GROUP BY ALL) GROUP BY flag""", views=False)
def micro_average(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_linestatus").agg(F.count("*").alias("questions"), F.count_if(F.col("l_discount") > 0.05).alias("correct"), F.sum("l_linenumber").alias("used"))
    return C.micro_average(per, ["flag"]).withColumn("accuracy", F.round("accuracy", 6)).withColumn("average_used", F.round("average_used", 6))


def bootstrap_ci(spark, sf_dir):
    """Exact generator parity, so no SQL; tested against a plain loop."""
    ref, target, _ = _pair(spark, sf_dir)
    a = ref.select("question_id", F.col("score").alias("ref_score"), F.col("correct").alias("ref_correct"))
    pairs = a.join(target.select("question_id", "score", "correct"), "question_id").withColumn("dataset_id", F.col("question_id") % 3)
    return X.paired_bootstrap(pairs, ["dataset_id"], "brier", replicates=200, seed=7)


query()(bootstrap_ci)


REPLICATES = 40
COUNTS_SQL = f"""hashed AS (SELECT p.*, r, (('0x' || substr(md5(p.question_id::VARCHAR), 1, 8))::UBIGINT + r::UBIGINT * 2654435761 + 283521) % 4294967296 AS u0 FROM rows_ p, range(0, {REPLICATES}) t(r)),
once AS (SELECT *, (u0 * 2246822519) % 4294967296 AS u1 FROM hashed), twice AS (SELECT *, (xor(u1, u1 >> 15) * 3266489917) % 4294967296 AS u2 FROM once), unit AS (SELECT *, xor(u2, u2 >> 13) / 4294967296.0::DOUBLE AS u FROM twice),
counted AS (SELECT *, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253, 0.9999988747974020]::DOUBLE[], lambda e: e <= u)) AS k FROM unit)"""
GAP_SQL = """SELECT question_id % 3 AS dataset_id, r, least(floor(least(greatest(x, 0), 1) * 10), 9) AS bin, sum(k * (y - x)) AS gap FROM counted GROUP BY ALL"""


@query(f"""WITH {PAIR_SQL.replace("b.q - a.p AS shift", "b.q - a.p AS shift, a.p AS rp, b.q AS tp")}, {COUNTS_SQL},
means AS (SELECT 'brier' AS metric, question_id % 3 AS dataset_id, r, 100 * sum(k * bd) / sum(k) AS d FROM counted GROUP BY ALL UNION ALL SELECT 'accuracy', question_id % 3, r, round(100 * sum(k * (c - rc)) / sum(k), 9) FROM counted GROUP BY ALL
  UNION ALL SELECT 'ece_strict', dataset_id, r, 100 * (t.e - s.e) / n FROM (SELECT question_id % 3 AS dataset_id, r, sum(k) AS n FROM counted GROUP BY ALL)
  JOIN (SELECT dataset_id, r, sum(abs(gap)) AS e FROM ({GAP_SQL.replace("x,", "tp,").replace("y - x", "c - tp")}) GROUP BY ALL) t USING (dataset_id, r) JOIN (SELECT dataset_id, r, sum(abs(gap)) AS e FROM ({GAP_SQL.replace("x,", "rp,").replace("y - x", "rc - rp")}) GROUP BY ALL) s USING (dataset_id, r))
SELECT metric, dataset_id, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(avg(CASE WHEN d = 0 THEN 0.5 WHEN (metric = 'accuracy') = (d > 0) THEN 1 ELSE 0 END), 6) AS p_improve FROM means GROUP BY ALL""")
def hashed_bootstrap_ci(spark, sf_dir):
    """Pairs of any number: replicates are rows of a matrix of sums."""
    ref, target, _ = _pair(spark, sf_dir)
    a = ref.select("question_id", F.col("score").alias("ref_score"), F.col("correct").alias("ref_correct"))
    pairs = a.join(target.select("question_id", "score", "correct"), "question_id").withColumn("dataset_id", F.col("question_id") % 3)
    found = [X.hashed_bootstrap(pairs, ["dataset_id"], m, REPLICATES, seed=7).withColumn("metric", F.lit(m)) for m in ("brier", "accuracy", "ece_strict")]
    out = functools.reduce(lambda x, y: x.unionByName(y), found)
    return out.select("metric", "dataset_id", *[F.round(c, 6).alias(c) for c in ("low", "high", "p_improve")])


@query("""WITH picked AS (SELECT p_partkey AS question_id, p_brand AS dataset_name FROM part)
SELECT question_id, dataset_name, ('0x' || substr(sha256('holdout' || chr(0) || '7' || chr(0) || dataset_name || chr(0) || question_id), 1, 16))::UBIGINT / 18446744073709551616.0 < 0.2 AS validation FROM picked""", views=False)
def holdout_partition(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("dataset_name"))
    return rows.select("question_id", "dataset_name", (H.holdout_fraction("holdout", 7, F.col("dataset_name"), F.col("question_id")) < 0.2).alias("validation"))


@query("""WITH picked AS (SELECT p_partkey AS question_id, p_brand AS dataset_name, p_type AS split, ('0x' || substr(sha256('holdout' || chr(0) || '7' || chr(0) || p_brand || chr(0) || p_partkey), 1, 16))::UBIGINT / 18446744073709551616.0 < 0.2 AS validation FROM part)
SELECT question_id, dataset_name, split AS source_split, CASE WHEN validation THEN 'validation' ELSE 'test' END AS split FROM picked""", views=False)
def split_rewritten(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("dataset_name"), F.col("p_type").alias("split"))
    both = [H.partition_rows(rows, role, "holdout", 7, 0.2) for role in ("validation", "test")]
    return both[0].unionByName(both[1]).select("question_id", "dataset_name", "source_split", "split")


@query("""WITH picked AS (SELECT p_partkey AS question_id, p_brand AS dataset_name, row_number() OVER (PARTITION BY p_brand ORDER BY substr(sha256('5' || chr(0) || p_partkey), 1, 32), p_partkey) AS r, count(*) OVER (PARTITION BY p_brand) AS n FROM part)
SELECT question_id, dataset_name, CASE WHEN n > 1 AND r <= least(n - 1, greatest(1, round_even(n * 0.25, 0))) THEN 'test' ELSE 'train' END AS split FROM picked""", views=False)
def group_split(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.col("p_brand").alias("dataset_name"))
    return H.group_split(rows, 0.25, 5)


@query("""WITH w AS (SELECT p_brand AS brand, CAST(count(*) AS DOUBLE) AS weight FROM part GROUP BY ALL), q AS (SELECT brand, 1000.0::DOUBLE * weight / sum(weight) OVER () AS q FROM w)
SELECT brand, CAST(floor(q) + CASE WHEN row_number() OVER (ORDER BY floor(q) - q, brand) <= 1000 - sum(floor(q)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS allocation FROM q""", views=False)
def largest_remainder(spark, sf_dir):
    weights = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").cast("double").alias("weight"))
    return T.largest_remainder(weights, 1000, "brand")


@query("""WITH base AS (SELECT p_partkey AS sample_id, p_brand AS brand, round((p_partkey * 37 % 1001) / 1000, 6) AS target, substr(sha256('3' || chr(0) || p_partkey), 1, 32) AS h FROM part),
b AS (SELECT *, CAST(least(floor(target / 0.05), 20) AS INT) AS target_bin FROM base), c AS (SELECT *, row_number() OVER (PARTITION BY brand, target_bin ORDER BY h, sample_id) <= 1 AS first FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY NOT first, CASE WHEN first THEN target_bin ELSE 0 END, h, sample_id) AS r FROM c) SELECT sample_id, brand, target, target_bin FROM d WHERE r <= 40""", views=False)
def bin_balanced_sample(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), F.col("p_brand").alias("brand"), F.round((F.col("p_partkey") * 37 % 1001) / 1000, 6).alias("target"))
    return T.bin_balanced(rows, 40, "target", "sample_id", "brand", seed=3)


@query("""SELECT a.question_id, round(avg(ln(1 + exp(-(CAST(a.confidence AS DOUBLE) - CAST(b.confidence AS DOUBLE))))), 6) AS loss, count(*) AS pairs
FROM pool a JOIN pool b ON a.question_id = b.question_id AND a.fragility > b.fragility AND a.confidence IS NOT NULL AND b.confidence IS NOT NULL GROUP BY a.question_id""")
def rank_pairs(spark, sf_dir):
    return T.rank_pair_loss(pool(spark, sf_dir), "fragility", "confidence").withColumn("loss", F.round("loss", 6))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS "rows" FROM lineitem GROUP BY ALL HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1""", views=False)
def dup_conflicts(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem")
    return M.distinct_or_conflict(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey"])[1]


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 <> 0)
SELECT k AS custkey, 'missing' AS status FROM b WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'unexpected' FROM a WHERE k NOT IN (SELECT k FROM b)""", views=False)
def coverage_anti(spark, sf_dir):
    found = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"))
    expected = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey")).where("custkey % 3 <> 0")
    return M.coverage(expected, found, "custkey")


@query("""SELECT question_id, 'answer_without_confidence' AS rule, CAST(pos AS VARCHAR) AS detail FROM pool WHERE answer IS NOT NULL AND confidence IS NULL
UNION ALL SELECT question_id, 'view_out_of_range', CAST("view" AS VARCHAR) FROM pool WHERE "view" >= 3
UNION ALL SELECT question_id, 'view_size', "view" || '=' || count(*) FROM pool GROUP BY question_id, "view" HAVING count(*) <> 8""")
def contract_violations(spark, sf_dir):
    return M.contract_violations(pool(spark, sf_dir), 3, 8)


@query("""SELECT question_id, count(*) AS "rows", count(DISTINCT pos) AS kinds, min(pos) AS low, max(pos) AS high FROM pool GROUP BY ALL HAVING count(*) <> 30""")
def index_violations(spark, sf_dir):
    return M.index_violations(pool(spark, sf_dir), 30)


@query("""SELECT count(*) AS questions, CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(a) AS BIGINT) AS answered, CAST(sum(c) AS BIGINT) AS scored, min(n) AS smallest, max(n) AS largest, count(*) FILTER (WHERE n < 32) AS short
FROM (SELECT question_id, count(*) AS n, count(answer) AS a, count(confidence) AS c FROM pool GROUP BY ALL)""")
def pool_diagnostics(spark, sf_dir):
    return M.pool_diagnostics(pool(spark, sf_dir))


@query("""SELECT CASE WHEN answer IS NULL THEN 'no_answer' WHEN confidence IS NULL THEN 'no_score' WHEN duplicate_view THEN 'duplicate' ELSE 'kept' END AS reason, count(*) AS "rows" FROM pool GROUP BY ALL""")
def audit_counters(spark, sf_dir):
    reasons = [("no_answer", F.col("answer").isNull()), ("no_score", F.col("confidence").isNull()), ("duplicate", F.col("duplicate_view"))]
    return M.first_reason(pool(spark, sf_dir), reasons)


CONSENSUS_SQL = f"""WITH {RELSC_SQL}, own AS (SELECT question_id, answer, m, CAST(m AS DOUBLE) / nullif(CAST(sum(m) OVER (PARTITION BY question_id) AS DOUBLE), 0) AS ssc FROM (SELECT question_id, answer, sum(confidence) AS m FROM pool WHERE answer IS NOT NULL AND confidence IS NOT NULL AND "view" = 0 GROUP BY ALL)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY m DESC, answer) AS r FROM own WHERE ssc IS NOT NULL) WHERE r = 1),
tops AS (SELECT question_id, list(answer) AS answers FROM (SELECT *, max(relsc) OVER (PARTITION BY question_id) AS hi FROM relsc WHERE question_id % 7 <> 0) WHERE abs(relsc - hi) <= 1e-12 GROUP BY ALL),
cases AS (SELECT b.question_id, b.answer AS wrong, g.gold, ssc, CASE WHEN t.answers IS NULL THEN 'unmatched' ELSE 'evaluated' END AS status, CASE WHEN t.answers IS NOT NULL THEN coalesce(r.relsc, 0) END AS relsc,
  t.answers <> [b.answer] AS broken, NOT list_contains(t.answers, b.answer) AS displaced, list_min(t.answers) = g.gold AS corrected
  FROM best b JOIN gold g USING (question_id) LEFT JOIN tops t USING (question_id) LEFT JOIN relsc r ON r.question_id = b.question_id AND r.answer = b.answer WHERE b.answer <> g.gold AND ssc >= 0.4)"""


def _cases(spark, sf_dir):
    """The relation pool lacks every seventh question."""
    rows = pool(spark, sf_dir)
    own = S.answer_shares(rows.where("view = 0"), F.col("confidence"), "ssc")
    relations = S.counted_relations(rows.where(F.col("question_id") % 7 != 0))
    return M.wrong_consensus(own, relations, gold(spark, sf_dir), 0.4)


@query(f"""{CONSENSUS_SQL} SELECT question_id, wrong, gold, status, round(ssc, 6) AS ssc, round(relsc, 6) AS relsc, round(ssc - relsc, 6) AS "drop", round((ssc - relsc) / ssc, 6) AS relative_drop, broken, displaced, corrected FROM cases""")
def wrong_consensus_cases(spark, sf_dir):
    return _cases(spark, sf_dir).select("question_id", "wrong", "gold", "status", *[F.round(c, 6).alias(c) for c in ("ssc", "relsc", "drop", "relative_drop")], "broken", "displaced", "corrected")


@query(f"""{CONSENSUS_SQL}, e AS (SELECT * FROM cases WHERE status = 'evaluated')
SELECT count(*) AS candidates, (SELECT count(*) FROM e) AS evaluated, count(*) FILTER (WHERE status = 'unmatched') AS unmatched, CAST(0 AS BIGINT) AS undefined, round(avg(ssc), 6) AS mean_ssc_all,
  (SELECT round(avg(ssc), 6) FROM e) AS mean_ssc, (SELECT round(avg(relsc), 6) FROM e) AS mean_relsc, (SELECT round(avg(ssc - relsc), 6) FROM e) AS mean_drop, (SELECT round(avg((ssc - relsc) / ssc), 6) FROM e) AS mean_relative_drop,
  (SELECT round((avg(ssc) - avg(relsc)) / avg(ssc), 6) FROM e) AS relative_drop_of_means, (SELECT count(*) FILTER (WHERE broken) FROM e) AS broken_count, (SELECT count(*) FILTER (WHERE displaced) FROM e) AS displaced_count, (SELECT count(*) FILTER (WHERE corrected) FROM e) AS corrected_count,
  (SELECT round(avg(CAST(broken AS INT)), 6) FROM e) AS broken_rate, (SELECT round(avg(CAST(displaced AS INT)), 6) FROM e) AS displaced_rate, (SELECT round(avg(CAST(corrected AS INT)), 6) FROM e) AS corrected_rate FROM cases""")
def consensus_summary(spark, sf_dir):
    out = M.consensus_summary(_cases(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


@query(f"""WITH {RELSSC_SQL}, k AS (SELECT question_id, count(*) AS k FROM pool WHERE "view" IN (0, 1) GROUP BY ALL),
tally AS (SELECT p.question_id, answer, sum(confidence) AS m, min(pos) AS f FROM pool p JOIN k USING (question_id) WHERE pos < k AND answer IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY m DESC, f) AS r, sum(m) OVER (PARTITION BY question_id) AS total FROM tally)
SELECT question_id, answer AS predicted, round(CAST(m AS DOUBLE) / CAST(total AS DOUBLE), 6) AS score, CAST(answer = g.gold AS INT) AS correct FROM best JOIN gold g USING (question_id) WHERE r = 1 AND total > 0""")
def matched_budget_baseline(spark, sf_dir):
    """The first k samples of each question, k being the size of its reduced pool."""
    rows = pool(spark, sf_dir)
    k = rows.where("view IN (0, 1)").groupBy("question_id").agg(F.count("*").alias("k"))
    matched = rows.join(k, "question_id").where("pos < k")
    return C.observations(S.answer_shares(matched, F.col("confidence"), "ssc"), "ssc", gold(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT *, answer || '/' || (pos % 5) AS cluster FROM (SELECT *, count(*) OVER (PARTITION BY question_id) AS size FROM pool) WHERE pos < 16),
ok AS (SELECT * FROM v WHERE answer IS NOT NULL AND confidence IS NOT NULL AND fragility IS NOT NULL),
member AS (SELECT a.question_id, a.pos AS prefix, b.* EXCLUDE (question_id) FROM v a JOIN ok b ON a.question_id = b.question_id AND b.pos <= a.pos),
sized AS (SELECT *, 1 / sqrt(count(*) OVER (PARTITION BY question_id, prefix, cluster)) * CAST(confidence AS DOUBLE) AS dc FROM member),
votes AS (SELECT question_id, prefix, answer, round(sum(dc * (1 - CAST(fragility AS DOUBLE))), 9) AS w, sum(dc) AS dc, sum(dc * CAST(fragility AS DOUBLE)) AS dcf, min(pos) AS f, count(*) AS n FROM sized GROUP BY ALL),
lead AS (SELECT *, sum(w) OVER p AS total, sum(n) OVER p AS valid, row_number() OVER (PARTITION BY question_id, prefix ORDER BY w DESC, f) AS r FROM votes WINDOW p AS (PARTITION BY question_id, prefix)),
acts AS (SELECT question_id, prefix, answer, CASE WHEN dc > 0 AND round(dcf / dc, 9) <= 0.12 THEN 'STOP' ELSE 'INTERVENE' END AS action FROM lead WHERE r = 1 AND valid >= 2 AND total > 0 AND round(w / total, 9) >= 0.5),
first AS (SELECT question_id, min(prefix) AS prefix, arg_min(action, prefix) AS action, arg_min(answer, prefix) AS leader FROM acts GROUP BY ALL)
SELECT z.question_id, coalesce(f.action, 'SAMPLE') AS action, f.leader, coalesce(f.prefix + 1, z.n) AS used FROM (SELECT question_id, least(count(*), 16) AS n FROM pool GROUP BY ALL) z LEFT JOIN first f USING (question_id)""")
def controller_replay(spark, sf_dir):
    rows = pool(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "answer", (F.col("pos") % 5).cast("string")))
    return K.replay(rows, 16, support=0.5, fragile=0.12)
