"""Supports, targets and fragility over the adapter pool."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.operators import support as S
from plurality.plans.registry import query
from plurality.sources.adapters import gold, pool

RELSSC_SQL = """relssc AS (
  SELECT question_id, answer, mass, sum(mass) OVER (PARTITION BY question_id) AS total FROM (
    SELECT question_id, answer, sum(confidence * relation_weight * dependency_weight) AS mass FROM pool
    WHERE answer IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL)
)"""


@query(f"WITH {RELSSC_SQL} SELECT question_id, answer, round(CAST(mass AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 6) AS relssc FROM relssc")
def relssc_scores(spark, sf_dir):
    return S.relational_support(pool(spark, sf_dir)).select("question_id", "answer", F.round("relssc", 6).alias("relssc"))


@query(f"""WITH {RELSSC_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY mass DESC, answer) AS r FROM relssc WHERE total > 0)
SELECT g.question_id, b.answer, round(CAST(b.mass AS DOUBLE) / CAST(b.total AS DOUBLE), 6) AS relssc, coalesce(b.answer = g.gold, false) AS correct
FROM gold g LEFT JOIN best b ON g.question_id = b.question_id AND b.r = 1""")
def relssc_winner(spark, sf_dir):
    """Flagship: relational support, its winner, and strict correctness over all questions."""
    best = S.top_answer(S.relational_support(pool(spark, sf_dir)), "relssc")
    return gold(spark, sf_dir).join(best, "question_id", "left").select("question_id", "answer", F.round("relssc", 6).alias("relssc"), F.coalesce(F.col("answer") == F.col("gold"), F.lit(False)).alias("correct"))


@query(f"""WITH {RELSSC_SQL} SELECT p.question_id, p.pos, p.answer, round(CAST(r.mass AS DOUBLE) / nullif(CAST(r.total AS DOUBLE), 0), 6) AS relssc
FROM pool p LEFT JOIN relssc r ON p.question_id = r.question_id AND p.answer = r.answer""")
def relssc_targets(spark, sf_dir):
    rows = pool(spark, sf_dir)
    return S.attach_targets(rows, S.relational_support(rows), "relssc").select("question_id", "pos", "answer", F.round("relssc", 6).alias("relssc"))


IDENTITY_SQL = """counted AS (
  SELECT question_id, answer, count(*) FILTER (WHERE "view" = 0) AS hits FROM pool WHERE NOT duplicate_view AND answer IS NOT NULL GROUP BY ALL
), ratio AS (
  SELECT question_id, coalesce(count(*) FILTER (WHERE "view" <> 0 AND answer IS NOT NULL) / nullif(count(*) FILTER (WHERE "view" <> 0), 0), 0) AS ratio,
    count(*) FILTER (WHERE "view" = 0 AND answer IS NOT NULL) AS hits FROM pool WHERE NOT duplicate_view GROUP BY ALL
), identity_ssc AS (
  SELECT c.question_id, c.answer, coalesce(c.hits / nullif(r.hits, 0), 0) AS ssc, r.ratio FROM counted c JOIN ratio r USING (question_id)
)"""


@query(f"WITH {IDENTITY_SQL} SELECT question_id, answer, round(ssc, 6) AS ssc, round(ratio, 6) AS relation_valid_ratio FROM identity_ssc")
def ssc_count_identity(spark, sf_dir):
    return S.counted_identity(pool(spark, sf_dir)).select("question_id", "answer", F.round("ssc", 6).alias("ssc"), F.round("relation_valid_ratio", 6).alias("relation_valid_ratio"))


@query(f"""WITH {RELSSC_SQL}, {IDENTITY_SQL}
SELECT i.question_id, i.answer, round(ssc, 6) AS target_ssc, round(rel, 6) AS target_relssc,
  CASE WHEN rel IS NOT NULL THEN round(least(greatest(ssc - 0.5 * ratio * greatest(ssc - rel, 0), 0.01), 0.99), 6) END AS target_residual
FROM identity_ssc i LEFT JOIN (SELECT question_id, answer, CAST(mass AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0) AS rel FROM relssc) r USING (question_id, answer)""")
def target_modes(spark, sf_dir):
    rows = pool(spark, sf_dir)
    joined = S.attach_targets(S.counted_identity(rows), S.relational_support(rows), "relssc")
    modes = {"ssc": "target_ssc", "relssc_replace": "target_relssc", "residual": "target_residual"}
    return joined.select("question_id", "answer", *[F.round(S.resolve_target(m, F.col("ssc"), F.col("relssc"), F.col("relation_valid_ratio")), 6).alias(n) for m, n in modes.items()])


@query("""SELECT question_id, answer, round(CAST(mass AS DOUBLE) / nullif(CAST(sum(mass) OVER (PARTITION BY question_id) AS DOUBLE), 0), 6) AS ssc
FROM (SELECT question_id, answer, sum(confidence) AS mass FROM pool WHERE answer IS NOT NULL AND confidence IS NOT NULL AND "view" = 0 GROUP BY ALL)""")
def weighted_ssc(spark, sf_dir):
    rows = pool(spark, sf_dir).where("view = 0")
    return S.answer_shares(rows, F.col("confidence"), "ssc").select("question_id", "answer", F.round("ssc", 6).alias("ssc"))


RELSC_SQL = "relsc AS (SELECT question_id, answer, count(*) / sum(count(*)) OVER (PARTITION BY question_id) AS relsc FROM pool WHERE answer IS NOT NULL GROUP BY question_id, answer)"


@query(f"WITH {RELSC_SQL} SELECT question_id, answer, round(relsc, 6) AS relsc FROM relsc")
def relsc_count(spark, sf_dir):
    return S.counted_relations(pool(spark, sf_dir)).select("question_id", "answer", F.round("relsc", 6).alias("relsc"))


@query(f"""WITH {RELSC_SQL}, own AS (
  SELECT question_id, answer, CAST(mass AS DOUBLE) / nullif(CAST(sum(mass) OVER (PARTITION BY question_id) AS DOUBLE), 0) AS ssc
  FROM (SELECT question_id, answer, sum(confidence) AS mass FROM pool WHERE answer IS NOT NULL AND confidence IS NOT NULL AND "view" = 0 GROUP BY ALL))
SELECT question_id, answer, round(coalesce(ssc, 0), 6) AS ssc, round(coalesce(relsc, 0), 6) AS relsc FROM own FULL JOIN relsc USING (question_id, answer)""")
def paired_targets(spark, sf_dir):
    rows = pool(spark, sf_dir)
    own = S.answer_shares(rows.where("view = 0"), F.col("confidence"), "ssc")
    return S.paired_scores(own, S.counted_relations(rows)).select("question_id", "answer", F.round("ssc", 6).alias("ssc"), F.round("relsc", 6).alias("relsc"))


VIEW_SQL = """by_view AS (SELECT question_id, "view", avg(CAST(relation_weight AS DOUBLE)) AS vw, sum(CASE WHEN answer IS NOT NULL THEN confidence * dependency_weight END) AS total FROM pool GROUP BY ALL),
by_answer AS (SELECT question_id, "view", answer, sum(confidence * dependency_weight) AS mass FROM pool WHERE answer IS NOT NULL GROUP BY ALL),
supports AS (SELECT a.question_id, a."view", a.answer, CAST(mass AS DOUBLE) / CAST(total AS DOUBLE) AS support, vw FROM by_answer a JOIN by_view v USING (question_id, "view") WHERE total > 0 AND mass IS NOT NULL)"""


@query(f'WITH {VIEW_SQL} SELECT question_id, "view", answer, round(support, 6) AS support, round(vw, 6) AS view_weight FROM supports')
def view_support(spark, sf_dir):
    return S.view_support(pool(spark, sf_dir)).select("question_id", "view", "answer", F.round("support", 6).alias("support"), F.round("view_weight", 6).alias("view_weight"))


@query(f"""WITH {VIEW_SQL}, views AS (SELECT DISTINCT question_id, "view", vw FROM supports),
grid AS (SELECT v.question_id, v."view", v.vw, a.answer, coalesce(s.support, 0) AS support FROM views v
  JOIN (SELECT DISTINCT question_id, answer FROM supports) a USING (question_id) LEFT JOIN supports s ON s.question_id = v.question_id AND s."view" = v."view" AND s.answer = a.answer),
mean AS (SELECT question_id, answer, sum(vw * support) / sum(vw) AS sr, max(CASE WHEN "view" = 0 THEN support END) AS s0 FROM grid GROUP BY ALL HAVING sum(vw) > 0 AND count(*) FILTER (WHERE "view" = 0) > 0),
spread AS (SELECT g.question_id, g.answer, sum(vw * (support - sr) ** 2) / sum(vw) AS var FROM grid g JOIN mean USING (question_id, answer) GROUP BY ALL)
SELECT question_id, answer, round(s0, 6) AS identity_support, round(sr, 6) AS relational_support, round(least(1, greatest(0, greatest(s0 - sr, 0) + 0.5 * sqrt(greatest(var, 0)))), 5) AS fragility
FROM mean JOIN spread USING (question_id, answer)""")
def fragility(spark, sf_dir):
    return S.fragility(pool(spark, sf_dir)).select("question_id", "answer", F.round("identity_support", 6).alias("identity_support"), F.round("relational_support", 6).alias("relational_support"), F.round("fragility", 5).alias("fragility"))


CLUSTER_SQL = """sizes AS (SELECT question_id, answer || '/' || (pos % 5) AS cluster, count(*) AS n FROM pool WHERE answer IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {CLUSTER_SQL} SELECT p.question_id, p.pos, s.n AS cluster_size, coalesce(round(1 / sqrt(s.n), 6), 0) AS dependency
FROM pool p LEFT JOIN sizes s ON p.question_id = s.question_id AND p.answer || '/' || (p.pos % 5) = s.cluster""")
def dependency_weights(spark, sf_dir):
    rows = pool(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "answer", (F.col("pos") % 5).cast("string")))
    return S.cluster_weights(rows, "cluster").select("question_id", "pos", "cluster_size", F.round(F.col("dependency").cast("double"), 6).alias("dependency"))


@query(f"""WITH {CLUSTER_SQL} SELECT question_id, count(*) AS clusters, CAST(sum(n) AS BIGINT) AS "rows", max(n) AS largest, round(avg(n), 6) AS mean_size, round(sum(sqrt(n)), 6) AS effective_mass FROM sizes GROUP BY ALL""")
def cluster_diagnostics(spark, sf_dir):
    rows = pool(spark, sf_dir).withColumn("cluster", F.concat_ws("/", "answer", (F.col("pos") % 5).cast("string")))
    return S.cluster_summary(rows, "cluster").select("question_id", "clusters", "rows", "largest", F.round("mean_size", 6).alias("mean_size"), F.round("effective_mass", 6).alias("effective_mass"))


@query(f"""WITH {RELSSC_SQL} SELECT p.question_id, count(*) AS "rows", count(*) FILTER (WHERE p.answer IS NOT NULL AND confidence IS NOT NULL) AS valid,
  count(*) FILTER (WHERE p.answer IS NULL OR confidence IS NULL) AS invalid, max(b.best) AS best, coalesce(max(b.over), 0) AS over
FROM pool p LEFT JOIN (SELECT question_id, max(round(CAST(mass AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0), 6)) AS best, count(*) FILTER (WHERE CAST(mass AS DOUBLE) / nullif(CAST(total AS DOUBLE), 0) > 0.75) AS over FROM relssc GROUP BY ALL) b USING (question_id)
GROUP BY p.question_id""")
def question_summary(spark, sf_dir):
    rows = pool(spark, sf_dir)
    return S.question_summary(rows, S.relational_support(rows), "relssc").withColumn("best", F.round("best", 6))
