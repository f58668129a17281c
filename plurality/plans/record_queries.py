"""Single records, prompts and scores over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.functions import normalize as N
from plurality.functions import prompts as P
from plurality.functions import scores as S
from plurality.functions import views as W
from plurality.operators import evaluation as V
from plurality.operators import matching as M
from plurality.operators import records as R
from plurality.operators import sampling as T
from plurality.plans.evaluation_queries import SETTINGS
from plurality.plans.registry import query
from plurality.sources import artifacts
from plurality.sources import readers as D
from plurality.sources import sinks as K
from plurality.sources.adapters import gold, pool, read, tasks


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'q' || conv_id ELSE 'legacy:' || substr(sha256(coalesce(text, '')), 1, 20) END AS question, CASE WHEN turn % 4 = 0 THEN 's' || turn ELSE substr(sha256(conv_id || chr(0) || turn || chr(0) || (turn + 1)), 1, 24) END AS sample FROM conversations""", views=False)
def fallback_ids(spark, sf_dir):
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    question = F.when(turn % 3 == 0, F.concat(F.lit("q"), conv)).when(turn % 3 == 1, "")
    sample = F.when(turn % 4 == 0, F.concat(F.lit("s"), turn.cast("string"))).when(turn % 4 == 1, "")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", R.question_of(question, F.col("text")).alias("question"), R.sample_of(sample, conv, turn, turn + 1).alias("sample"))


@query("""WITH r AS (SELECT l_orderkey AS question_id, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 0 END AS v, CASE WHEN l_quantity > 40 THEN 0 ELSE CAST(l_quantity AS INT) END AS i, CAST(l_linenumber AS VARCHAR) AS s FROM lineitem)
SELECT question_id, s AS sample_id, row_number() OVER (PARTITION BY question_id ORDER BY v, i, s) - 1 AS pos FROM r""", views=False)
def sample_order(spark, sf_dir):
    line, q = F.col("l_linenumber"), F.col("l_quantity")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.when(line % 3 == 1, "2").when(line % 3 == 2, "x").alias("view_index"), F.when(q <= 40, q.cast("int").cast("string")).otherwise("n/a").alias("sample_index"), line.cast("string").alias("sample_id"))
    return R.in_order(rows).select("question_id", "sample_id", "pos")


@query("""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey % 4 AS a, l_suppkey % 4 AS f, l_linenumber % 3 AS s FROM lineitem)
SELECT id, line, a < 2 AND f <> 1 AND s <> 2 AS valid, a < 3 AND f = 0 AS strict FROM r""", views=False)
def valid_records(spark, sf_dir):
    a, f, s = F.col("l_partkey") % 4, F.col("l_suppkey") % 4, F.col("l_linenumber") % 3
    answer = F.when(a == 0, "b").when(a == 1, " 7 ").when(a == 2, "N/A")
    flag = F.when(f == 0, True).when(f == 1, False)
    status = F.when(s == 0, " VALID").when(s == 2, "invalid_format")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), answer.alias("answer"), flag.alias("flag"), status.alias("status"))
    return rows.select("id", "line", R.valid_record(F.col("answer"), F.col("flag"), F.col("status")).alias("valid"), R.strictly_valid(F.col("answer"), F.col("flag")).alias("strict"))


@query("""SELECT question_id, pos FROM pool WHERE "view" = 0 OR question_id % 5 = 0""")
def identity_scope(spark, sf_dir):
    rows = pool(spark, sf_dir).withColumn("relation_id", F.concat(F.lit("g"), F.col("view").cast("string"))).withColumn("relation_type", F.when(F.col("question_id") % 5 == 0, " Identity"))
    return R.in_scope(rows, "identity").select("question_id", "pos")


@query("""SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag WHEN l_tax < 0.04 THEN l_linestatus WHEN l_tax < 0.06 THEN 'o' END AS answer,
  CASE WHEN l_discount > 0.05 THEN FALSE ELSE l_linenumber % 2 = 0 OR l_tax < 0.06 END AS valid FROM lineitem""", views=False)
def runtime_records(spark, sf_dir):
    line, tax = F.col("l_linenumber"), F.col("l_tax")
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), line.alias("line"), F.when(line % 2 == 0, F.col("l_returnflag")).alias("canonicalized_answer"), F.when(tax < 0.04, F.col("l_linestatus")).alias("extracted_answer"), F.when(tax < 0.06, "o").alias("answer"), F.when(F.col("l_discount") > 0.05, False).alias("is_valid_answer"),
    )
    return R.runtime_records(rows).select("id", "line", F.col("canonicalized_answer").alias("answer"), F.col("is_valid_answer").alias("valid"))


@query("""SELECT coalesce(CASE o_orderkey % 5 WHEN 0 THEN 'train' WHEN 1 THEN NULL ELSE 'test' END, '<none>') AS split, count(*) AS rows FROM orders WHERE o_orderkey % 5 < 2 GROUP BY ALL""", views=False)
def split_violations(spark, sf_dir):
    key = F.col("o_orderkey") % 5
    return R.split_violations(read(spark, sf_dir, "orders").select(F.when(key == 0, "train").when(key > 1, "test").alias("split")), "test")


@query("""SELECT l_partkey AS id, count(DISTINCT l_suppkey % 3) AS shards, min(l_suppkey % 3) AS first, max(l_suppkey % 3) AS last FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey % 3) > 1""", views=False)
def repeated_over_shards(spark, sf_dir):
    return R.repeated_over_shards(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 3).alias("shard")), "id", "shard")


@query("""WITH a AS (SELECT DISTINCT o_custkey % 7 AS shard, o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT DISTINCT o_custkey % 7 AS shard, o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0)
SELECT shard, id, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT shard, id, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", views=False)
def unequal_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("shard"), F.col("o_orderkey").alias("id"))
    return R.unequal_ids(rows.where("id % 3 <> 0"), rows.where("id % 4 <> 0"), "id", "shard")


@query("""WITH base AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_size AS n FROM part)
SELECT id, CASE k WHEN 0 THEN 'a' WHEN 1 THEN '(B)' WHEN 2 THEN '3' WHEN 3 THEN 'D' ELSE CAST(n AS VARCHAR) END AS extracted_answer, CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 4 THEN CAST(n AS VARCHAR) END AS canonicalized_answer, k NOT IN (3, 5) AS is_valid_answer,
  CASE k WHEN 3 THEN 'out_of_answer_space' WHEN 5 THEN 'unsupported_relation' ELSE 'valid' END AS canonicalization_status, CASE k WHEN 3 THEN 'out_of_answer_space' WHEN 5 THEN 'unsupported_relation' END AS invalid_reason FROM base""", views=False)
def status_fields(spark, sf_dir):
    k = F.col("p_partkey") % 6
    inverse = F.create_map(*[F.lit(x) for x in ("A", "C", "B", "A", "C", "B")])
    raw = F.when(k == 0, "a").when(k == 1, "(B)").when(k == 2, "3").when(k == 3, "D").otherwise(F.col("p_size").cast("string"))
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), N.canonicalize(raw, F.when(k < 4, "option letter").otherwise("number"), F.lit(3), inverse, F.when(k == 4, "identity").otherwise("option_permutation")).alias("d"))
    return rows.select("id", *R.status_fields(F.col("d"), F.col("raw")))


@query("""WITH c AS (SELECT question_id, answer, count(*) AS n, sum(confidence) AS m FROM pool WHERE answer IS NOT NULL GROUP BY ALL),
s AS (SELECT question_id, answer, CASE WHEN question_id % 2 = 0 THEN n / sum(n) OVER q WHEN sum(m) OVER q > 0 THEN CAST(m AS DOUBLE) / CAST(sum(m) OVER q AS DOUBLE) END AS score FROM c WINDOW q AS (PARTITION BY question_id))
SELECT question_id, answer, round(score, 9) AS score, CASE WHEN question_id % 2 = 0 THEN 'relsc' ELSE 'ssc' END AS score_name FROM s WHERE score IS NOT NULL""")
def typed_scores(spark, sf_dir):
    rows = pool(spark, sf_dir).withColumn("answer_type", F.when(F.col("question_id") % 2 == 0, "option letter").otherwise("Numeric"))
    return R.typed_scores(rows).select("question_id", "answer", F.round("score", 9).alias("score"), "score_name")


@query("""WITH sizes AS (SELECT question_id, pos % 3 AS c, count(*) AS n FROM pool WHERE answer IS NOT NULL GROUP BY ALL),
w AS (SELECT p.question_id, p.pos, p.answer, p.confidence, p.relation_weight, CASE WHEN p.answer IS NOT NULL THEN CAST(round(s.n ** -0.5, 9) AS DECIMAL(18,9)) ELSE 0 END AS d FROM pool p LEFT JOIN sizes s ON s.question_id = p.question_id AND s.c = p.pos % 3),
m AS (SELECT question_id, answer, sum(confidence * relation_weight * d) AS mass FROM w WHERE answer IS NOT NULL AND confidence IS NOT NULL GROUP BY ALL),
t AS (SELECT question_id, answer, CASE WHEN sum(mass) OVER (PARTITION BY question_id) > 0 THEN CAST(mass AS DOUBLE) / CAST(sum(mass) OVER (PARTITION BY question_id) AS DOUBLE) END AS relssc FROM m)
SELECT w.question_id, w.pos, CAST(w.d AS DOUBLE) AS dependency_weight, round(t.relssc, 9) AS relssc FROM w LEFT JOIN t ON t.question_id = w.question_id AND t.answer = w.answer""")
def attached_targets(spark, sf_dir):
    rows = R.attached(pool(spark, sf_dir).withColumn("cluster", F.col("pos") % 3), "cluster")
    return rows.select("question_id", "pos", F.col("dependency_weight").cast("double"), F.round("relssc", 9).alias("relssc"))


@query("""WITH s AS (SELECT l_linestatus AS tag, round(l_discount * 10, 6) AS p, l_returnflag = 'A' AS ok FROM lineitem WHERE l_tax <> 0.05 AND l_discount * 10 <= 1 + 1e-9),
e AS (SELECT tag, 100 * sum(abs(c - t)) / sum(n) AS ece FROM (SELECT tag, least(floor(p * 10), 9) AS b, count(*) AS n, sum(p) AS t, sum(CAST(ok AS INT)) AS c FROM s GROUP BY ALL) GROUP BY tag),
r AS (SELECT tag, ok, rank() OVER (PARTITION BY tag ORDER BY p) + (count(*) OVER (PARTITION BY tag, p) - 1) / 2 AS k FROM s),
a AS (SELECT tag, (sum(CASE WHEN ok THEN k END) - sum(CAST(ok AS INT)) * (sum(CAST(ok AS INT)) + 1) / 2) / (sum(CAST(ok AS INT)) * sum(CAST(NOT ok AS INT))) AS auroc FROM r GROUP BY tag)
SELECT tag, count(*) AS n, round(100 * avg(CAST(ok AS INT)), 6) AS accuracy, round(100 * avg((p - CAST(ok AS INT)) ** 2), 6) AS brier, round(any_value(ece), 6) AS ece, round(any_value(auroc), 6) AS auroc FROM s JOIN e USING (tag) JOIN a USING (tag) GROUP BY tag""", views=False)
def response_metrics(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("tag"), F.round(F.col("l_discount") * 10, 6).alias("confidence"), F.when(F.col("l_tax") != 0.05, F.col("l_returnflag") == "A").alias("is_correct"))
    return R.response_metrics(rows, ["tag"]).select("tag", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "brier", "ece", "auroc")])


@query("""WITH sums AS (SELECT question_id % 2 AS half, question_id, answer, count(*) AS n, min(pos) AS f, sum(confidence) AS m FROM pool WHERE pos < 16 AND answer IS NOT NULL GROUP BY ALL), size AS (SELECT question_id, count(*) AS n FROM pool GROUP BY ALL),
won AS (SELECT question_id, arg_max(answer, (n, -f)) AS sc FROM sums GROUP BY ALL), scored AS (SELECT g.question_id % 2 AS half, coalesce(z.n >= 16 AND w.sc = g.gold, FALSE) AS ok, least(coalesce(z.n, 0), 16) AS used FROM gold g LEFT JOIN won w USING (question_id) LEFT JOIN size z USING (question_id)),
t AS (SELECT half, 100 * avg(CAST(ok AS INT)) AS acc, avg(used) AS used FROM scored GROUP BY half)
SELECT 'SC' AS method, round(a.acc, 6) AS left_accuracy, round(a.used, 6) AS left_samples, round(b.acc, 6) AS right_accuracy, round(b.used, 6) AS right_samples, round(b.acc - a.acc, 6) AS delta_accuracy FROM t a JOIN t b ON a.half = 0 AND b.half = 1""")
def paired_reports(spark, sf_dir):
    half = lambda rows: rows.withColumn("half", F.col("question_id") % 2)
    report = V.evaluate(half(pool(spark, sf_dir)), half(gold(spark, sf_dir)), SETTINGS, by=["half"], row_types=["fixed_budget"], methods=["SC"], tasks=tasks(read(spark, sf_dir, "lineitem")))
    out = R.paired_reports(report.where("half = 0"), report.where("half = 1"), 16, ["method"])
    return out.select("method", *[F.round(c, 6).alias(c) for c in ("left_accuracy", "left_samples", "right_accuracy", "right_samples", "delta_accuracy")])


@query("""WITH t AS (SELECT o_orderkey AS k, o_custkey % 3 AS d, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 50 END AS q, o_orderpriority AS w FROM orders), g AS (SELECT *, coalesce(CAST(q AS VARCHAR), substr(sha256(d || chr(0) || d || chr(0) || w), 1, 20)) AS key FROM t)
SELECT CAST(d AS VARCHAR) AS dataset_name, key AS group_key, count(*) AS n, min(k) AS first FROM g GROUP BY ALL""", views=False)
def grouped_payloads(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 3).cast("string").alias("dataset_name"), F.when(F.col("o_orderkey") % 2 == 0, (F.col("o_custkey") % 50).cast("string")).otherwise("").alias("question_id"), (F.col("o_custkey") % 3).cast("string").alias("source_index"), F.col("o_orderpriority").alias("original_question"),
        F.array(F.struct(F.col("o_orderkey").alias("k"))).alias("samples"), F.concat(F.lit("f"), (F.col("o_orderkey") % 4).cast("string")).alias("source_file"),
    )
    out = artifacts.grouped_payloads(rows)
    return out.select("dataset_name", "group_key", F.size("samples").cast("long").alias("n"), F.array_min(F.transform("samples", lambda s: s["k"])).alias("first"))


@query("""WITH r AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM conversations)
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'deepseek' WHEN 1 THEN 'llama' WHEN 2 THEN 'qwen' END AS family, CASE turn % 4 WHEN 0 THEN 2048 WHEN 1 THEN 1024 WHEN 2 THEN 1024 END AS max_new_tokens, 'why ' || turn || ' x' AS stem, CASE turn % 3 WHEN 0 THEN ['one', 'two ' || turn] ELSE [] END AS options,
  substr(sha256('x<｜Assistant｜>'), 1, 8) AS bare FROM r""", views=False)
def prompts(spark, sf_dir):
    turn = F.col("turn")
    name = F.when(turn % 4 == 0, "org/DeepSeek-R1-Distill-Llama").when(turn % 4 == 1, "Llama-3").when(turn % 4 == 2, "QWEN2").otherwise("other")
    body = F.concat(F.lit("Question: why "), turn.cast("string"), F.lit(" x"), F.when(turn % 3 == 0, F.concat(F.lit("\nOptions:\nA) one\nb. two "), turn.cast("string"))).otherwise(""))
    chat = F.concat(F.lit("<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n"), body, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", P.model_family(name).alias("family"), chat.alias("chat"), F.when(turn % 2 == 0, "x<｜Assistant｜><think>\n").otherwise("x<｜Assistant｜>").alias("ended"))
    rows = rows.withColumn("parts", P.question_and_options(F.col("chat"))).withColumn("limits", P.generation_limits(F.col("family")))
    return rows.select("conv_id", "turn", "family", F.col("limits.max_new_tokens").alias("max_new_tokens"), F.col("parts.stem").alias("stem"), F.col("parts.options").alias("options"), F.substring(F.sha2(P.without_forced_think(F.col("ended")), 256), 1, 8).alias("bare"))


@query("""WITH r AS (SELECT question_id, pos, CAST(confidence AS DOUBLE) AS c FROM pool)
SELECT question_id, pos, CASE WHEN pos % 3 = 0 THEN 0.25 WHEN pos % 3 = 1 THEN 0.75 ELSE c END AS score, CASE WHEN pos % 3 = 0 THEN 'cisc_confidence' WHEN pos % 3 = 1 THEN 'base_confidence' WHEN c IS NOT NULL THEN 'confidence' END AS source,
  round(-(ln(2 * 0.5) + ln(2.0 / (pos + 2))) / 2, 9) AS certainty FROM r""")
def method_scores(spark, sf_dir):
    pos = F.col("pos")
    rows = pool(spark, sf_dir).select("question_id", "pos", "confidence", F.when(pos % 3 == 0, 0.25).when(pos % 3 == 1, float("nan")).alias("cisc_confidence"), F.when(pos % 3 != 2, 0.75).alias("base_confidence"))
    score, source = S.method_score(rows.columns, "informed", F.col("confidence"))
    vectors = F.array(F.array(F.lit(0.5), 1.0 / (pos + 2)))
    return rows.select("question_id", "pos", score.alias("score"), source.alias("source"), F.round(S.self_certainty(vectors, F.lit(2), logs=False), 9).alias("certainty"))


@query("""WITH r AS (SELECT o_custkey AS chunk, CAST(o_orderkey AS VARCHAR) AS q, o_orderkey AS o, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT chunk, count(*) AS questions, CAST(sum(n) AS BIGINT) AS samples, sha256(string_agg(q || chr(0), '' ORDER BY o)) AS digest FROM r GROUP BY chunk""", views=False)
def chunk_summary(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"))
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("chunk"), F.col("o_orderkey").alias("o"), F.col("o_orderkey").cast("string").alias("q")).join(lines, "o")
    return K.chunk_summary(rows, "chunk", "q", "o")


@query("""WITH v AS (SELECT p_partkey AS k, unnest(range(0, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 4 END)) AS view_index, CASE p_partkey % 3 WHEN 0 THEN 32 WHEN 1 THEN 16 ELSE 8 END AS per FROM part)
SELECT k, count(DISTINCT view_index) AS views, CAST(sum(per) AS BIGINT) AS samples, CAST(sum(per) // 2 AS BIGINT) AS valid, CAST(31 AS BIGINT) AS last FROM v GROUP BY k""", views=False)
def expanded_samples(spark, sf_dir):
    """Profiles to views to samples, and back to one row a question."""
    k = F.col("p_partkey")
    n = F.when(k % 3 == 1, 2).otherwise(F.when(k % 3 == 0, 0).otherwise(3))
    rows = read(spark, sf_dir, "part").select(k.alias("question_id"), W.sampling_profile(F.when(k % 3 == 0, "Numeric").otherwise("option letter"), n).alias("p"))
    views = rows.select("question_id", F.col("p.per_view").alias("per_view"), F.explode(F.sequence(F.lit(0), F.col("p.views") - 1)).alias("view_index"))
    samples = W.expand_samples(views, F.col("per_view")).withColumn("is_valid_answer", F.col("sample_index") % 2 == 0)
    done = W.rolled_up(samples.drop("per_view")).withColumnRenamed("samples", "rows")
    whole = F.transform("rows", lambda s: s["view_index"] * F.size("rows") + s["sample_index"])
    sorted_ = F.when(F.array_sort(whole) == whole, 31).otherwise(-1).cast("long")
    return done.select(F.col("question_id").alias("k"), F.size(F.array_distinct(F.transform("rows", lambda s: s["view_index"]))).cast("long").alias("views"), F.col("attempted_budget").alias("samples"), F.col("valid_responses").alias("valid"), sorted_.alias("last"))


@query("""SELECT o_orderkey AS i, o_orderkey // 100 AS batch, o_orderkey % 7 = 3 AS mine FROM orders""", views=False)
def shards_and_batches(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"))
    mine = D.shard(rows, "i", 7, 3).withColumn("mine", F.lit(True))
    return rows.join(mine, "i", "left").select("i", D.batch_of("i", 100).alias("batch"), F.coalesce("mine", F.lit(False)).alias("mine"))


@query("""WITH t AS (SELECT question_id, pos, 'calibration' AS task FROM pool WHERE pos < 2 UNION ALL SELECT question_id, pos, 'causal_lm' FROM pool WHERE pos = 5)
SELECT question_id, pos, task, substr(sha256('3' || chr(0) || task || chr(0) || question_id), 1, 32) AS shuffle_key FROM t""")
def task_mix(spark, sf_dir):
    rows = pool(spark, sf_dir).select("question_id", "pos")
    return T.task_mix(rows.where("pos < 2"), rows.where("pos = 5"), "question_id", 3)


@query("""SELECT status, count(*) AS rows FROM (SELECT 'missing' AS status, o_custkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL HAVING o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1)
UNION ALL SELECT 'unexpected', o_custkey FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL HAVING o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)) GROUP BY status""", views=False)
def align_warnings(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return M.align_warnings(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), "o_custkey")


@query("""SELECT c.o_orderkey AS k, n.n_name AS other_name FROM orders c JOIN nation n ON c.o_custkey % 25 = n.n_nationkey""", views=False)
def aligned_by_fallback(spark, sf_dir):
    """No id is shared, so rows meet by the fallback."""
    left = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), (F.col("o_custkey") % 25).alias("source"))
    right = read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("long").alias("source"), F.col("n_name").alias("name"))
    return M.align(left, right, "id", "source").select("k", "other_name")
