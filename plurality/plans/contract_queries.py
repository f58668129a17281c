"""Contracts, coverage, matching and guards over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurality.functions import answers as A
from plurality.functions import guards as G
from plurality.functions import views as V
from plurality.operators import contracts as K
from plurality.operators import matching as M
from plurality.operators import sampling as T
from plurality.operators import selection as L
from plurality.plans.registry import query
from plurality.sources import artifacts
from plurality.sources.adapters import pool, read

PAYLOAD_SQL = """q AS (SELECT p_partkey AS question_id, CASE p_partkey % 5 WHEN 0 THEN 'gsm8k' ELSE 'sciq' END AS dataset_name, p_partkey % 5 = 0 AS number,
  CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 4 END AS num_views, CASE WHEN p_partkey % 5 = 0 THEN 32 WHEN p_partkey % 7 = 0 THEN 4 ELSE 8 END AS per, CASE WHEN p_partkey % 7 = 0 AND p_partkey % 5 <> 0 THEN 16 ELSE 32 END AS budget FROM part),
counts AS (SELECT l_partkey AS question_id, count(*) AS records, list_sort(list(DISTINCT 'g' || CAST((l_linenumber - 1) % 4 AS VARCHAR))) AS relations FROM lineitem GROUP BY ALL),
cells AS (SELECT question_id, min(n) AS low, max(n) AS high FROM (SELECT l_partkey AS question_id, (l_linenumber - 1) % 4 AS v, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL)"""


def _payloads(spark, sf_dir):
    """Parts as questions, their lines as samples, with mistakes planted by arithmetic."""
    key, number = F.col("p_partkey"), F.col("p_partkey") % 5 == 0
    short = (key % 7 == 0) & ~number
    questions = read(spark, sf_dir, "part").select(
        key.alias("question_id"), F.when(number, "gsm8k").otherwise("sciq").alias("dataset_name"), F.when(number, "number").otherwise("option letter").alias("answer_type"), F.when(number, 1).otherwise(4).alias("num_views"),
        F.when(number, 32).when(short, 4).otherwise(8).alias("samples_per_view"), F.when(short, 16).otherwise(32).alias("attempted_budget"),
    )
    view, own = F.pmod(F.col("l_linenumber") - 1, F.lit(4)), F.col("l_partkey") % 5 == 0
    swapped = F.when(own, F.array().cast("array<int>")).when(view == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1), F.lit(0)))
    tax = F.round(F.col("l_tax") * 100).cast("int")
    samples = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("question_id"), F.when(own, "gsm8k").when(tax == 8, "other").otherwise("sciq").alias("dataset_name"), F.concat_ws("-", "l_orderkey", F.col("l_suppkey") % 2).alias("sample_id"), F.concat(F.lit("g"), view.cast("string")).alias("relation_id"),
        F.lit("identity").alias("relation_type"), F.when(tax == 7, view + 1).otherwise(view).cast("long").alias("view_index"), F.when(own, "number").otherwise("option letter").alias("answer_type"), F.when(own, "7.0").otherwise("A").alias("extracted_answer"),
        F.when(own, F.when(tax == 6, "8").otherwise("7")).when((view == 0) | (tax == 6), "A").otherwise("B").alias("canonicalized_answer"), F.when(tax == 5, None).otherwise(tax != 4).alias("is_valid_answer"), F.when(tax != 3, 0.5).alias("confidence"),
        F.when(tax == 2, 0.5).otherwise(1.0).alias("relation_weight"), F.lit(None).cast("double").alias("dependency_weight"), swapped.alias("sources"), F.when(~own, F.array(F.lit("x"), F.lit("y"))).alias("original_options"),
        F.when(~own, F.when((view == 0) | (tax == 1), F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("y"), F.lit("x")))).alias("transformed_options"),
    )
    return questions, samples


@query(f"""WITH {PAYLOAD_SQL}, j AS (SELECT q.*, coalesce(c.records, 0) AS records, coalesce(array_to_string(c.relations, ','), '') AS relations, low, high FROM q LEFT JOIN counts c USING (question_id) LEFT JOIN cells USING (question_id))
SELECT question_id, 'record_count' AS rule, CAST(records AS VARCHAR) AS detail FROM j WHERE records <> budget
UNION ALL SELECT question_id, 'relations', relations FROM j WHERE NOT coalesce(relations = CASE WHEN number THEN 'g0' ELSE 'g0,g1,g2,g3' END AND low = per AND high = per, FALSE)
UNION ALL SELECT question_id, 'formal_profile', num_views || 'x' || per FROM j WHERE (num_views, per) <> (CASE WHEN number THEN 1 ELSE 4 END, CASE WHEN number THEN 32 ELSE 8 END)""", views=False)
def payload_budgets(spark, sf_dir):
    return K.question_violations(*_payloads(spark, sf_dir))


@query("""WITH s AS (SELECT l_partkey AS question_id, l_partkey % 5 = 0 AS number, (l_linenumber - 1) % 4 AS v, CAST(round(l_tax * 100) AS INT) AS tax, l_orderkey || '-' || (l_suppkey % 2) AS id FROM lineitem), rules AS (
  SELECT question_id, 'other_set' AS rule, id FROM s WHERE NOT number AND tax = 8 UNION ALL SELECT question_id, 'view_of_relation', id FROM s WHERE tax = 7 UNION ALL SELECT question_id, 'number_not_identity', id FROM s WHERE number AND v > 0
  UNION ALL SELECT question_id, 'no_flag', id FROM s WHERE tax = 5 UNION ALL SELECT question_id, 'stored_answer', id FROM s WHERE tax = 6 AND (number OR v > 0) UNION ALL SELECT question_id, 'stored_invalid', id FROM s WHERE tax = 4
  UNION ALL SELECT question_id, 'shown_options', id FROM s WHERE NOT number AND tax = 1 AND v > 0 UNION ALL SELECT question_id, 'no_confidence', id FROM s WHERE tax = 3 UNION ALL SELECT question_id, 'weights_not_one', id FROM s WHERE tax = 2
  UNION ALL SELECT question_id, 'repeated_sample', id FROM s GROUP BY question_id, id HAVING count(*) > 1)
SELECT rule, count(*) AS rows, count(DISTINCT question_id) AS questions, min(id) AS first FROM rules GROUP BY rule""", views=False)
def payload_samples(spark, sf_dir):
    found = K.sample_violations(*_payloads(spark, sf_dir))
    return found.groupBy("rule").agg(F.count("*").alias("rows"), F.count_distinct("question_id").alias("questions"), F.min("detail").alias("first"))


@query("""WITH m AS (SELECT o_custkey AS source, count(*) AS found, count(DISTINCT o_orderpriority) AS kinds FROM orders GROUP BY ALL)
SELECT CAST(source AS VARCHAR) AS source, 'incomplete' AS rule FROM m WHERE source % 11 = 0 UNION ALL SELECT CAST(source AS VARCHAR), 'samples' FROM m WHERE source % 7 = 0 UNION ALL SELECT CAST(source AS VARCHAR), 'expected_samples' FROM m WHERE source % 7 = 0
UNION ALL SELECT CAST(source AS VARCHAR), 'questions' FROM m WHERE source % 13 = 0 UNION ALL SELECT CAST(source AS VARCHAR), 'repeated_sample' FROM (SELECT o_custkey AS source FROM orders WHERE o_custkey % 3 = 0 GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'group ' || g, 'missing_shards' FROM (SELECT source // 50 AS g, count(DISTINCT source % 50) AS have FROM m GROUP BY ALL HAVING count(DISTINCT source % 50) <> 50)""", views=False)
def manifest_violations(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").withColumn("source", F.col("o_custkey"))
    rows = orders.select(F.col("source").cast("string").alias("source"), F.when(F.col("source") % 3 == 0, F.col("source")).otherwise(F.col("o_orderkey")).cast("string").alias("sample_id"), F.col("o_orderpriority").alias("question_id"))
    key, n = F.col("source"), F.col("found")
    sizes = orders.groupBy("source").agg(F.count("*").alias("found"), F.count_distinct("o_orderpriority").alias("kinds"))
    manifests = sizes.select(
        key.cast("string").alias("source"), (key % 11 != 0).alias("complete"), F.when(key % 7 == 0, n + 1).otherwise(n).alias("samples"), n.alias("expected_samples"), F.when(key % 13 == 0, F.col("kinds") + 1).otherwise(F.col("kinds")).alias("questions"),
        F.concat(F.lit("group "), F.floor(key / 50).cast("string")).alias("group"), (key % 50).alias("shard"), F.lit(50).alias("shards"),
    )
    return artifacts.manifest_violations(spark, manifests, rows)


@query("""WITH c AS (SELECT o_orderkey AS id, o_custkey % 40 AS a, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 90 END AS b, o_orderpriority AS w FROM orders),
qs AS (SELECT n_nationkey AS qid, CASE WHEN n_nationkey < 15 THEN n_nationkey * 2 END AS a, n_nationkey % 20 AS b, CASE WHEN n_nationkey % 9 = 0 THEN '1-URGENT' WHEN n_nationkey = 5 THEN '5-LOW' END AS w FROM nation),
la AS (SELECT a, count(*) AS n, min(qid) AS q FROM qs WHERE a IS NOT NULL GROUP BY a), lb AS (SELECT b, count(*) AS n, min(qid) AS q FROM qs GROUP BY b), lw AS (SELECT w, count(*) AS n, min(qid) AS q FROM qs WHERE w IS NOT NULL GROUP BY w)
SELECT id, CASE WHEN la.n IS NOT NULL THEN CASE WHEN la.n = 1 THEN la.q END WHEN lb.n IS NOT NULL THEN CASE WHEN lb.n = 1 THEN lb.q END WHEN lw.n = 1 THEN lw.q END AS match,
  CASE WHEN la.n IS NOT NULL THEN 'a' WHEN lb.n IS NOT NULL THEN 'b' WHEN lw.n IS NOT NULL THEN 'w' END AS level, coalesce(la.n, lb.n, lw.n, 0) AS hits FROM c LEFT JOIN la USING (a) LEFT JOIN lb USING (b) LEFT JOIN lw USING (w)""", views=False)
def cascade_match(spark, sf_dir):
    key = F.col("o_custkey")
    candidates = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (key % 40).alias("a"), F.when(F.col("o_orderkey") % 3 == 0, key % 90).alias("b"), F.col("o_orderpriority").alias("w"))
    n = F.col("n_nationkey")
    questions = read(spark, sf_dir, "nation").select(n.alias("qid"), F.when(n < 15, n * 2).alias("a"), (n % 20).alias("b"), F.when(n % 9 == 0, "1-URGENT").when(n == 5, "5-LOW").alias("w"))
    return M.cascade(candidates, questions, ["a", "b", "w"], "id", "qid")


@query("""WITH v AS (SELECT l_partkey AS k, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_partkey % 3 + CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END END AS gold FROM lineitem)
SELECT k, min(gold) AS low, max(gold) AS high, count(*) FILTER (WHERE gold IS NULL) AS nulls FROM v GROUP BY k HAVING min(gold) <> max(gold) OR (min(gold) IS NOT NULL AND count(*) FILTER (WHERE gold IS NULL) > 0)""", views=False)
def conflicting_gold(spark, sf_dir):
    value = F.when(F.col("l_linenumber") != 7, F.col("l_partkey") % 3 + F.when(F.col("l_tax") == 0.08, 1).otherwise(0))
    return M.conflicting_values(read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), value.alias("gold")), "k", "gold")


@query("""WITH s AS (SELECT l_suppkey % 20 AS source, l_suppkey % 20 % 2 = 0 AS disjoint, count(*) AS questions FROM lineitem GROUP BY l_suppkey, l_suppkey % 20)
SELECT source, CAST(CASE WHEN bool_and(disjoint) THEN sum(questions) ELSE max(questions) END AS BIGINT) AS questions FROM s GROUP BY source""", views=False)
def expected_questions(spark, sf_dir):
    shards = read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("questions"))
    source = F.col("l_suppkey") % 20
    return M.expected_questions(shards.select(source.alias("source"), (source % 2 == 0).alias("disjoint"), "questions"))


@query("""WITH s AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM orders)
SELECT k, list_sort(list(DISTINCT split)) AS splits FROM s GROUP BY k HAVING count(DISTINCT split) > 1""", views=False)
def split_leaks(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 4 == 0, "test").otherwise("train").alias("split"))
    return M.leaks(rows, "k")


GUARD_RAW = """CASE l_linenumber WHEN 1 THEN '0.5' WHEN 2 THEN 'NaN' WHEN 3 THEN '-0.25' WHEN 4 THEN ' b ' WHEN 5 THEN 'N/A' WHEN 6 THEN '7.0' ELSE NULL END"""


@query(f"""WITH r AS (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, {GUARD_RAW} AS raw, CASE l_partkey % 4 WHEN 0 THEN ' Yes' WHEN 1 THEN 'INVALID' WHEN 2 THEN 'perhaps' END AS flag FROM lineitem)
SELECT id, line, part, CAST(CASE line WHEN 1 THEN 0.5 WHEN 3 THEN -0.25 WHEN 6 THEN 7.0 END AS DOUBLE) AS finite, CAST(CASE line WHEN 1 THEN 0.5 END AS DOUBLE) AS probability, CAST(CASE line WHEN 1 THEN 0.5 WHEN 6 THEN 7.0 END AS DOUBLE) AS non_negative,
  CASE part % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 3 THEN TRUE END AS flag, CASE line WHEN 1 THEN '0.5' WHEN 2 THEN 'NaN' WHEN 3 THEN '-0.25' WHEN 4 THEN 'B' WHEN 6 THEN '7.0' END AS answer_key,
  CASE line WHEN 1 THEN '0.5' WHEN 2 THEN 'NAN' WHEN 3 THEN '-0.25' WHEN 4 THEN 'B' WHEN 5 THEN 'N/A' WHEN 6 THEN '7' END AS answer_upper, CASE line WHEN 1 THEN '0.5' WHEN 2 THEN 'NaN' WHEN 3 THEN '-0.25' WHEN 4 THEN 'B' WHEN 5 THEN 'N/A' WHEN 6 THEN '7.0' END AS answer_letter FROM r""", views=False)
def guards(spark, sf_dir):
    line = F.col("l_linenumber")
    raw = F.when(line == 1, "0.5").when(line == 2, "NaN").when(line == 3, "-0.25").when(line == 4, " b ").when(line == 5, "N/A").when(line == 6, "7.0")
    part = F.col("l_partkey") % 4
    word = F.when(part == 0, " Yes").when(part == 1, "INVALID").when(part == 2, "perhaps")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), line.alias("line"), F.col("l_partkey").alias("part"), raw.alias("raw"), word.alias("word"))
    r = F.col("raw")
    return rows.select("id", "line", "part", G.finite(r).alias("finite"), G.probability(r).alias("probability"), G.non_negative(r).alias("non_negative"), G.flag(F.col("word"), True).alias("flag"), G.answer_key(r).alias("answer_key"), G.answer_upper(r).alias("answer_upper"), G.answer_letter(r).alias("answer_letter"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 4 AS t, o_orderkey % 3 AS v, o_custkey % 3 AS g FROM orders)
SELECT id, CASE WHEN t < 3 THEN t = 0 WHEN v < 2 THEN v = 0 WHEN g < 2 THEN g = 0 ELSE TRUE END AS by_type, CASE WHEN t = 0 THEN TRUE WHEN v < 2 THEN v = 0 WHEN g < 2 THEN g = 0 ELSE TRUE END AS by_any, CASE WHEN g < 2 THEN g = 0 ELSE TRUE END OR t = 0 AS by_id FROM r""", views=False)
def identity_rules(spark, sf_dir):
    key, cust = F.col("o_orderkey"), F.col("o_custkey") % 3
    kind = F.when(key % 4 == 0, "identity").when(key % 4 < 3, "layout_wrapper")
    view, relation = F.when(key % 3 < 2, key % 3), F.when(cust < 2, F.concat(F.lit("g"), cust.cast("string")))
    return read(spark, sf_dir, "orders").select(key.alias("id"), G.identity_by_type_first(kind, view, relation).alias("by_type"), G.identity_by_any(kind, view, relation).alias("by_any"), G.identity_by_id_or_type(kind, relation).alias("by_id"))


@query("""SELECT conv_id, turn, lower(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ')) AS text_key, CASE turn % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'E' WHEN 2 THEN 'C' ELSE 'X' || turn END AS label,
  CASE turn % 4 WHEN 0 THEN 1000 + turn || '' WHEN 1 THEN turn || '.5' WHEN 2 THEN '-' || turn END AS gold, ['p' || turn, 'q r'] AS options FROM conversations""", views=False)
def gold_texts(spark, sf_dir):
    turn = F.col("turn")
    label = F.when(turn % 7 == 0, " 1").when(turn % 7 == 1, "e ").when(turn % 7 == 2, "3").otherwise(F.concat(F.lit("x"), turn.cast("string")))
    n = turn.cast("string")
    marked = F.when(turn % 4 == 0, F.concat(F.lit("5 so\n#### $"), F.format_number(turn + 1000, 0))).when(turn % 4 == 1, F.concat(F.lit("first 3, last "), n, F.lit(".5"))).when(turn % 4 == 2, F.concat(F.lit("#### -"), n)).otherwise("none")
    options = F.concat(F.lit("a ) p"), n, F.lit(" , b ) q r"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", A.text_key(F.coalesce("text", F.lit(""))).alias("text_key"), A.arc_label(label).alias("label"), A.marked_gold(marked).alias("gold"), A.option_texts(options).alias("options"))


@query("""WITH w AS (SELECT p_partkey AS k, p_partkey % 100 AS n, p_partkey % 4 AS form FROM part), named AS (SELECT *, ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS small FROM w)
SELECT k, CAST(CASE form WHEN 0 THEN n % 20 WHEN 1 THEN 100 * (1 + n % 9) + n % 20 WHEN 2 THEN -1000 * (1 + n % 19) END AS BIGINT) AS value FROM named""", views=False)
def number_words(spark, sf_dir):
    k = F.col("p_partkey")
    n = k % 100
    small = F.array(*map(F.lit, A.SMALL))
    word = lambda i: F.get(small, i.cast("int"))
    text = F.when(k % 4 == 0, F.concat(word(n % 20), F.lit(" apples"))).when(k % 4 == 1, F.concat(word(1 + n % 9), F.lit(" hundred and "), word(n % 20))).when(k % 4 == 2, F.concat(F.lit("minus "), word(1 + n % 19), F.lit("-thousand"))).otherwise("apples")
    return read(spark, sf_dir, "part").select(k.alias("k"), A.number_words(text).alias("value"))


@query("""WITH r AS (SELECT l_partkey AS k, l_orderkey AS id, l_linenumber AS line, l_discount AS d, l_tax AS t FROM lineitem)
SELECT k, id, line, round(exp(-d) + exp(-1 - t), 9) AS yes, round(exp(-2.0), 9) AS no FROM r""", views=False)
def yes_no_probability(spark, sf_dir):
    token = lambda name, p: F.struct(F.lit(name).alias("token"), p.alias("logprob"))
    tokens = F.array(token("Yes", -F.col("l_discount")), token(" Yes", -1 - F.col("l_tax")), token("No", F.lit(-2.0)), token("maybe", F.lit(-3.0)))
    done = A.yes_no_probability(tokens)
    return read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(done["yes"], 9).alias("yes"), F.round(done["no"], 9).alias("no"))


@query("""WITH a AS (SELECT CAST(n_nationkey % 4 AS BIGINT) AS t, ['ASC', 'ESC', 'odd'][CAST(n_nationkey % 3 AS INT) + 1] AS method, CAST(n_nationkey AS DOUBLE) AS parameter, CASE WHEN n_nationkey % 3 = 1 THEN 'window_size' ELSE 'confidence_threshold' END AS kind, CASE WHEN n_nationkey = 24 THEN 9 ELSE 8 END AS cap FROM nation),
rules AS (SELECT CASE WHEN method = 'odd' THEN 'unknown_method' WHEN kind = 'window_size' AND NOT (parameter BETWEEN 2 AND 8) THEN 'bad_window' WHEN kind <> 'window_size' AND NOT (parameter BETWEEN 0 AND 1) THEN 'bad_threshold' WHEN cap <> 8 THEN 'other_cap' END AS rule, method, t FROM a)
SELECT rule, method, t AS target FROM rules WHERE rule IS NOT NULL
UNION ALL SELECT 'not_exactly_once', coalesce(w.method, g.method), coalesce(w.t, g.t) FROM (SELECT m AS method, x AS t FROM (VALUES ('ASC'), ('ESC')) a(m), (VALUES (0::BIGINT), (1::BIGINT)) b(x)) w FULL JOIN (SELECT method, t, count(*) AS n FROM a GROUP BY ALL) g ON w.method = g.method AND w.t = g.t WHERE coalesce(n, 0) <> 1""", views=False)
def artifact_violations(spark, sf_dir):
    n = F.col("n_nationkey")
    method = F.get(F.array(*map(F.lit, ["ASC", "ESC", "odd"])), (n % 3).cast("int"))
    kind = F.when(n % 3 == 1, "window_size").otherwise("confidence_threshold")
    rows = read(spark, sf_dir, "nation").select((n % 4).cast("long").alias("target"), method.alias("method"), n.cast("double").alias("parameter"), kind.alias("parameter_type"), F.when(n == 24, 9).otherwise(8).alias("cap"))
    return L.artifact_violations(rows, ["ASC", "ESC"], [0, 1], 8)


@query("""WITH r AS (SELECT question_id, pos, answer, CAST(confidence AS DOUBLE) AS c, CAST(fragility AS DOUBLE) AS f FROM pool)
SELECT question_id, pos, coalesce(c > 0.75, FALSE) AS by_ssc, coalesce(c > 0.5 AND f < 0.3, FALSE) AS robust, coalesce(f > 0.75, FALSE) AS by_field, round(CASE WHEN abs(c - f) < 1 THEN (c - f) ** 2 / 2 ELSE abs(c - f) - 0.5 END, 9) AS smooth,
  round(-(f * ln(least(greatest(c, 0.000001), 0.999999)) + (1 - f) * ln(1 - least(greatest(c, 0.000001), 0.999999))), 6) AS entropy FROM r""")
def admission_and_losses(spark, sf_dir):
    c, f = F.col("confidence").cast("double"), F.col("fragility").cast("double")
    return pool(spark, sf_dir).select(
        "question_id", "pos", T.admitted("ssc", c, c, f).alias("by_ssc"), T.admitted("robust", c, c, f).alias("robust"), T.admitted("field", c, c, f, named=f).alias("by_field"), F.round(T.smooth_l1(c, f), 9).alias("smooth"), F.round(T.binary_cross_entropy(c, f), 6).alias("entropy")
    )


@query("""SELECT 'calibration' AS task, count(*) AS records, round(avg(CAST(confidence AS DOUBLE)), 6) AS loss FROM pool WHERE pos % 2 = 0 AND confidence IS NOT NULL UNION ALL SELECT 'causal_lm', count(*), round(avg(CAST(confidence AS DOUBLE)), 6) FROM pool WHERE pos % 2 = 1 AND confidence IS NOT NULL
UNION ALL SELECT 'all', count(*), round(avg(CAST(confidence AS DOUBLE)), 6) FROM pool WHERE confidence IS NOT NULL""")
def task_losses(spark, sf_dir):
    rows = pool(spark, sf_dir).select("pos", F.col("confidence").cast("double").alias("loss"), F.when(F.col("pos") % 2 == 0, "calibration").otherwise("causal_lm").alias("task"))
    return T.mixed_loss(rows).withColumn("loss", F.round("loss", 6))


@query("""WITH b AS (SELECT p_partkey AS k, 6 + p_partkey % 5 AS n FROM part) SELECT k, CAST(v AS BIGINT) AS view_index, TRUE AS is_order, TRUE AS is_new, v = 0 AS is_identity FROM b, range(0, 6) t(v) UNION ALL SELECT -k, 0, TRUE, TRUE, TRUE FROM b WHERE k % 2 = 0 UNION ALL SELECT -k, 0, TRUE, TRUE, TRUE FROM b WHERE k % 2 = 1""", views=False)
def many_option_views(spark, sf_dir):
    """Orders of 6 to 10 options, and of one or none: what they are is what SQL can say."""
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part")
    some = part.select(k.alias("k"), F.transform(F.sequence(F.lit(1), (6 + k % 5).cast("int")), lambda i: i.cast("string")).alias("options"))
    few = part.select((-k).alias("k"), F.when(k % 2 == 0, F.array(F.lit("x"))).alias("options"))
    out = V.option_views(some.unionByName(few), 6, 3, key="k")
    seen = F.row_number().over(V.Window.partitionBy("k", F.concat_ws(",", "sources")).orderBy("view_index")) == 1
    plain = F.when(F.size("sources") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size("sources"), F.lit(1)) - 1), lambda i: i.cast("int"))).otherwise(F.array().cast("array<int>"))
    return out.select("k", "view_index", (F.array_sort("sources") == plain).alias("is_order"), seen.alias("is_new"), (F.col("sources") == plain).alias("is_identity"))
