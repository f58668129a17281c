"""Answer parsing, normalisation, option views and strategy clusters over driver tables."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from plurality.functions import answers as A
from plurality.functions import hashing as H
from plurality.functions import normalize as N
from plurality.functions import views as V
from plurality.operators import controller as K
from plurality.plans.registry import query
from plurality.sources.adapters import read

#: Five spellings of an answer field, by id; the expected value is known by construction.
PARSE_SQL = """WITH base AS (SELECT p_partkey AS id, p_size AS n, chr(CAST(65 + p_partkey % 5 AS INT)) AS letter, p_partkey % 6 AS form FROM part)
SELECT id, CASE form WHEN 0 THEN letter WHEN 1 THEN letter WHEN 2 THEN CAST(n AS VARCHAR) WHEN 3 THEN CAST(1000 + n AS VARCHAR) WHEN 4 THEN letter END AS answer FROM base"""


@query(PARSE_SQL, views=False)
def parse_answer(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("n"), F.char(65 + F.col("p_partkey") % 5).alias("letter"), (F.col("p_partkey") % 6).alias("form"), F.col("p_name").alias("words"))
    form, letter = F.col("form"), F.col("letter")
    text = (
        F.when(form == 0, F.concat("words", F.lit("\nAnswer: ("), letter, F.lit(")")))
        .when(form == 1, F.concat(F.lit("Answer: E is a guess\n**Final answer:** \\boxed{"), F.lower(letter), F.lit("} done")))
        .when(form == 2, F.concat("words", F.lit("\nanswer: $"), "n", F.lit(".")))
        .when(form == 3, F.concat(F.lit("Answer: 7\nso Answer: 1,0"), F.lpad("n", 2, "0"), F.lit(" apples\nAnswer:")))
        .when(form == 4, F.concat(F.lit("Answer: 0.036 ("), letter, F.lit(")")))
        .otherwise(F.concat("words", F.lit(" the answer is "), letter))
    )
    dataset = F.when(form.isin(2, 3), "svamp").otherwise("math_qa")
    return rows.select("id", A.explicit_answer(dataset, text, F.lit(None).cast("string")).alias("answer"))


@query("""WITH base AS (SELECT l_orderkey AS id, l_partkey AS part, l_linenumber AS line, CASE l_linenumber % 7 WHEN 0 THEN 'Answer is: (' || substr(l_returnflag, 1, 1) || ')' WHEN 1 THEN CAST(l_linenumber AS VARCHAR) || '.0' WHEN 2 THEN ' [c] ' WHEN 3 THEN '' WHEN 4 THEN 'two' WHEN 5 THEN '9' ELSE NULL END AS raw, l_returnflag AS flag FROM lineitem)
SELECT id, part, line, CASE line % 7 WHEN 0 THEN CASE WHEN flag = 'A' THEN 'A' END WHEN 1 THEN 'A' WHEN 2 THEN 'C' END AS normalized,
  CASE line % 7 WHEN 0 THEN CASE WHEN flag = 'A' THEN 'valid' ELSE 'out_of_answer_space' END WHEN 1 THEN 'valid' WHEN 2 THEN 'valid' WHEN 4 THEN 'invalid_format' WHEN 5 THEN 'out_of_answer_space' ELSE 'missing_answer' END AS status FROM base""", views=False)
def normalize_option(spark, sf_dir):
    line, flag = F.col("l_linenumber"), F.substring("l_returnflag", 1, 1)
    raw = F.when(line % 7 == 0, F.concat(F.lit("Answer is: ("), flag, F.lit(")"))).when(line % 7 == 1, F.concat(line.cast("string"), F.lit(".0"))).when(line % 7 == 2, " [c] ").when(line % 7 == 3, "").when(line % 7 == 4, "two").when(line % 7 == 5, "9")
    done = N.normalize_option(raw, F.lit(5))
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), line.alias("line"), done["normalized"].alias("normalized"), done["status"].alias("status"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) WHEN 1 THEN CASE WHEN o_orderkey = 1 THEN '-1.5' ELSE '-' || CAST(o_orderkey AS VARCHAR) || '.5' END WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || '00' END AS normalized,
  CASE WHEN o_orderkey % 4 = 3 THEN 'invalid_format' ELSE 'valid' END AS status FROM orders""", views=False)
def normalize_numeric(spark, sf_dir):
    key = F.col("o_orderkey")
    whole = F.format_number(F.floor("o_totalprice"), 0)
    raw = F.when(key % 4 == 0, F.concat(F.lit("Answer: $"), whole, F.lit(".00"))).when(key % 4 == 1, F.concat(F.lit("-"), key.cast("string"), F.lit(".50"))).when(key % 4 == 2, F.concat(key.cast("string"), F.lit("e2"))).otherwise("12 kg")
    done = N.normalize_number(raw)
    return read(spark, sf_dir, "orders").select(key.alias("id"), done["normalized"].alias("normalized"), done["status"].alias("status"))


PERMS = ", ".join(f"({n}, {i}, [{', '.join(map(str, p))}])" for n in range(2, 6) for i, p in enumerate(permutations(range(n))))


@query(f"""WITH perms(n, perm_id, sources) AS (VALUES {PERMS}), ranked AS (
  SELECT p_partkey AS question_id, perm_id, sources, row_number() OVER (PARTITION BY p_partkey ORDER BY perm_id <> 0, substr(sha256('9' || chr(0) || p_partkey || chr(0) || array_to_string(sources, ',')), 1, 32), perm_id) - 1 AS view_index
  FROM part JOIN perms ON n = 2 + p_partkey % 4)
SELECT question_id, view_index, array_to_string(list_transform(sources, lambda s: chr(CAST(97 + s AS INT))), '') AS shown, chr(CAST(65 + sources[1] AS INT)) AS first_label FROM ranked WHERE view_index < 4""", views=False)
def option_views(spark, sf_dir):
    n = (2 + F.col("p_partkey") % 4).cast("int")
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.transform(F.sequence(F.lit(97), F.lit(96) + n), lambda c: F.char(c)).alias("options"))
    out = V.option_views(rows, 4, 9)
    return out.select("question_id", "view_index", F.array_join(V.permuted(F.col("options"), F.col("sources")), "").alias("shown"), F.try_element_at(V.inverse_map(F.col("sources")), F.lit("A")).alias("first_label"))


@query("""WITH base AS (SELECT p_partkey AS id, p_partkey % 6 AS k, p_size AS n FROM part)
SELECT id, CASE k WHEN 0 THEN 'C' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 4 THEN CAST(n AS VARCHAR) END AS canonical, CASE k WHEN 3 THEN 'out_of_answer_space' WHEN 5 THEN 'unsupported_relation' ELSE 'valid' END AS status FROM base""", views=False)
def canonicalize_inverse(spark, sf_dir):
    k = F.col("p_partkey") % 6
    inverse = F.create_map(*[F.lit(x) for x in ("A", "C", "B", "A", "C", "B")])
    raw = F.when(k == 0, "a").when(k == 1, "(B)").when(k == 2, "3").when(k == 3, "D").otherwise(F.col("p_size").cast("string"))
    kind = F.when(k < 4, "option letter").otherwise("number")
    relation = F.when(k == 4, "identity").otherwise("option_permutation")
    done = N.canonicalize(raw, kind, F.lit(3), inverse, relation)
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), done["canonical"].alias("canonical"), done["status"].alias("status"))


ALIASES = {"1-URGENT": "urgent", "2-HIGH": "high", "5-low": "low"}


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '2-HIGH' THEN 'high' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS method FROM orders", views=False)
def method_alias(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), N.method_name(F.concat(F.lit(" "), "o_orderpriority"), ALIASES).alias("method"))


@query("""SELECT conv_id, turn, substr(sha256(coalesce(role, 'None') || chr(0) || coalesce(text, 'None')), 1, 16) AS stable_id,
  role || ':' || 'train' || ':' || conv_id || ':' || substr(sha256(coalesce(text, 'None')), 1, 12) AS question_key, lpad(CAST(turn AS VARCHAR), 6, '0') || '_' || conv_id || '.json' AS artifact,
  CAST(('0x' || substr(sha256(coalesce(text, 'None')), 1, 8))::UBIGINT + 11 AS BIGINT) AS seed FROM conversations""", views=False)
def stable_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select(
        "conv_id", "turn", H.stable_id(F.col("role"), F.col("text")).alias("stable_id"), H.question_key(F.col("role"), F.lit("train"), F.col("conv_id").cast("string"), F.col("text")).alias("question_key"),
        H.artifact_name(F.col("turn"), F.col("conv_id")).alias("artifact"), H.seed_of(11, F.col("text")).alias("seed"),
    )


@query("""SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(lower(text), '[a-zA-Z]+|[-+*/=<>]|[0-9]+(?:\\.[0-9]+)?'))) AS tokens FROM conversations""", views=False)
def strategy_tokens(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_sort(A.strategy_tokens(F.col("text"))).alias("tokens"))


def jaccard_clusters(spark, sf_dir):
    """Sequential by nature: tested against a plain loop instead of SQL."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"), F.col("role").alias("answer"), "text")
    return K.strategy_clusters(rows, A.strategy_tokens(F.col("text")), threshold=0.12).select("question_id", "pos", "cluster")


query()(jaccard_clusters)
