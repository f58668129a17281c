"""Contracts of question payloads: what breaks one comes out as ``question_id, rule, detail``.

Samples are one row each (``question_id, dataset_name, sample_id, relation_id, relation_type,
view_index, answer_type, extracted_answer, canonicalized_answer, is_valid_answer, confidence,
relation_weight, dependency_weight, sources`` and, for options, ``original_options,
transformed_options``). Questions have ``question_id, dataset_name, answer_type, num_views,
samples_per_view, attempted_budget``. Rows are checked where they are; sizes take one
aggregate by question and relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import normalize as N
from plurality.functions import views as V

# Sampling profiles of the three kinds of questions, and the sets of numbers.
TWO_OPTIONS, OPTIONS, NUMBERS = (2, 16), (4, 8), (1, 32)
NUMERIC_DATASETS = ("gsm8k", "svamp")
PAIR_DATASETS = ("winogrande",)


def is_number(answer_type: Column) -> Column:
    kind = F.lower(F.trim(answer_type))
    return F.coalesce(kind.contains("number") | kind.contains("numeric"), F.lit(False))


def question_violations(questions: DataFrame, samples: DataFrame, formal: bool = True) -> DataFrame:
    """Broken rules of budgets: positive, products, records, formal profiles, the kind of a
    data set, and the relations with their sizes."""
    number, name = is_number(F.col("answer_type")), F.lower(F.trim(F.col("dataset_name")))
    pair = F.coalesce(name.isin(*PAIR_DATASETS), F.lit(False))
    views, per, budget = F.col("num_views"), F.col("samples_per_view"), F.col("attempted_budget")
    cells = samples.groupBy("question_id", "relation_id").agg(F.count("*").alias("n"))
    have = cells.groupBy("question_id").agg(F.sum("n").alias("records"), F.array_sort(F.collect_set("relation_id")).alias("relations"), F.min("n").alias("low"), F.max("n").alias("high"))  # one entry a view
    rows = questions.join(have, "question_id", "left")
    wanted = F.when(number, F.array(F.lit("g0"))).otherwise(F.array_sort(F.transform(F.sequence(F.lit(0), F.greatest(views, F.lit(1)).cast("int") - 1), lambda i: F.concat(F.lit("g"), i.cast("string")))))
    right = lambda profile: (views == profile[0]) & (per == profile[1])
    profile = F.when(number, right(NUMBERS)).when(pair, right(TWO_OPTIONS)).otherwise(right(OPTIONS))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    text = lambda *c: F.concat_ws("x", *[F.coalesce(x.cast("string"), F.lit("null")) for x in c])
    checks = [
        ("not_positive", no((views > 0) & (per > 0) & (budget > 0)), text(views, per, budget)),
        ("budget_product", no(views * per == budget), text(views, per, budget)),
        ("record_count", no(F.coalesce("records", F.lit(0)) == budget), F.coalesce("records", F.lit(0)).cast("string")),
        ("kind_of_set", number != F.coalesce(name.isin(*NUMERIC_DATASETS), F.lit(False)), F.col("dataset_name")),
        ("relations", no((F.col("relations") == wanted) & (F.col("low") == per) & (F.col("high") == per)), F.concat_ws(",", "relations")),
    ]
    if formal:
        checks.append(("formal_profile", no(profile), text(views, per)))
    return _exploded(rows, checks)


def _exploded(rows: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))) for rule, bad, detail in checks]))
    return rows.select("question_id", F.explode(broken).alias("v")).select("question_id", "v.rule", "v.detail")


def sample_violations(questions: DataFrame, samples: DataFrame) -> DataFrame:
    """Broken rules of single samples, and repeated or blank ids within a question.

    Answers are canonicalised anew through the sample's own order of options (``sources``),
    and the stored answer and flag must say the same.
    """
    known = questions.select("question_id", F.col("dataset_name").alias("_set"), is_number(F.col("answer_type")).alias("_number"))
    rows = samples.join(known, "question_id")
    # columns of their own, as they are used several times
    number = F.col("_number")
    inverse = F.when(F.size("sources") > 0, V.inverse_map(F.col("sources")))
    kind = F.when(number, "number").otherwise("option letter")
    rows = rows.withColumn("_again", N.canonicalize(F.col("extracted_answer"), kind, F.size("sources"), inverse, F.lit("identity")))
    again, valid = F.col("_again.canonical"), F.coalesce(F.col("_again.status") == "valid", F.lit(False))
    stored = F.col("is_valid_answer")
    view = F.regexp_extract("relation_id", r"^g(\d+)$", 1).try_cast("long")
    shown = F.transform(V.permuted(F.col("original_options"), F.col("sources")), lambda x: x.cast("string"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    order = F.array_sort("sources") == F.transform(F.sequence(F.lit(0), F.greatest(F.size("sources"), F.lit(1)) - 1), lambda i: i.cast("int"))
    one = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(1.0)) != 1.0
    where = F.coalesce("sample_id", F.lit(""))
    checks = [
        ("other_set", no(F.col("dataset_name") == F.col("_set"))),
        ("other_kind", F.coalesce(is_number(F.col("answer_type")) != number, F.lit(False))),
        ("no_sample_id", where == ""),
        ("bad_relation_id", view.isNull()),
        ("view_of_relation", no(F.col("view_index") == view)),
        ("number_not_identity", number & no((F.col("relation_id") == "g0") & (F.coalesce(F.lower(F.trim("relation_type")), F.lit("identity")) == "identity"))),
        ("number_with_options", number & ((F.coalesce(F.size("sources"), F.lit(0)) > 0) | (F.coalesce(F.size("original_options"), F.lit(0)) > 0))),
        ("bad_order", ~number & no(order)),
        ("no_flag", stored.isNull()),
        ("stored_answer", F.coalesce(stored, F.lit(False)) & no(valid & (F.col("canonicalized_answer") == again))),
        ("stored_invalid", no(stored) & stored.isNotNull() & (valid | F.col("canonicalized_answer").isNotNull())),
        ("shown_options", ~number & F.coalesce(shown != F.col("transformed_options"), F.lit(False))),
        ("no_confidence", F.col("confidence").isNull()),
        ("weights_not_one", one("relation_weight") | one("dependency_weight")),
    ]
    own = _exploded(rows, [(rule, bad, where) for rule, bad in checks])
    twice = samples.where(where != "").groupBy("question_id", "sample_id").agg(F.count("*").alias("n")).where("n > 1")
    return own.unionByName(twice.select("question_id", F.lit("repeated_sample").alias("rule"), F.col("sample_id").cast("string").alias("detail")))


def pair_violations(samples: DataFrame) -> DataFrame:
    """Questions of two options that lack the identity or the swap, or repeat a view."""
    orders = samples.groupBy("question_id").agg(F.array_sort(F.collect_set(F.concat_ws(",", "sources"))).alias("o"), F.count_if(F.coalesce("is_duplicate_view", F.lit(False))).alias("d"))
    bad = orders.where((F.col("o") != F.array(F.lit("0,1"), F.lit("1,0"))) | (F.col("d") > 0))
    return bad.select("question_id", F.lit("identity_and_swap").alias("rule"), F.concat_ws(";", "o").alias("detail"))


def payload_violations(questions: DataFrame, samples: DataFrame, formal: bool = True) -> DataFrame:
    """All broken rules; a table without rows is a payload that may be used."""
    pairs = questions.where(F.lower(F.trim("dataset_name")).isin(*PAIR_DATASETS)).select("question_id")
    two = pair_violations(samples.join(pairs, "question_id", "left_semi"))
    return question_violations(questions, samples, formal).unionByName(sample_violations(questions, samples)).unionByName(two)
