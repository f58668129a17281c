"""Strict reparsing of stored samples, and audits of what it loses, recovers and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import normalize as N
from plurality.functions.answers import explicit_answer

#: Version of the parsing rules that ``strict_reparse`` applies; stored with its results.
PARSER_VERSION = "explicit-field.1"


def strict_reparse(samples: DataFrame, dataset: str = "dataset_name", response: str = "response", answer_type: str = "answer_type", n_labels: str = "n_labels", inverse: str = "inverse") -> DataFrame:
    """Samples with ``strict_answer, strict_status, strict_valid, parser_version``.

    Only an explicit answer field of the response counts. Options go back through ``inverse``
    (shown label to original), numbers are taken under identity. Stored answers stay beside.
    """
    found = explicit_answer(F.col(dataset), F.coalesce(F.col(response), F.lit("")), F.col(answer_type))
    # a column of its own: written out where it is used, the plan would grow without bound
    done = N.canonicalize(F.col("_found"), F.col(answer_type), F.col(n_labels), F.col(inverse), F.lit("identity"))
    return samples.withColumn("_found", found).withColumn("_d", done).withColumn("strict_answer", F.col("_d.canonical")).withColumn("strict_status", F.coalesce("_d.status", F.lit("missing_answer"))).withColumn(
        "strict_valid", F.coalesce(F.col("_d.status") == "valid", F.lit(False))
    ).withColumn("parser_version", F.lit(PARSER_VERSION)).drop("_d", "_found")


def reparse_counters(samples: DataFrame, by: list[str], valid: str = "is_valid_answer", stored: str = "canonicalized_answer") -> DataFrame:
    """How many samples were valid before and are now, lost, recovered, and changed."""
    old, new = F.coalesce(F.col(valid), F.lit(False)), F.col("strict_valid")
    text = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("None"))
    return samples.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if(old).alias("old_valid"), F.count_if(new).alias("strict_valid"), F.count_if(old & ~new).alias("lost_by_strict"), F.count_if(~old & new).alias("recovered_by_strict"), F.count_if(old & new & (text(stored) != text("strict_answer"))).alias("canonical_changed"),
    )


def profile_histogram(samples: DataFrame, by: list[str], question: str = "question_id", view: str = "view") -> DataFrame:
    """How many questions have which sampling profile: ``views x per_view``, or ``mixed``."""
    sizes = samples.groupBy(*by, question, view).agg(F.count("*").alias("n"))
    per = sizes.groupBy(*by, question).agg(F.count("*").alias("views"), F.min("n").alias("low"), F.max("n").alias("high"))
    shape = F.when(F.col("low") == F.col("high"), F.concat_ws("x", F.col("views").cast("string"), F.col("low").cast("string"))).otherwise("mixed")
    return per.groupBy(*by, shape.alias("profile")).agg(F.count("*").alias("questions"))


def first_examples(samples: DataFrame, bad: Column, by: list[str], order: list[str], k: int = 20) -> DataFrame:
    """The first ``k`` samples of each group that ``bad`` holds for (a report's examples).

    Rows are cut to ``k`` within slots of their order's hash first, so no task ranks a group.
    """
    rows = samples.where(bad).withColumn("_s", F.pmod(F.xxhash64(*order), F.lit(64)))
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_s").orderBy(*order))).where(F.col("_k") <= k)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k).drop("_s", "_k")


def weighted_consensus(samples: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``question_id, answer, support, samples, invalid, source``: the answer of the largest
    confidence sum, of several the smallest text, as a share of all valid confidence. Sums are
    of decimals (twelve digits where confidence is none), so equal masses are equal.

    An answer without a confidence from 0 to 1 is an error, a missing answer only counted. A
    consensus in ``stored`` (``question_id, answer, support``) goes before the one found.
    """
    good = F.col("confidence").between(0, 1)
    exact = F.col("confidence") if dict(samples.dtypes)["confidence"].startswith("decimal") else F.col("confidence").cast("decimal(20,12)")
    checked = F.when(F.col("answer").isNull() | F.coalesce(good, F.lit(False)), exact).otherwise(F.raise_error(F.concat(F.lit("bad confidence in question "), F.col("question_id").cast("string"))))
    per = samples.withColumn("_c", checked).groupBy("question_id", "answer").agg(F.sum("_c").alias("m"), F.count("*").alias("n"))
    some = F.col("answer").isNotNull()
    best = per.groupBy("question_id").agg(
        F.min(F.when(some, F.struct((-F.col("m")).alias("m"), "answer"))).alias("b"), F.sum(F.when(some, F.col("m"))).alias("total"), F.sum("n").alias("samples"), F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("invalid")
    )
    found = best.select("question_id", F.when(F.col("total") > 0, F.col("b.answer")).alias("answer"), F.when(F.col("total") > 0, (-F.col("b.m")).cast("double") / F.col("total").cast("double")).alias("support"), "samples", "invalid")
    if stored is None:
        return found.withColumn("source", F.lit("recomputed"))
    given = stored.select("question_id", F.col("answer").alias("_a"), F.col("support").alias("_s"))
    has = F.col("_a").isNotNull()
    return found.join(given, "question_id", "left").select("question_id", F.coalesce("_a", "answer").alias("answer"), F.when(has, F.col("_s")).otherwise(F.col("support")).alias("support"), "samples", "invalid", F.when(has, "stored").otherwise("recomputed").alias("source"))
