"""Single records: ids where they lack one, order, validity, scope, targets, and reports of two
runs side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions import guards as G
from plurality.functions.hashing import stable_id
from plurality.operators import metrics, support


def some(value: Column) -> Column:
    """Null for an empty text too."""
    return F.nullif(value.cast("string"), F.lit(""))


def question_of(question_id: Column, prompt: Column) -> Column:
    """The question's id; of older records a hash of the prompt."""
    return F.coalesce(some(question_id), F.concat(F.lit("legacy:"), stable_id(F.coalesce(prompt, F.lit("")), length=20)))


def sample_of(sample_id: Column, question_id: Column, index: Column, row: Column) -> Column:
    """The sample's id; of older records a hash of question, index and row."""
    return F.coalesce(some(sample_id), stable_id(question_id, index, row, length=24))


def in_order(samples: DataFrame, view: str = "view_index", index: str = "sample_index", sample: str = "sample_id") -> DataFrame:
    """Samples with ``pos``: by view, index and id within a question; what is no whole number
    counts as 0, and a missing id as empty."""
    whole = lambda c: F.coalesce(F.col(c).try_cast("int"), F.lit(0))
    order = Window.partitionBy("question_id").orderBy(whole(view), whole(index), F.coalesce(F.col(sample).cast("string"), F.lit("")))
    return samples.withColumn("pos", (F.row_number().over(order) - 1).cast("long"))


def valid_record(answer: Column, flag: Column, status: Column) -> Column:
    """An answer that counts, a flag that does not deny it, and no status but ``valid``."""
    said = F.lower(F.trim(status.cast("string")))
    return G.answer_key(answer).isNotNull() & F.coalesce(G.flag(flag, True), F.lit(True)) & F.coalesce(said == "valid", F.lit(True))


def strictly_valid(answer: Column, flag: Column) -> Column:
    """An answer and a true flag; a missing flag is not true."""
    return answer.isNotNull() & F.coalesce(flag, F.lit(False))


def in_scope(samples: DataFrame, scope: str, relation_id: str = "relation_id", relation_type: str = "relation_type") -> DataFrame:
    """``all`` samples, or those of the ``identity``."""
    if scope == "all":
        return samples
    if scope != "identity":
        raise ValueError(f"unknown scope {scope!r}")
    return samples.where(G.identity_by_id_or_type(F.lower(F.trim(F.col(relation_type))), F.col(relation_id)))


def runtime_records(rows: DataFrame, canonical: str = "canonicalized_answer", extracted: str = "extracted_answer", other: str = "answer", flag: str = "is_valid_answer") -> DataFrame:
    """Records as the controller takes them: a missing canonical answer is the extracted one,
    and a missing flag says whether there is an answer. Absent columns count as null."""
    there = lambda c, kind: F.col(c) if c in rows.columns else F.lit(None).cast(kind)
    answer = F.coalesce(there(canonical, "string"), there(extracted, "string"), there(other, "string"))
    return rows.withColumn(canonical, answer).withColumn(flag, F.coalesce(there(flag, "boolean"), answer.isNotNull()))


def split_violations(rows: DataFrame, phase: str, column: str = "split") -> DataFrame:
    """Splits that a phase may not see: a validation or test takes rows of its own split
    only, an analysis any. A missing split is one of its own."""
    seen = rows.groupBy(F.coalesce(F.col(column), F.lit("<none>")).alias("split")).agg(F.count("*").alias("rows"))
    return seen.limit(0) if phase == "analysis" else seen.where(F.col("split") != phase)


def repeated_over_shards(rows: DataFrame, key: str, shard: str) -> DataFrame:
    """Keys that more than one shard has."""
    return rows.groupBy(key).agg(F.count_distinct(shard).alias("shards"), F.min(shard).alias("first"), F.max(shard).alias("last")).where("shards > 1")


def unequal_ids(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """``by, key, side`` of ids that only one of two stages has, within each shard."""
    a, b = left.select(by, key).distinct().withColumn("_a", F.lit(True)), right.select(by, key).distinct().withColumn("_b", F.lit(True))
    joined = a.join(b, [by, key], "full").where("_a IS NULL OR _b IS NULL")
    return joined.select(by, key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("side"))


def status_fields(done: Column, value: Column) -> list[Column]:
    """What a record keeps of a normalisation: the raw value, the answer, flag and status."""
    valid = done["status"] == "valid"
    return [value.alias("extracted_answer"), done["canonical"].alias("canonicalized_answer"), valid.alias("is_valid_answer"), done["status"].alias("canonicalization_status"), F.when(~valid, done["status"]).alias("invalid_reason")]


def typed_scores(pool: DataFrame, answer_type: str = "answer_type") -> DataFrame:
    """``question_id, answer, score, score_name``: counted shares where answers are options,
    shares of confidence where they are numbers. A question's type is its first row's."""
    kinds = pool.groupBy("question_id").agg(F.min_by(F.lower(F.trim(answer_type)), "pos").alias("_k"))
    number = F.col("_k").contains("number") | F.col("_k").contains("numeric")
    counted = support.counted_relations(pool).select("question_id", "answer", F.col("relsc").alias("score"), F.lit("relsc").alias("score_name"))
    weighted = support.relational_support(pool, weights=False).select("question_id", "answer", F.col("relssc").alias("score"), F.lit("ssc").alias("score_name"))
    return counted.join(kinds.where(~number), "question_id").unionByName(weighted.join(kinds.where(number), "question_id")).where("score IS NOT NULL").drop("_k")


def attached(pool: DataFrame, cluster: str, beta: float = 0.5, strength: float = 0.5) -> DataFrame:
    """Every sample with its dependency weight, relational support and fragility at once.

    Invalid rows, and questions without positive mass, have null targets.
    """
    weighed = support.cluster_weights(pool.drop("dependency_weight"), cluster, beta).withColumnRenamed("dependency", "dependency_weight")
    shares = support.relational_support(weighed)
    fragile = support.fragility(weighed, strength).select("question_id", "answer", "fragility")
    done = support.attach_targets(weighed.drop("fragility"), shares, "relssc")
    return done.join(fragile, ["question_id", "answer"], "left")


def response_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """``n``, accuracy, calibration error, Brier score in percent and AUROC of responses with
    a probability and a verdict; others are left out."""
    usable = rows.select(*by, G.probability(F.col("confidence")).alias("score"), F.col("is_correct").cast("int").alias("correct")).where("score IS NOT NULL AND correct IS NOT NULL")
    ece = metrics.calibration_error(usable, by, "product").select(*by, (100 * F.col("ece")).alias("ece"))
    area = metrics.auroc(usable, by).select(*by, "auroc")
    return metrics.summary(usable, by).select(*by, "n", "accuracy", "brier").join(ece, by).join(area, by)


def table_of(report: DataFrame, budget: int) -> DataFrame:
    """One row a method: its fixed budget, or its match for the target."""
    fixed = (F.col("row_type") == "fixed_budget") & (F.col("budget") == budget)
    matched = (F.col("row_type") == "dynamic_budget_match") & (F.coalesce("budget_target", "budget") == budget)
    return report.where(fixed | matched)


def paired_reports(left: DataFrame, right: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Two reports' methods side by side, those that both have: accuracy, its difference in
    points, and samples used."""
    shown = lambda r, name: table_of(r, budget).select(*keys, F.col("accuracy_percent").alias(f"{name}_accuracy"), F.col("actual_avg_samples").alias(f"{name}_samples"))
    return shown(left, "left").join(shown(right, "right"), keys).withColumn("delta_accuracy", F.col("right_accuracy") - F.col("left_accuracy"))


def candidate_order(rows: DataFrame, dataset: str = "dataset_name", source: str = "source_index", key: str = "question_id") -> DataFrame:
    """Candidates by data set, source as text, and id."""
    return rows.orderBy(dataset, F.col(source).cast("string"), key)
