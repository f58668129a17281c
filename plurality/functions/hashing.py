"""Stable identifiers, hash splits and digests; equal to SHA-256 over UTF-8 parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUL = "\x00"


def stable_id(*parts: Column, length: int = 16) -> Column:
    """First ``length`` hex digits of SHA-256 of the parts joined by NUL; null is ``None``."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(NUL, *texts), 256), 1, length)


def holdout_fraction(namespace: str, seed: int, dataset: Column, question: Column) -> Column:
    """In [0, 1): the first 8 bytes of the hash as a big-endian number over 2^64."""
    head = F.substring(F.sha2(F.concat_ws(NUL, F.lit(namespace), F.lit(str(seed)), dataset.cast("string"), question.cast("string")), 256), 1, 16)
    return F.conv(head, 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def partition_rows(rows: DataFrame, role: str, namespace: str, seed: int, fraction: float, dataset: str = "dataset_name", question: str = "question_id") -> DataFrame:
    """Rows of the ``validation`` or ``test`` questions by hash, with ``split`` rewritten to
    that role and what it was as ``source_split``. A missing or empty id is an error."""
    if role not in ("validation", "test"):
        raise ValueError(f"a partition is validation or test, not {role!r}")
    id_ = F.col(question).cast("string")
    checked = F.when(F.coalesce(id_, F.lit("")) == "", F.raise_error(F.lit("a row has no question id")).cast("string")).otherwise(id_)
    chosen = holdout_fraction(namespace, seed, F.col(dataset), checked) < fraction
    before = F.col("split") if "split" in rows.columns else F.lit(None).cast("string")
    return rows.where(chosen if role == "validation" else ~chosen).withColumns({"source_split": before, "split": F.lit(role)})


def seed_of(seed: int, *parts: Column) -> Column:
    return F.conv(stable_id(*parts, length=8), 16, 10).cast("long") + F.lit(seed)


def source_id(position: Column, *candidates: Column) -> Column:
    """The first candidate that is not blank, else the position."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in candidates], position.cast("string"))


def question_key(dataset: Column, split: Column, source: Column, text: Column) -> Column:
    return F.concat_ws(":", dataset, split, source, stable_id(text, length=12))


def artifact_name(index: Column, question: Column) -> Column:
    return F.concat(F.lpad(index.cast("string"), 6, "0"), F.lit("_"), question.cast("string"), F.lit(".json"))


def group_split(questions: DataFrame, ratio: float, seed: int, dataset: str = "dataset_name", key: str = "question_id") -> DataFrame:
    """Each question with ``split``: per dataset the first ``rint(n * ratio)`` by hash are
    test, at least one and never all; with one question or ratio 0 none is.

    The rank is a global order per dataset. It is found from counts of hash prefixes, so
    one dataset of any size is sorted in parts, never in one task.
    """
    hashed = questions.select(F.col(dataset), F.col(key), stable_id(F.lit(seed), F.col(key), length=32).alias("_h")).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy(dataset, "_b").agg(F.count("*").alias("_n"))  # at most 4,096 rows a dataset
    per = Window.partitionBy(dataset)
    offsets = sizes.select(dataset, "_b", (F.sum("_n").over(per.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"), F.sum("_n").over(per).alias("_all"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(dataset, "_b").orderBy("_h", key))).join(offsets, [dataset, "_b"])
    n = F.col("_all")
    take = F.when((n <= 1) | (F.lit(ratio) <= 0), 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.rint(n * ratio).cast("long"))))
    rank = F.col("_r") + F.coalesce("_before", F.lit(0))
    return ranked.select(dataset, key, F.when(rank <= take, "test").otherwise("train").alias("split"))


def ordered_digest(ids: Column) -> Column:
    """SHA-256 over an ordered array of ids, each followed by NUL."""
    return F.sha2(F.array_join(F.transform(ids, lambda x: F.concat(x.cast("string"), F.lit(NUL))), ""), 256)
