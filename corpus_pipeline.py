"""The text pipeline: documents to token identifiers, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plurality.llm import stages
from plurality.llm.common import Scratch, table

STAGES = [
    ("quality classifier", stages.keep_good),
    ("n-gram Jaccard join", stages.keep_one_of_each_group),
    ("benchmark decontamination", stages.keep_uncontaminated),
    ("secret scans", stages.without_secrets),
    ("BPE encoding and decoding", stages.encoded),
]

#: The first stage is a fitted model, which SQL can not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, and its
    predecessor's removed once it is there."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = scratch.keep(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
