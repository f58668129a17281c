"""The pipeline's stages: each takes what its predecessor kept and returns documents.

Names, order and functions stand in ``STAGES`` of ``corpus_pipeline.py``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.llm import bpe, decontaminate, jaccard, quality, secrets
from plurality.llm.common import Scratch, sent_if_small, table

#: A document goes if its score says so: under it, label 0 is likelier than label 1.
REJECT_BELOW = 0.5
#: Near-duplicates share four fifths of their five-word shingles.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
VOCAB = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose quality score is under ``REJECT_BELOW``; all rows are scored.

    Learns from the labels of documents that are not held out (see ``quality``). Without
    such labels every score is 0.5, so all documents stay. Repeated rows get the same
    verdict; null and empty texts are judged as empty texts.
    """
    learnable = table(spark, sf_dir, "labels").where(~F.coalesce(quality.held_out(), F.lit(True)))
    model = quality.fit(docs, learnable)
    return quality.accept(docs, model, REJECT_BELOW)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest ``doc_id`` of each group of near-duplicates.

    Rows with a null id or without words are in no group and stay; rows that repeat the
    kept id stay too.
    """
    groups = jaccard.ngram_components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    gone = sent_if_small(groups.where("component_id <> doc_id").select("doc_id").distinct(), Scratch(spark))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; rows with a null id stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text, and counts ``n_chars`` anew; no row goes.

    A null text stays null, and so its count; a table without ``n_chars`` gets none.
    """
    clean = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every document left."""
    return bpe.encode_texts(docs, public_tokenizers.path(VOCAB))
