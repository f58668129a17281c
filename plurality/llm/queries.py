"""Registered queries of the text operators, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plurality.llm import audit, bpe, collocations, decontaminate, jaccard, packing, pii, quality, repetition, secrets, threads, urls
from plurality.llm.common import table

VOCAB = "word_bpe_49k.json"
PACKED_VOCAB = "byte_bpe_50k.json"


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), limit=2048)


def op5_reply_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.reply_threads(table(spark, sf_dir, "conversations"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), digests=True)



def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents"))


def op10_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


def op11_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKED_VOCAB), length=2048, digests=True)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=100, most_words=5, top=2000)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_ngram_jaccard_join, op3_personal_data, op4_token_counts, op5_reply_threads, op6_benchmark_decontamination, op7_bpe_codec, op8_url_filter, op9_secret_scan, op10_repetition_rules, op11_curve_packing, op12_phrase_collocations, op13_filter_audit)}
ORACLES: dict[str, str] = {"op6_benchmark_decontamination": decontaminate.oracle_sql(), "op5_reply_threads": threads.ORACLE_SQL, "op12_phrase_collocations": collocations.ORACLE_SQL, "op13_filter_audit": audit.ORACLE_SQL}
