"""Scores of a response for a vote: stored fields, token formula, or the confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plurality.functions.guards import finite

# Fields that may hold a method's own score, in order.
SCORE_FIELDS = {
    "informed": ["cisc_confidence", "untrained_confidence", "response_probability", "base_confidence", "model_confidence"],
    "self_certainty": ["self_certainty", "self_certainty_score", "self_certainty_confidence"],
    "buffered": ["rasc_score", "rasc_confidence", "sufficiency_score", "reasoning_quality_score"],
}


def self_certainty(vectors: Column, vocab_size: Column, logs: bool) -> Column:
    """``-(1 / nV) sum(log(V p))`` over all positions and vocabulary entries.

    Null for no positions, an empty vector, a missing, non-finite or (for probabilities)
    non-positive entry, or a vector whose length is not the stated vocabulary's.
    """
    size = F.when(vocab_size > 0, vocab_size)

    def bad_entry(p: Column) -> Column:
        broken = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
        return broken if logs else broken | (p <= 0)

    def bad(v: Column) -> Column:
        return v.isNull() | (F.size(v) == 0) | F.coalesce(F.size(v) != size, F.lit(False)) | F.exists(v, bad_entry)

    def total(acc: Column, v: Column) -> Column:
        level = F.log(F.coalesce(size, F.size(v)).cast("double"))
        return F.aggregate(v, acc, lambda a, p: a - (level + (p if logs else F.log(p))))

    terms = F.aggregate(vectors, F.lit(0.0), total)
    count = F.aggregate(vectors, F.lit(0), lambda a, v: a + F.size(v))
    usable = (F.size(vectors) > 0) & ~F.exists(vectors, bad)
    return F.when(usable, terms / count)


def method_score(columns: list[str], method: str, confidence: Column, tokens: Column | None = None) -> tuple[Column, Column]:
    """(score, source): the first finite stored field, then ``tokens``, then the confidence."""
    fields = [f for f in SCORE_FIELDS.get(method, []) if f in columns]
    score, source = finite(confidence), F.when(finite(confidence).isNotNull(), "confidence")
    if tokens is not None and method == "self_certainty":
        score, source = F.coalesce(tokens, score), F.when(tokens.isNotNull(), "tokens").otherwise(source)
    for f in reversed(fields):
        own = finite(F.col(f))
        score, source = F.coalesce(own, score), F.when(own.isNotNull(), f).otherwise(source)
    return score, source
