"""Column guards: what counts as a number, a probability, a flag, an answer.

The rules differ on purpose; each function is named after the rule it applies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that mean "no answer", and of the two truth values.
NO_ANSWER = ["", "none", "null", "n/a", "na", "invalid", "<invalid>"]
TRUE_WORDS = ["true", "yes", "1", "valid"]
FALSE_WORDS = ["false", "no", "0", "invalid", "none", "null"]


def finite(value: Column) -> Column:
    """A double, or null for missing, malformed, infinite and NaN values."""
    number = value.try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == float("inf")), None).otherwise(number)


def probability(value: Column) -> Column:
    number = finite(value)
    return F.when((number >= 0) & (number <= 1), number)


def non_negative(value: Column) -> Column:
    number = finite(value)
    return F.when(number >= 0, number)


def flag(value: Column, if_null: bool) -> Column:
    """A boolean from its usual spellings; null for other text, ``if_null`` for null."""
    word = F.lower(F.trim(value.cast("string")))
    return F.when(value.isNull(), F.lit(if_null)).when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS) | (word == ""), False)


def answer_key(value: Column) -> Column:
    """Target building: the no-answer spellings are null, single letters A-E upper case."""
    text = F.trim(value.cast("string"))
    return F.when(F.lower(text).isin(NO_ANSWER), None).when(text.rlike("^[A-Ea-e]$"), F.upper(text)).otherwise(text)


def answer_upper(value: Column) -> Column:
    """Vote evaluation: empty is null, everything upper case, ``7.0`` is ``7``."""
    text = F.upper(F.trim(value.cast("string")))
    return F.when(text == "", None).when(text.rlike(r"^[+-]?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def answer_letter(value: Column) -> Column:
    """Table observations: empty is null, single letters A-E upper case, else unchanged."""
    text = F.trim(value.cast("string"))
    return F.when(text == "", None).when(text.rlike("^[A-Ea-e]$"), F.upper(text)).otherwise(text)


def identity_by_type_first(relation_type: Column, view_index: Column, relation_id: Column) -> Column:
    """A given type decides alone; then view 0; then ``g0``; with nothing given, true."""
    kind = F.lower(F.trim(relation_type))
    return F.when(relation_type.isNotNull(), kind == "identity").when(view_index.isNotNull(), view_index == 0).when(relation_id.isNotNull(), F.lower(relation_id) == "g0").otherwise(True)


def identity_by_any(relation_type: Column, view_index: Column, relation_id: Column) -> Column:
    """Type identity is enough; another type still falls through to view 0 or ``g0``."""
    kind = F.coalesce(F.lower(F.trim(relation_type)) == "identity", F.lit(False))
    return F.when(kind, True).when(view_index.isNotNull(), view_index == 0).otherwise(F.coalesce(F.lower(F.trim(relation_id)), F.lit("g0")) == "g0")


def identity_by_id_or_type(relation_type: Column, relation_id: Column) -> Column:
    return (F.coalesce(relation_id, F.lit("g0")) == "g0") | F.coalesce(relation_type == "identity", F.lit(False))
