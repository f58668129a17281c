"""Answer normalisation and mapping back through option permutations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels, wrappers and number formats of extracted answers.
LABELS = ["A", "B", "C", "D", "E"]
PREFIX = r"(?i)^\s*(?:(?:final\s+)?answer|option|choice)\s*(?:is\s*)?[:=]?\s*"
WHOLE = r"^[+-]?\d+(?:\.0+)?$"
SCALAR = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` written down once: what is used many times would else be
    written out each time, and nested uses multiply."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unwrapped(value: Column) -> Column:
    """Without a leading ``answer is:``, one pair of brackets, and trailing ``.:;``."""
    text = F.regexp_replace(F.regexp_replace(value, PREFIX, ""), r"^\s+|\s+$", "")
    wrapped = text.rlike(r"(?s)^(?:\(.*\)|\[.*\])$")
    bare = F.when(wrapped, F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"^\s+|\s+$", "")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(bare, "[.:;]+$", ""), r"^\s+|\s+$", "")


def _result(normalized: Column, status: Column) -> Column:
    return F.struct(F.when(status == "valid", normalized).alias("normalized"), status.alias("status"))


def normalize_option(value: Column, n_labels: Column, base: int = 1) -> Column:
    """``struct<normalized, status>``: a letter of the first ``n_labels``, or an index.

    Statuses: ``valid``, ``missing_answer``, ``invalid_format``, ``out_of_answer_space``.
    """

    def judged(token: Column) -> Column:
        letter, whole = token.rlike("^[A-Za-z]$"), token.rlike(WHOLE)
        index = F.when(letter, F.ascii(F.upper(token)) - 65).when(whole, F.regexp_replace(token, r"\.0+$", "").try_cast("long") - base)

        def placed(at: Column) -> Column:
            inside = F.coalesce((at >= 0) & (at < n_labels), F.lit(False))
            blank = value.isNull() | (F.regexp_replace(value, r"\s+", "") == "")
            status = F.when(blank, "missing_answer").when(~(letter | whole), "invalid_format").when(inside, "valid").otherwise("out_of_answer_space")
            return _result(F.char(at + 65), status)

        return _let(index, placed)

    return _let(unwrapped(value), judged)


def plain_decimal(token: Column) -> Column:
    """A scalar without exponent, leading or trailing zeros; ``-0`` is ``0``.

    All digits are kept, also beyond 28 significant ones.
    """
    sign = F.when(token.startswith("-"), "-").otherwise("")
    whole = F.regexp_extract(token, r"^[+-]?(\d*)", 1)
    part = F.regexp_extract(token, r"\.(\d*)", 1)
    power = F.coalesce(F.regexp_extract(token, r"[eE]([+-]?\d+)$", 1).try_cast("int"), F.lit(0))
    parts = F.struct(F.concat(whole, part).alias("digits"), (F.length(whole) + power).alias("point"), sign.alias("sign"))

    def placed(p: Column) -> Column:
        digits, point = p["digits"], p["point"]
        size = F.length(digits)
        left = F.when(point <= 0, "").when(point >= size, F.concat(digits, F.repeat(F.lit("0"), F.greatest(point - size, F.lit(0))))).otherwise(F.substring(digits, F.lit(1), point))
        right = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))), digits)).when(point >= size, "").otherwise(F.substring(digits, point + 1, size))
        trimmed = F.struct(F.regexp_replace(left, "^0+", "").alias("left"), F.regexp_replace(right, "0+$", "").alias("right"))
        body = lambda t: F.concat(F.when(t["left"] == "", "0").otherwise(t["left"]), F.when(t["right"] == "", "").otherwise(F.concat(F.lit("."), t["right"])))
        return _let(_let(trimmed, body), lambda text: F.when(text == "0", "0").otherwise(F.concat(p["sign"], text)))

    return _let(parts, placed)


def normalize_number(value: Column) -> Column:
    """``struct<normalized, status>``: ``Answer: $1,000.00`` is ``1000``."""

    def judged(token: Column) -> Column:
        blank = value.isNull() | (F.regexp_replace(value, r"\s+", "") == "")
        status = F.when(blank, "missing_answer").when(~token.rlike(SCALAR), "invalid_format").otherwise("valid")
        return _result(plain_decimal(token), status)

    return _let(F.translate(unwrapped(value), ",$", ""), judged)


def normalize_answer(value: Column, answer_type: Column, n_labels: Column, base: int = 1) -> Column:
    kind = F.translate(F.lower(F.trim(answer_type)), "- ", "__")
    return F.when(kind.isin("number", "numeric", "scalar"), normalize_number(value)).when(kind.isin("option", "option_letter", "multiple_choice", "letter"), normalize_option(value, n_labels, base))


def canonicalize(value: Column, answer_type: Column, n_labels: Column, inverse: Column, relation: Column) -> Column:
    """``struct<canonical, status>`` in the original label space.

    Options go through ``inverse`` (transformed label to original); a number is only
    meaningful under identity or an invariant relation.
    """
    kind = F.translate(F.lower(F.trim(answer_type)), "- ", "__")
    number = kind.isin("number", "numeric", "scalar")
    lost = number & ~F.lower(relation).isin("identity", "invariant")

    def back(done: Column) -> Column:
        mapped = F.when(number, done["normalized"]).otherwise(F.try_element_at(inverse, done["normalized"]))
        status = F.when(lost, "unsupported_relation").otherwise(done["status"])
        return F.struct(F.when(status == "valid", mapped).alias("canonical"), status.alias("status"))

    return _let(normalize_answer(value, answer_type, n_labels), back)


def method_name(value: Column, aliases: dict[str, str]) -> Column:
    """The name an alias stands for (any case); unknown names only lose outer blanks."""
    text = F.trim(value)
    known = F.create_map(*[F.lit(x) for k, v in aliases.items() for x in (k.lower(), v)]) if aliases else None
    return F.coalesce(F.try_element_at(known, F.lower(text)), text) if aliases else text
