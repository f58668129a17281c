"""Reading answers out of responses: explicit answer fields, options, numbers, words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Data sets by kind, and the patterns of an explicit answer field.
OPTION_DATASETS = ["arc_challenge", "arc_easy", "aqua_rat", "commonsense_qa", "gpqa", "logiqa", "math_qa", "mathqa", "openbookqa", "reclor", "sciq", "winogrande"]
NUMERIC_DATASETS = ["gsm8k", "object_counting", "svamp"]
MARKER = r"(?<![A-Za-z0-9_])(?:\*{1,2})?(?:final\s+)?answer\s*:(?:\*{1,2})?"
FIELD = rf"(?imd){MARKER}[ \t]*(.*?)(?={MARKER}|$)"
BOXED = r"(?i)^\\boxed\s*\{\s*([^{}]+?)\s*\}"
OPTION = r"^(?:\*{1,2})?\s*(?:\(\s*)?([A-Ea-e])(?:\s*\))?(?:\*{1,2})?(?=$|[\s.,;:!?])"
IN_BRACKETS = r"\(\s*([A-Ea-e])\s*\)"
OPTION_NUMBER = r"^\(?\s*([1-5])\s*\)?(?=$|[\s.,;:!?])"
NUMBER = r"^[ \t]*([-+]?(?:[$£€][ \t]*)?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE][-+]?\d+)?)(?![\d,])"
# Number words.
SMALL = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = {"thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
# The last answer line, and the tokens of a strategy.
LAST_ANSWER = r"(?is)(?:^|\n)\s*(?:\*\*)?answer(?:\*\*)?\s*[:\-].*$"
STRATEGY_TOKEN = r"[a-zA-Z]+|[-+*/=<>]|\d+(?:\.\d+)?"


def _found(value: Column, pattern: str, group: int = 1) -> Column:
    hit = F.regexp_extract(value, pattern, group)
    return F.when(hit != "", hit)


def dataset_name(value: Column) -> Column:
    return F.replace(F.lower(F.trim(value.cast("string"))), F.lit("-"), F.lit("_"))


def answer_kind(dataset: Column, answer_type: Column) -> Column:
    """``option``, ``number`` or ``unknown``; a type that says so goes before the name."""
    kind, name = F.lower(F.trim(answer_type)), dataset_name(dataset)
    return (
        F.when(kind.contains("option") | kind.contains("letter"), "option")
        .when(kind.contains("number") | kind.contains("numeric"), "number")
        .when(name.isin(OPTION_DATASETS), "option")
        .when(name.isin(NUMERIC_DATASETS), "number")
        .otherwise("unknown")
    )


def unboxed(value: Column) -> Column:
    text = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.coalesce(_found(text, BOXED), text)


def option_field(value: Column) -> Column:
    """A letter; else the bracketed letter after a number; else a digit 1-5 as a letter."""
    text = unboxed(value)
    after_number = F.when(text.rlike(NUMBER), _found(F.regexp_replace(text, NUMBER, ""), IN_BRACKETS))
    digit = _found(text, OPTION_NUMBER)
    return F.coalesce(F.upper(_found(text, OPTION)), F.upper(after_number), F.char(digit.try_cast("int") + 64))


def number_words(value: Column) -> Column:
    """An English integer phrase at the beginning, or null; stops at the first other word."""
    words = F.regexp_extract_all(F.lower(F.replace(value, F.lit("-"), F.lit(" "))), F.lit("[A-Za-z]+"), F.lit(0))
    values = {w: i for i, w in enumerate(SMALL)} | {w: 20 + 10 * i for i, w in enumerate(TENS)}
    small = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    scales = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    minus = F.coalesce(F.get(words, F.lit(0)).isin("minus", "negative"), F.lit(False))
    rest = F.when(minus, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("sum"), F.lit(False).alias("some"), F.lit(False).alias("over"))

    def step(s: Column, w: Column) -> Column:
        plain, scale = F.try_element_at(small, w), F.try_element_at(scales, w)
        hundred = (w == "hundred") & s["some"]
        scaled = scale.isNotNull() & s["some"]
        skip = (w == "and") & s["some"]
        now = F.when(plain.isNotNull(), s["now"] + plain).when(hundred, F.greatest(s["now"], F.lit(1)) * 100).when(scaled, F.lit(0)).otherwise(s["now"])
        total = F.when(scaled, s["sum"] + F.greatest(s["now"], F.lit(1)) * scale).otherwise(s["sum"])
        known = plain.isNotNull() | hundred | scaled | skip
        done = s["over"] | ~known
        return F.struct(
            F.when(done, s["now"]).otherwise(now).cast("long").alias("now"), F.when(done, s["sum"]).otherwise(total).cast("long").alias("sum"), F.when(done, s["some"]).otherwise(s["some"] | plain.isNotNull()).alias("some"), done.alias("over")
        )

    sign = F.when(minus, F.lit(-1)).otherwise(F.lit(1))
    return F.aggregate(rest, zero, step, lambda s: F.when(s["some"], sign * (s["sum"] + s["now"])))


def numeric_field(value: Column) -> Column:
    text = unboxed(value)
    return F.coalesce(F.translate(_found(text, NUMBER), ",$£€ ", ""), number_words(text).cast("string"))


def coerced(dataset: Column, value: Column) -> Column:
    """``object_counting``: integral values as integers; ``gsm8k``: without ``.00``."""
    name, number = dataset_name(dataset), value.try_cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("string")).otherwise(number.cast("string"))
    return F.when(name == "object_counting", whole).when((name == "gsm8k") & value.endswith(".00"), F.regexp_replace(value, r"\.00$", "")).otherwise(value)


def explicit_answer(dataset: Column, text: Column, answer_type: Column) -> Column:
    """The last answer field of the text that parses; free text is never read."""
    kind = answer_kind(dataset, answer_type)
    fields = F.reverse(F.regexp_extract_all(text, F.lit(FIELD), F.lit(1)))

    def parse(field: Column) -> Column:
        option = F.when(kind.isin("option", "unknown"), option_field(field))
        number = F.when(kind.isin("number", "unknown"), coerced(dataset, numeric_field(field)))
        return F.coalesce(option, number)

    return F.get(F.filter(F.transform(fields, parse), lambda a: a.isNotNull()), F.lit(0))


def loose_option(text: Column) -> Column:
    """The last letter that follows ``answer``, ``option`` or ``choice``."""
    hits = F.regexp_extract_all(text, F.lit(r"(?i)(?:answer|option|choice)\s*(?:is|:)?\s*\(?([A-E])\)?(?![A-Za-z])"), F.lit(1))
    return F.upper(F.try_element_at(hits, F.lit(-1)))


def arc_label(label: Column) -> Column:
    text = F.upper(F.trim(label.cast("string")))
    return F.when(text.rlike("^[1-5]$"), F.translate(text, "12345", "ABCDE")).otherwise(text)


def marked_gold(text: Column) -> Column:
    """The number after ``####``, else the last number of the text."""
    marked = _found(text, r"####\s*([-+]?[$]?[0-9][0-9,]*(?:\.[0-9]+)?)")
    numbers = F.regexp_extract_all(text, F.lit(r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?"), F.lit(0))
    return F.translate(F.coalesce(marked, F.try_element_at(numbers, F.lit(-1))), ",$", "")


def option_texts(text: Column) -> Column:
    """``a ) x , b ) y`` as an array of texts in order of their labels."""
    return F.regexp_extract_all(text, F.lit(r"(?s)[a-e]\s*\)\s*(.*?)\s*(?=,\s*[a-e]\s*\)|$)"), F.lit(1))


def text_key(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def strategy_tokens(text: Column) -> Column:
    """Distinct lower-case words, signs and numbers before the last answer line."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.regexp_replace(text, LAST_ANSWER, " ")), F.lit(STRATEGY_TOKEN), F.lit(0)))


def yes_no_probability(tokens: Column) -> Column:
    """``struct<yes, no>``: summed probabilities of top tokens that contain the word."""

    def mass(word: str) -> Column:
        kept = F.filter(tokens, lambda t: t["token"].contains(word))
        return F.aggregate(kept, F.lit(0.0), lambda acc, t: acc + F.exp(t["logprob"].cast("double")))

    return F.struct(mass("Yes").alias("yes"), mass("No").alias("no"))
