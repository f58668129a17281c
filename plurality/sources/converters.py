"""Rows of public question sets as examples: stem, options or number, and the right answer.

A converter is a set of column expressions over the fields of its set; ``convert`` gives every
row a ``failure`` instead of an exception, and ``accepted`` raises once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import normalize as N
from plurality.functions.answers import arc_label, explicit_answer, marked_gold
from plurality.functions.hashing import NUL, question_key, source_id

# Where an option of a joined list begins.
JOINED_LABEL = r"(?:^|,\s*)([A-Ea-e])\s*\)"
OPTION, NUMBER = "option letter", "number"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")


def position_of(labels: Column, answer: Column) -> Column:
    """0-based place of an answer's label; where no label is equal, a number counts from 1."""
    wanted = F.upper(stripped(answer))
    direct = F.array_position(F.transform(labels, lambda x: F.upper(stripped(x))), wanted) - 1
    number = F.when(wanted.rlike("^[1-9][0-9]*$"), wanted.try_cast("long") - 1)
    return F.when(direct >= 0, direct).when(number < F.size(labels), number)


def joined_options(raw: Column) -> tuple[Column, Column]:
    """``a ) x , b ) y`` as (labels, texts); both empty with fewer than two labels."""
    labels = F.transform(F.regexp_extract_all(raw, F.lit(JOINED_LABEL), F.lit(1)), F.upper)
    pieces = F.split(raw, JOINED_LABEL, -1)
    values = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda v: stripped(F.regexp_replace(stripped(v), "^,+|,+$", "")))
    some = F.size(labels) >= 2
    return F.when(some, labels).otherwise(F.array().cast("array<string>")), F.when(some, values).otherwise(F.array().cast("array<string>"))


Parts = tuple[Column, Column | None, Column | None, Column | None]


def _choices(stem: str) -> Callable[[], Parts]:
    return lambda: (F.concat(F.lit("Question: "), F.col(stem)), F.col("choices.text"), position_of(F.col("choices.label"), F.col("answerKey")), None)


def _reading(head: str, question: str, options: str, answer: Callable[[], Column]) -> Callable[[], Parts]:
    return lambda: (F.concat(F.lit(f"{head}:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col(question)), F.col(options), answer(), None)


def _letter_or_index() -> Column:
    raw, n = F.upper(stripped(F.col("correct_option"))), F.size("options")
    letter = F.when(raw.rlike("^[A-Z]$"), F.ascii(raw) - 65)
    return F.coalesce(F.when(letter < n, letter), raw.try_cast("int"))


def _sorted_distractors() -> Parts:
    """Options sorted by text; of equal ones the earlier field first, the right answer last."""
    fields = ["distractor1", "distractor2", "distractor3", "correct_answer"]
    pairs = F.array_sort(F.array(*[F.struct(F.col(f).cast("string").alias("text"), F.lit(i).alias("field")) for i, f in enumerate(fields)]))
    place = F.array_position(F.transform(pairs, lambda p: p["field"]), F.lit(3)) - 1
    return F.concat(F.lit("Question: "), stripped(F.col("question"))), F.transform(pairs, lambda p: p["text"]), place, None


def _two_options() -> Parts:
    token = F.upper(stripped(F.col("answer")))
    place = F.when(token.isin("1", "A"), 0).when(token.isin("2", "B"), 1)
    return F.concat(F.lit("Question: "), stripped(F.col("sentence"))), F.array("option1", "option2"), place, None


def _joined() -> Parts:
    labels, values = joined_options(F.col("options"))
    return F.concat(F.lit("Problem: "), F.col("Problem")), values, position_of(labels, F.col("correct")), None


def _marked() -> Parts:
    return F.concat(F.lit("Question: "), stripped(F.col("question"))), None, None, N.normalize_number(marked_gold(F.col("answer").cast("string")))["normalized"]


def _body_and_question() -> Parts:
    """Both texts as they are, without a blank between them."""
    return stripped(F.concat(F.lit("Question: "), F.col("Body"), F.col("Question"))), None, None, N.normalize_number(F.col("Answer").cast("string"))["normalized"]


#: Fields a set must have, and its parts: stem, options, place of the right one, or number.
CONVERTERS: dict[str, tuple[list[str], Callable[[], Parts]]] = {
    "arc_easy": (["question", "choices", "answerKey"], _choices("question")),
    "arc_challenge": (["question", "choices", "answerKey"], _choices("question")),
    "commonsense_qa": (["question", "choices", "answerKey"], _choices("question")),
    "openbookqa": (["question_stem", "choices", "answerKey"], _choices("question_stem")),
    "reclor": (["context", "question", "answers", "label"], _reading("Passage", "question", "answers", lambda: F.col("label").try_cast("int"))),
    "logiqa": (["context", "query", "options", "correct_option"], _reading("Article", "query", "options", _letter_or_index)),
    "math_qa": (["Problem", "options", "correct"], _joined),
    "sciq": (["question", "distractor1", "distractor2", "distractor3", "correct_answer"], _sorted_distractors),
    "winogrande": (["sentence", "option1", "option2", "answer"], _two_options),
    "gsm8k": (["question", "answer"], _marked),
    "svamp": (["Body", "Question", "Answer"], _body_and_question),
}


def convert(rows: DataFrame, dataset: str, split: str, index: str = "source_index", most: int | None = None) -> DataFrame:
    """``dataset_name, split, source_index, question_id, stem, options, correct_index,
    correct_answer, answer_type, failure`` of each row.

    ``index`` numbers the rows from 0; ``most`` keeps those below it. A number's options are
    empty; its answer is the normalised number, an option's the label. ``failure`` is null
    for a good row, else says what is missing or not found; its other columns stay as far as
    they are known.
    """
    if dataset not in CONVERTERS:
        raise ValueError(f"no converter for {dataset!r}")
    fields, parts = CONVERTERS[dataset]
    if lost := [f for f in fields if f not in rows.columns]:
        raise KeyError(f"{dataset} rows lack {lost}")
    if most is not None:
        rows = rows.where(F.col(index) < most)
    stem, options, place, number = parts()
    numeric = number is not None
    texts = F.array().cast("array<string>") if numeric else F.transform(options, stripped)
    names = [c for c in ("id", "idx", "index", "question_id") if c in rows.columns]
    source = source_id(F.col(index), *[F.col(c) for c in names])
    key = question_key(F.lit(dataset), F.lit(split), source, F.array_join(F.concat(F.array(stem), texts), NUL))
    missing = [F.when(F.col(f).isNull(), F.lit(f"missing {f}")) for f in fields]
    if numeric:
        wrong = F.when(number.isNull(), F.lit("no number"))
    else:
        n = F.size(texts)
        wrong = F.coalesce(F.when((n < 2) | (n > 26), F.lit("too few or many options")), F.when(F.exists(texts, lambda t: t == ""), F.lit("empty option")), F.when(~F.coalesce((place >= 0) & (place < n), F.lit(False)), F.lit("answer not found")))
    answer = number if numeric else F.char(65 + place)
    return rows.select(
        F.lit(dataset).alias("dataset_name"), F.lit(split).alias("split"), F.col(index).cast("long").alias("source_index"), key.alias("question_id"), stem.alias("stem"), texts.alias("options"),
        (F.lit(None) if numeric else place).cast("long").alias("correct_index"), answer.alias("correct_answer"), F.lit(NUMBER if numeric else OPTION).alias("answer_type"), F.coalesce(*missing, wrong).alias("failure"),
    )


def accepted(examples: DataFrame) -> DataFrame:
    """The examples without ``failure``; any failure is one error that names the first three."""
    failed = examples.where("failure IS NOT NULL")
    first = failed.orderBy("source_index").limit(3).collect()
    if first:
        raise ValueError(f"{failed.count()} rows not converted, first " + "; ".join(f"{r.source_index}: {r.failure}" for r in first))
    return examples.drop("failure")


def gold_answer(dataset: Column, text: Column) -> Column:
    """A trusted annotation: an explicit field, else the label or marked number itself."""
    name = F.lower(F.regexp_replace(stripped(dataset), "-", "_"))
    explicit = explicit_answer(dataset, text, F.lit(None).cast("string"))
    label = arc_label(text)
    letter = F.when(label.rlike("^[A-E]$"), label)
    return F.when(name.isin("math_qa", "mathqa"), F.coalesce(explicit, letter)).when(name.isin("gsm8k", "svamp", "object_counting"), F.coalesce(marked_gold(text), explicit)).otherwise(F.coalesce(letter, explicit))


def stem_without_options(text: Column) -> Column:
    """A rendered question without the lines of its options."""
    return stripped(F.regexp_replace(text, r"(?m)^[ \t]*\([A-Z]\)[ \t].*(?:\n|$)", ""))
