"""Secret scan: fixed patterns, and Shannon entropy in windows over candidate strings.

Built-in column expressions only. A candidate is a long run of key characters. Its class
(hexadecimal, letters, or letters with digits) sets the entropy that a window of ``WINDOW``
characters must reach. The window moves by one character at a time: the sum of
``c log2 c`` over character counts changes only by the counts of the character that leaves
and of the one that enters. Candidates on the allow-list are suppressed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.native import apart, found_spans, let, replaced, span_text

# The three base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
# Parameters of the entropy scan.
CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
HEX_BITS = 3.0
MIXED_BITS = 3.6
LETTER_BITS = 3.6
#: A word has letters of one case, or a capital before small ones.
WORD = "(?:[A-Z]?[a-z]++|[A-Z]++)"
#: Candidates that look random and are no secrets: UUIDs, dates and numbers, words joined
#: by marks, paths, placeholders as a whole. Repeated groups are possessive, as
#: others recurse once a repeat in Java and end in a stack overflow on long texts.
ALLOWED = [
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "^[0-9+/_=-]+$",
    f"^[+/_=-]*+(?:{WORD}(?:[+/_=-]++|$))*+$",
    f"^(?:{WORD}[-_/=+]|[0-9]++[-_/=+])++(?:{WORD}|[0-9]+)?$",
    "(?i)^(?:example|placeholder|x{4,}+|0{7,}+|[+/_=-])++$",
]


def _weight(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def most_entropy(candidate: Column) -> Column:
    """The largest entropy in bits of the candidate's windows.

    The fold holds how often the window has each character of the candidate; a step takes
    one from the count of the character that leaves and adds one to that of the one that
    enters.
    """

    def walk(chars: Column) -> Column:
        kinds = F.array_distinct(chars)
        return let(F.struct(F.transform(chars, lambda c: F.array_position(kinds, c).cast("int")).alias("codes"), F.size(kinds).alias("kinds")), slide)

    def slide(c: Column) -> Column:
        codes = c["codes"]
        head = F.slice(codes, 1, WINDOW)
        counts = F.transform(F.sequence(F.lit(1), c["kinds"]), lambda k: F.size(F.filter(head, lambda x: x == k)))

        def move(acc: Column, i: Column) -> Column:
            gone, come = F.get(codes, i - 1), F.get(codes, i + WINDOW - 1)
            less, more = F.get(acc["counts"], gone - 1).cast("double"), F.get(acc["counts"], come - 1).cast("double")
            changed = acc["sum"] + _weight(less - 1) - _weight(less) + _weight(more + 1) - _weight(more)
            after = F.transform(acc["counts"], lambda n, k: n + F.when(k + 1 == come, 1).otherwise(0) - F.when(k + 1 == gone, 1).otherwise(0))
            moved = lambda s: F.struct(after.alias("counts"), s.alias("sum"), F.least(acc["least"], s).alias("least"))
            return F.when(gone == come, acc).otherwise(let(changed, moved))

        total = lambda n: F.aggregate(n, F.lit(0.0), lambda acc, x: acc + _weight(x.cast("double")))
        start = let(counts, lambda n: let(total(n), lambda s: F.struct(n.alias("counts"), s.alias("sum"), s.alias("least"))))
        steps = F.when(F.size(codes) > WINDOW, F.sequence(F.lit(1), F.size(codes) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, move, lambda acc: F.lit(math.log2(WINDOW)) - acc["least"] / WINDOW)

    return let(F.split(candidate, ""), walk)


def entropy_spans(text: Column, base: Column) -> Column:
    """Candidates of enough entropy that are not allowed and touch no base span."""
    spans = found_spans(text, CANDIDATE, "entropy", 3)

    def random(s: Column) -> Column:
        def judged(word: Column) -> Column:
            allowed = F.lit(False)
            for pattern in ALLOWED:
                allowed = allowed | word.rlike(pattern)
            bits = F.when(word.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).when(word.rlike("^[A-Za-z+/_=-]+$"), F.lit(LETTER_BITS)).otherwise(F.lit(MIXED_BITS))
            return F.when(allowed, F.lit(False)).otherwise(most_entropy(word) >= bits)

        return let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), judged)

    clear = let(spans, lambda s: F.when(F.size(s) > 0, apart(s, base)).otherwise(s))
    return F.filter(clear, random)


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``_base`` and ``_all`` span arrays, each sorted by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.array_sort(F.concat(found_spans(text, ASSIGN, "assign", 0, group=2, least=6), found_spans(text, ACCESS, "access", 1), found_spans(text, HEX, "hex", 2)))
    both = let(base, lambda b: F.struct(b.alias("base"), F.array_sort(F.concat(b, entropy_spans(text, b))).alias("all")))
    return docs.withColumn("_spans", both)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts per base kind, their digest, and all spans.

    Base kinds: ``assign`` (a key word, ``:`` or ``=``, a value of 6 characters or more),
    ``access`` (AKIA and 16 or more capitals or digits), ``hex`` (24 or more digits of it);
    the method adds ``entropy`` spans apart from those. Spans are ``kind:start:end`` by
    start, then kind; ``base_sha256`` is of the base ones. A null or empty text has none.
    Texts of any length are read whole. Nulls in the id and repeated rows stay; other columns
    are not read. No shuffle.
    """
    scanned = _scanned(docs.select(F.col(id_col), F.col(text_col)), text_col)
    base, every = F.col("_spans.base"), F.col("_spans.all")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(id_col, count("assign"), count("access"), count("hex"), F.sha2(span_text(base), 256).alias("base_sha256"), span_text(every).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``; a null text stays."""
    columns = docs.columns
    scanned = _scanned(docs, text_col)
    clean = F.when(F.col(text_col).isNull(), F.lit(None).cast("string")).otherwise(replaced(F.col(text_col), F.col("_spans.all"), mark))
    return scanned.withColumn(text_col, clean).select(*columns)
