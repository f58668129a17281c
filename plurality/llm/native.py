"""Column helpers shared by the operators that use built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Matches of a text that are folded into one array at a time.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row, even inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found_spans(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost matches of a Java pattern as ``array<struct<start, ord, end, kind>>``.

    Offsets are code points, the end exclusive. Matches whose ``group`` is shorter than
    ``least`` are dropped after matching, so a dropped match still takes its characters.
    """
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    gaps = F.split(text, pattern, -1)
    triples = F.arrays_zip(F.transform(hits, F.length).alias("n"), F.transform(parts, F.length).alias("m"), F.transform(gaps, F.length).alias("gap"))

    def grow(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + F.coalesce(x["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
        taken = x["n"].isNotNull() & (x["m"] >= least)
        return F.struct(end.alias("pos"), F.when(taken, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def spans(begin: Column, chunk: Column) -> Column:
        return F.aggregate(chunk, F.struct(begin.alias("pos"), empty.alias("out")), grow, lambda acc: acc["out"])

    # arrays grow by copying, so many matches are taken in chunks, whose beginnings come first
    def chunked(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / CHUNK).cast("int")), lambda k: F.slice(all_, k * CHUNK + 1, CHUNK))
        length = lambda chunk: F.aggregate(chunk, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["n"], F.lit(0)))
        begins = lambda cs: F.aggregate(cs, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + length(c))))
        return let(chunks, lambda cs: let(begins(cs), lambda at: F.flatten(F.transform(cs, lambda c, k: spans(F.get(at, k), c)))))

    few = lambda all_: F.when(F.size(all_) <= CHUNK, spans(F.lit(0), all_)).otherwise(chunked(all_))
    return F.when(text.rlike(pattern), let(triples, few)).otherwise(empty)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans (sorted by start) replaced by ``mark``."""

    ends = lambda part: F.array_max(F.transform(part, lambda x: x["end"]))
    count = F.size(spans)
    starts = F.sequence(F.lit(0), F.floor((count - 1) / CHUNK).cast("int"))

    # how far the spans of all chunks before one reach, then those before a span in its own
    def joined(before: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            k = F.floor(i / CHUNK).cast("int")
            reach = F.greatest(F.get(before, k), F.coalesce(ends(F.slice(spans, k * CHUNK + 1, i - k * CHUNK)), F.lit(0)))
            return let(reach, lambda r: F.when(s["start"] < r, F.lit("")).otherwise(F.concat(F.substring(text, r + 1, s["start"] - r), F.lit(mark))))

        return F.array_join(F.transform(spans, piece), "")

    before = F.aggregate(starts, F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), ends(F.slice(spans, k * CHUNK + 1, CHUNK))))))
    rest = let(ends(spans), lambda end: F.substring(text, end + 1, F.length(text)))
    return F.when(count > 0, F.concat(let(before, joined), rest)).otherwise(text)


def apart(spans: Column, others: Column) -> Column:
    """Of ``spans`` those that no span of ``others`` overlaps; both are sorted by start, and
    ``spans`` do not overlap each other.

    How many of the others begin before a span ends is its place in both arrays sorted
    together; how far those reach is known for whole chunks, and found inside one.
    """
    # a span's end goes before a start at the same place, as those do not overlap
    marks = F.array_sort(F.concat(F.transform(others, lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("tag"))), F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("tag")))))
    places = F.transform(F.filter(F.transform(marks, lambda m, i: F.struct(m["tag"].alias("tag"), i.alias("i"))), lambda m: m["tag"] == 0), lambda m, j: m["i"] - j)
    ends = F.transform(others, lambda o: o["end"])
    reach = lambda e, n: F.coalesce(F.array_max(F.slice(e, F.floor(n / CHUNK).cast("int") * CHUNK + 1, n % CHUNK)), F.lit(0))
    starts = F.sequence(F.lit(0), F.floor(F.size(others) / CHUNK).cast("int"))
    before = lambda e: F.aggregate(starts, F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), F.coalesce(F.array_max(F.slice(e, k * CHUNK + 1, CHUNK)), F.lit(0))))))

    def free(n: Column, e: Column, b: Column) -> Column:
        return F.filter(spans, lambda s, j: let(F.get(n, j), lambda m: F.greatest(reach(e, m), F.get(b, F.floor(m / CHUNK).cast("int"))) <= s["start"]))

    return F.when(F.size(others) == 0, spans).otherwise(let(places, lambda n: let(ends, lambda e: let(before(e), lambda b: free(n, e, b)))))
