"""URL filter: host and path rules, then a character language-model ratio.

URLs that a rule decides teach two character models, one of accepted and one of rejected
URLs. What any rule can look at (a host ending, a beginning of the path) is cut out of every
URL first, so the models learn what else such URLs have in common. The rest is cut into
parts at its marks, and a character is told from up to ``ORDER`` characters before it in its
part: Witten-Bell interpolation from the longest context seen down to none. Counts are
tables of strings, which grow with the input and are joined, never sent to the driver.

The rest of the URLs is judged by the difference of log-likelihoods per character against a
threshold calibrated on rule-decided URLs whose hosts were left out of the counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, hot_join

# The rules of the registered query.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Characters the models tell apart: begin, end, any other, a run of digits, letters, marks.
ALPHABET = "^$*0abcdefghijklmnopqrstuvwxyz./-_=&?%:#~+"
#: Most characters before one that tell of it.
ORDER = 5
#: Parts begin at these.
PART = "(?=[./?&=#])"
#: Log-likelihoods are summed as whole numbers of this fraction, so order does not matter.
UNIT = 1e-9
BINS, RANGE = 1024, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, or null. A rule is a host and the start of a path."""
    found = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.lit(text)).otherwise(found)
    return found


def _parts(host: Column, rest: Column, rules: list[tuple[str, str]]) -> Column:
    """Parts of a URL over ``ALPHABET``: host, then path and query, without what rules name.

    Every host loses as many labels at its end as the shortest rule has, whichever rule fits
    it, so what is left tells neither the ending nor which rule decided.
    """
    named = min((r.partition("/")[0].count(".") + 1 for r, _ in rules), default=0)
    labels = F.split(host, r"\.")
    cut_host = F.array_join(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - named, F.lit(0))), ".")
    cut_rest = rest
    for start in sorted({r.partition("/")[2] for r, _ in rules} - {""}, key=len):
        cut_rest = F.when(rest.startswith("/" + start), F.substring(rest, F.lit(len(start) + 1), F.length(rest))).otherwise(cut_rest)
    low = F.regexp_replace(F.lower(F.concat(cut_host, cut_rest)), "[0-9]+", "0")
    known = F.regexp_replace(low, "[^0a-z./_=&?%:#~+-]", "*")
    return F.transform(F.split(F.concat(F.lit("^"), known), PART), lambda part: F.concat(part, F.lit("$")))


def _strings(parts: DataFrame) -> DataFrame:
    """``kind, x`` and sums of a model from ``part, a, b`` (how often either verdict has it).

    Kind 0 counts the string ``x``; kind 1 what follows ``x``: how often (``a``, ``b``) and
    how many different characters (``ta``, ``tb``).
    """
    at = F.explode(F.sequence(F.lit(2), F.length("part")))
    ends = parts.select("part", "a", "b", at.alias("at"))
    sizes = F.explode(F.sequence(F.lit(1), F.least("at", F.lit(ORDER + 1))))
    grams = ends.select("part", "a", "b", "at", sizes.alias("n")).select(F.expr("substring(part, at - n + 1, n)").alias("x"), "a", "b")
    counted = grams.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    zero = F.lit(0).cast("long")
    follows = counted.groupBy(F.expr("left(x, length(x) - 1)").alias("x")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
    return counted.select(F.lit(0).alias("kind"), "x", "a", "b", zero.alias("ta"), zero.alias("tb")).union(follows.select(F.lit(1), "x", "a", "b", "ta", "tb"))


def part_scores(parts: DataFrame, learnt: DataFrame) -> DataFrame:
    """``part, n, units``: characters told, and the sum of their log-ratios in ``UNIT``.

    Each different context with its character is judged once: the strings it ends in are
    joined to the models' tables, and folded from the shortest to the longest.
    """
    ends = parts.select("part", F.explode(F.sequence(F.lit(2), F.length("part"))).alias("at"))
    told = ends.select("part", F.expr(f"substring(part, greatest(1, at - {ORDER}), least(at, {ORDER + 1}))").alias("gram"))
    sizes = F.sequence(F.lit(1), F.length("gram"))
    cut = lambda k: F.substring(F.right(F.col("gram"), k), F.lit(1), k - 1)
    wanted = F.flatten(F.transform(sizes, lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("kind"), F.right(F.col("gram"), k).alias("x")), F.struct(k.alias("k"), F.lit(1).alias("kind"), cut(k).alias("x")))))
    keys = told.select("gram").distinct().select("gram", F.explode(wanted).alias("w")).select("gram", "w.*")
    found = keys.join(_strings(learnt), ["kind", "x"]).groupBy("gram", "k").agg(
        *(F.coalesce(F.max(F.when(F.col("kind") == 0, F.col(c))), F.lit(0)).alias(c) for c in ("a", "b")),
        *(F.max(F.when(F.col("kind") == 1, F.col(c))).alias(name) for c, name in (("a", "na"), ("b", "nb"), ("ta", "ta"), ("tb", "tb"))),
    )
    levels = found.groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "na", "nb", "ta", "tb"))).alias("levels"))  # ORDER + 1 at most

    def mixed(p: Column, level: Column, c: str) -> Column:
        n, kinds = level[f"n{c}"], level[f"t{c}"]
        return F.when(n > 0, (level[c] + kinds * p) / (n + kinds)).otherwise(p)

    start = F.struct(F.lit(1 / len(ALPHABET)).alias("a"), F.lit(1 / len(ALPHABET)).alias("b"))
    ratio = F.aggregate("levels", start, lambda p, level: F.struct(mixed(p["a"], level, "a").alias("a"), mixed(p["b"], level, "b").alias("b")), lambda p: F.log(p["a"]) - F.log(p["b"]))
    judged = levels.select("gram", F.round(ratio / UNIT).cast("long").alias("units"))
    return told.join(judged, "gram", "left").groupBy("part").agg(F.count("*").alias("n"), F.sum(F.coalesce("units", F.lit(0))).alias("units"))


def left_out(host: str) -> Column:
    """A quarter of the hosts is not learnt from, and calibrates the threshold."""
    return F.pmod(F.xxhash64(host), F.lit(4)) == 0


def url_ratios(urls: DataFrame, scratch: Scratch) -> DataFrame | None:
    """``row, ratio`` from ``row, host, parts, verdict`` rows (verdict null where no rule
    decides); None unless both verdicts have rows to learn from."""
    used = urls.withColumn("learnt", ~left_out("host") & F.col("verdict").isNotNull())
    counts = used.select("verdict", "learnt", F.explode("parts").alias("part")).groupBy("part").agg(
        F.count("*").alias("rows"), *(F.count_if(F.col("learnt") & (F.col("verdict") == v)).alias(c) for v, c in (("allow", "a"), ("block", "b")))
    )
    counts = scratch.keep(counts)
    total = counts.agg(F.sum("rows"), F.sum("a"), F.sum("b")).first()
    if not total[1] or not total[2]:
        return None
    learnt = counts.where("a + b > 0").select("part", "a", "b")
    scored = part_scores(counts.select("part"), learnt).join(counts.select("part", "rows"), "part")
    scored = scratch.keep(scored.select("part", "n", "units", "rows"))
    lines = urls.select("row", F.explode("parts").alias("part"))
    summed = hot_join(lines, scored, "part", F.col("rows"), total[0]).groupBy("row").agg(F.sum("units").alias("units"), F.sum("n").alias("n"))
    return summed.select("row", (F.col("units") * UNIT / F.col("n")).alias("ratio"))


def threshold_of(tested: DataFrame) -> float:
    """From ``verdict, ratio`` rows: where errors are fewest, both verdicts weighing the same.

    ``2 x BINS`` numbers reach the driver.
    """
    place = F.floor((F.col("ratio") + RANGE) * (BINS / (2 * RANGE)))
    counted = tested.groupBy("verdict", F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int").alias("bin")).count()
    tally = {"allow": np.zeros(BINS), "block": np.zeros(BINS)}
    for row in counted.collect():
        tally[row["verdict"]][row["bin"]] = row["count"]
    if not (tally["allow"].any() and tally["block"].any()):
        return 0.0
    lost = np.concatenate([[0], np.cumsum(tally["allow"])]) / tally["allow"].sum()
    passed = 1 - np.concatenate([[0], np.cumsum(tally["block"])]) / tally["block"].sum()
    best = np.flatnonzero(lost + passed <= (lost + passed).min() + 1e-12)
    return float(best[len(best) // 2] * (2 * RANGE / BINS) - RANGE)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``id, host, path, rule, verdict, ratio``.

    The host stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in
    lower case; the path goes on to ``?``, ``#`` or the end. A null URL, or one without
    ``://``, has both empty. ``rule`` is the longest rule that fits host (or a subdomain)
    and path, else null; the verdict is the rule's, else the models' (``allow`` if the ratio
    reaches the threshold). URLs that are null or empty, and all undecided ones where either
    verdict has no rule-decided URL, are allowed with a null ratio. Very long URLs are read
    whole. Nulls in the id and repeated rows stay.
    """
    url = F.col(url_col)
    scratch = Scratch(pages.sparkSession)
    named = pages.select(F.col(id_col).alias("id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = named.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.lit(None).cast("string")
    for text, what in rules:
        verdict = F.when(F.col("rule") == text, F.lit(what)).otherwise(verdict)
    rest = F.regexp_replace("url", "^[^/?#]*://[^/?#]*", "")
    parts = F.when(F.length("url") > 0, _parts(F.col("host"), rest, rules))
    # rows get a number, so that a URL or id of very many rows is no hot key
    ready = scratch.keep(ruled.select(F.monotonically_increasing_id().alias("row"), "id", "host", "path", "rule", verdict.alias("verdict"), parts.alias("parts")))
    ratios = url_ratios(ready.where("parts IS NOT NULL"), scratch)
    if ratios is None:
        return ready.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("ratio"))
    told = scratch.keep(ready.drop("parts").join(ratios, "row", "left"))
    least = threshold_of(told.where(F.col("verdict").isNotNull() & F.col("ratio").isNotNull() & left_out("host")).select("verdict", "ratio"))
    judged = F.when(F.col("ratio") < least, F.lit("block")).otherwise(F.lit("allow"))
    return told.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", judged).alias("verdict"), "ratio")
