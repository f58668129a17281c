"""A question's samples as one row: running votes once, then every method folded in it.

``question_rows`` makes one row a question with its samples in order; each sample knows the
running votes up to it. Fixed votes, stopping rules and their fall-backs are then expressions
over that row, for any number of budgets, caps and thresholds, without another shuffle.
A rule's outcome along its grid is a list of changes: what it is from the first threshold on,
and by how much it differs from some threshold on. Sums of changes over questions, added up
along the grid, are the curve.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions.arrays import let

#: What a decision adds to a report's sums.
MEASURES = ["correct", "generated_samples", "valid_samples", "invalid_predictions", "insufficient_sample_questions", "early_stop_questions"]


def exact(kind: str, most: int) -> str:
    """The type that sums of ``most`` weights of a type are kept in: decimals of few digits are
    counted in their last digit, as whole numbers, which are added far faster."""
    digits = int(kind[8:].split(",")[0]) if kind.startswith("decimal") else 38
    return "bigint" if digits + len(str(most)) <= 18 else kind


def _whole(name: str, kind: str, most: int) -> Column:
    scale = 10 ** int(kind.rstrip(")").split(",")[1]) if exact(kind, most) != kind else 1
    return (F.col(name) * F.lit(scale)).cast(exact(kind, most)) if scale != 1 else F.col(name).cast(exact(kind, most))


def _running(rows: DataFrame, key: list[str], votes: dict[str, Column], min_valid: int) -> DataFrame:
    """Adds each name of ``votes``: ``struct<leader, value, before>`` after each row: the leading
    answer, its share of the votes once ``min_valid`` have voted, and the largest such share
    before.

    Rows without answer, or with a null or negative weight, do not vote; a zero total has
    share 0. Votes only grow, so the leader is a running maximum. All votes are found in one
    pass by answer and one by question.
    """
    c = F.col
    own = Window.partitionBy(*key, "answer").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    each = lambda of: {f"_{k}_{name}": v for name in votes for k, v in of(name).items()}
    rows = rows.withColumns(each(lambda n: {"w": F.when(c("answer").isNotNull() & (votes[n] >= 0), votes[n])}))
    rows = rows.withColumns(each(lambda n: {"m": F.sum(f"_w_{n}").over(own), "f": F.min(F.when(c(f"_w_{n}").isNotNull(), c("pos"))).over(own)}))
    lead = lambda n: F.when(c(f"_w_{n}").isNotNull(), F.struct(c(f"_m_{n}").alias("mass"), (-c(f"_f_{n}")).alias("f"), c("answer").alias("answer")))
    rows = rows.withColumns(each(lambda n: {"l": F.max(lead(n)).over(so_far), "t": F.sum(f"_w_{n}").over(so_far), "n": F.count(f"_w_{n}").over(so_far)}))
    part = lambda n: F.when(c(f"_t_{n}") > 0, c(f"_l_{n}.mass").cast("double") / c(f"_t_{n}").cast("double")).otherwise(0.0)
    rows = rows.withColumns(each(lambda n: {"v": F.when(c(f"_n_{n}") >= min_valid, part(n))}))
    rows = rows.withColumns(each(lambda n: {"b": F.max(f"_v_{n}").over(earlier)}))
    return rows.withColumns({n: F.struct(c(f"_l_{n}.answer").alias("leader"), c(f"_v_{n}").alias("value"), c(f"_b_{n}").alias("before")) for n in votes})


def question_rows(pool: DataFrame, key: list[str], most: int, min_valid: int, certainty: str) -> DataFrame:
    """``key, size, samples``: at most ``most`` samples of each question, in order.

    ``pos`` is the place in the order, from 0 without gaps, ``answered`` counts answers up to
    there, ``d`` is the confidence as a double, and ``c`` and ``n`` are weights to be summed, of
    the type ``exact`` tells. One shuffle by ``key``; windows and the group use the same
    partitioning.
    """
    ordered, kinds = Window.partitionBy(*key).orderBy("pos"), dict(pool.dtypes)
    rows = pool.select(*key, "pos", "answer", F.col("confidence").alias("c"), F.col(certainty).alias("n"))
    rows = rows.withColumns({"size": F.count("*").over(Window.partitionBy(*key)), "answered": F.count("answer").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "pos": (F.row_number().over(ordered) - 1).cast("long")}).where(F.col("pos") < most)
    rows = rows.withColumn("d", F.col("c").cast("double"))
    rows = _running(rows, key, {"by_count": F.lit(1), "by_weight": F.col("c")}, min_valid)
    earlier = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_v", F.when(F.col("answer").isNotNull(), F.col("d")))
    alone = F.struct(F.col("answer").alias("leader"), F.col("_v").alias("value"), F.max("_v").over(earlier).alias("before")).alias("alone")
    item = F.struct("pos", "answer", "answered", "d", _whole("c", kinds["confidence"], most).alias("c"), _whole("n", kinds[certainty], most).alias("n"), "by_count", "by_weight", alone)
    rows = rows.select(*key, "size", item.alias("item"))
    return rows.groupBy(*key).agg(F.max("size").alias("size"), F.array_sort(F.collect_list("item")).alias("samples"))


def _total(kind: str) -> str:
    """The type sums of a weight are kept in."""
    return "bigint" if kind == "bigint" else f"decimal(38,{kind.rstrip(')').split(',')[1]})" if kind.startswith("decimal") else "double"


def vote(samples: Column, weight: Callable[[Column], Column], kind: str) -> Column:
    """``struct<w, f, answer, total>``: the answer of the largest summed weight, of several the
    first seen, and the sum of all weights. Null without a vote."""
    total = _total(kind)
    added = lambda rows: F.aggregate(rows, F.lit(0).cast(total), lambda acc, x: (acc + weight(x)).cast(total))

    def best(valid: Column) -> Column:
        def one(answer: Column) -> Column:
            own = F.filter(valid, lambda x: x["answer"] == answer)
            return F.struct(added(own).alias("w"), (-F.array_min(F.transform(own, lambda x: x["pos"]))).alias("f"), answer.alias("answer"))

        top = F.array_max(F.transform(F.array_distinct(F.transform(valid, lambda x: x["answer"])), one))
        return let(top, lambda t: F.when(t.isNotNull(), F.struct(t["w"].alias("w"), t["f"].alias("f"), t["answer"].alias("answer"), added(valid).alias("total"))))

    return let(F.filter(samples, lambda x: x["answer"].isNotNull() & weight(x).isNotNull()), best)


def winner(samples: Column, weight: Callable[[Column], Column], kind: str) -> Column:
    """The answer of the largest summed weight; of several the first seen. Null without one."""
    return vote(samples, weight, kind)["answer"]


def informed_winner(samples: Column, temperature: float, scale: str) -> Column:
    """The vote with confidence turned to weights within ``samples`` (see ``votes``)."""
    score = lambda x: F.when(x["answer"].isNotNull(), x["d"])

    def weighed(edge: Column) -> Column:
        if scale == "softmax":
            value = lambda x: F.exp((score(x) - edge) / temperature)
        elif scale == "linear":
            value = lambda x: (score(x) - edge) * temperature + 1
        else:
            value = score
        rows = F.transform(samples, lambda x: F.struct(x["pos"].alias("pos"), x["answer"].alias("answer"), F.round(value(x), 12).cast("decimal(20,12)").alias("w")))
        return let(rows, lambda r: winner(r, lambda x: x["w"], "decimal(20,12)"))

    scores = F.transform(samples, score)
    return let(F.array_max(scores) if scale == "softmax" else F.array_min(scores), weighed)


def best_sample(samples: Column) -> Column:
    """The answer of the sample with the largest confidence; the first wins ties."""
    valid = F.filter(samples, lambda x: x["answer"].isNotNull() & x["c"].isNotNull())
    return F.array_max(F.transform(valid, lambda x: F.struct(x["c"].alias("s"), (-x["pos"]).alias("f"), x["answer"].alias("answer"))))["answer"]


def measures(samples: Column, gold: Column, prediction: Column, used: Column, status: Column | str) -> Column:
    """``array<long>`` of ``MEASURES`` for a decision."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    status = F.lit(status) if isinstance(status, str) else status
    answered = F.coalesce(F.get(samples, (used - 1).cast("int"))["answered"], F.lit(0).cast("long"))
    return F.array(flag(prediction == gold), used.cast("long"), answered, prediction.isNull().cast("long"), flag(status == "insufficient_samples"), flag(status == "early_stop"))


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def fixed_measures(budget: Column, prediction: Column, samples: Column, size: Column, gold: Column) -> Column:
    """Of a vote of ``budget`` samples; too few are all used and say nothing."""
    enough = size >= budget
    said = F.when(enough, prediction)
    status = F.when(~enough, "insufficient_samples").when(said.isNull(), "no_valid_answer").otherwise("ok")
    return measures(samples, gold, said, F.least(size, budget.cast("long")), status)


def fallback_measures(cap: Column, last: Column, full: Column, samples: Column, size: Column, gold: Column) -> Column:
    """Where no rule stops: ``last`` is said and ``full`` used, if there are ``cap`` samples."""
    short = size < cap
    status = F.when(short, "insufficient_samples").when(last.isNull(), "no_valid_answer").otherwise("ok")
    said = F.struct(F.when(~short, last).alias("p"), F.when(short, size).otherwise(full).cast("long").alias("u"), status.alias("s"))
    return let(said, lambda x: measures(samples, gold, x["p"], x["u"], x["s"]))


def changes(lifts: Column, base: Column, grid: Column) -> Column:
    """``array<struct<at, m>>``: measures from a place of the (sorted) grid on.

    ``lifts`` are ``struct<low, high, m>``: measures where the threshold is above ``low`` and
    at most ``high``.
    """
    upto = lambda value: F.coalesce(F.size(F.filter(grid, lambda t: t <= value)), F.lit(0))
    entry = lambda at, m: F.struct(at.cast("int").alias("at"), m.alias("m"))
    spans = F.filter(F.transform(lifts, lambda x: F.struct(F.when(x["low"].isNull(), 0).otherwise(upto(x["low"])).alias("a"), upto(x["high"]).alias("b"), _less(x["m"], base).alias("m"))), lambda x: x["a"] < x["b"])
    each = F.transform(spans, lambda x: F.array(entry(x["a"], x["m"]), entry(x["b"], F.transform(x["m"], lambda v: -v))))
    return F.concat(F.array(entry(F.lit(0), base)), F.flatten(each))


def lifts(samples: Column, name: str, gold: Column) -> Column:
    """Samples of a prefix that are first to reach thresholds, for ``changes``."""
    first = F.filter(samples, lambda x: x[name]["value"].isNotNull() & (x[name]["before"].isNull() | (x[name]["value"] > x[name]["before"])))
    return F.transform(first, lambda x: F.struct(x[name]["before"].alias("low"), x[name]["value"].alias("high"), measures(samples, gold, x[name]["leader"], x["pos"] + 1, "early_stop").alias("m")))


def buffer_lifts(samples: Column, capacity: int, kind: str, gold: Column) -> Column:
    """The same for buffers of ``capacity`` answered samples that reach a threshold: one case
    for each different score, as thresholds between two scores fill the same buffer."""
    score = lambda x: x["d"]

    def cases(items: Column) -> Column:
        def of(levels: Column) -> Column:
            def case(high: Column, at: Column) -> Column:
                kept = F.slice(F.filter(items, lambda x: score(x) >= high), 1, capacity)
                told = lambda k: measures(samples, gold, winner(k, lambda x: x["c"], kind), F.element_at(k, -1)["pos"] + 1, "early_stop")
                return F.struct(F.when(at > 0, F.get(levels, at - 1)).alias("low"), high.alias("high"), let(kept, lambda k: F.when(F.size(k) == capacity, told(k))).alias("m"))

            return F.filter(F.transform(levels, case), lambda x: x["m"].isNotNull())

        return let(F.array_sort(F.array_distinct(F.transform(items, score))), of)

    return let(F.filter(samples, lambda x: x["answer"].isNotNull() & x["c"].isNotNull()), cases)


def window_measures(cap: Column, sizes: Column, samples: Column, size: Column, gold: Column) -> Column:
    """``array<struct<at, m>>`` of unanimous windows, one for each of ``sizes``.

    A window that ends at a sample is unanimous if the run of equal answers up to there is as
    long as it; the vote over complete windows is the leader after the last of them.
    """

    def longer(acc: Column, x: Column) -> Column:
        same = x["answer"].isNotNull() & (acc["last"] == x["answer"])
        run = F.when(same, acc["run"] + 1).when(x["answer"].isNotNull(), 1).otherwise(0)
        return F.struct(run.alias("run"), x["answer"].alias("last"), F.concat(acc["runs"], F.array(run)).alias("runs"))

    start = F.struct(F.lit(0).alias("run"), F.get(samples, F.lit(-1))["answer"].alias("last"), F.array().cast("array<int>").alias("runs"))
    held = F.least(size, cap).cast("int")

    short, none = size < cap, F.get(samples, F.lit(-1))["answer"]

    def of(runs: Column) -> Column:
        # of too few samples no window that is longer than every run says anything, whatever its size
        cut = F.when(short, measures(samples, gold, none, size.cast("long"), "insufficient_samples"))
        return let(F.struct(F.coalesce(F.array_max(runs), F.lit(0)).alias("longest"), cut.alias("cut")), lambda known: sized(runs, known))

    def sized(runs: Column, known: Column) -> Column:
        def one(s: Column, at: Column) -> Column:
            within = s <= known["longest"]

            def told(usable: Column) -> Column:
                ends = F.when(usable > 0, F.sequence(s, F.greatest(usable, s), s)).otherwise(F.array().cast("array<int>"))
                end = F.when(within, F.get(F.filter(ends, lambda e: F.get(runs, e - 1) >= s), F.lit(0)))
                last = F.when(usable > 0, F.get(samples, usable - 1)["by_count"]["leader"])
                status = F.when(short, "insufficient_samples").when(last.isNull(), "no_valid_answer").otherwise("ok")
                stop = lambda e: F.struct(F.get(samples, e - 1)["answer"].alias("p"), e.cast("long").alias("u"), F.lit("early_stop").alias("s"))
                rest = F.struct(F.when(~short, last).alias("p"), F.when(short, size).otherwise(usable).cast("long").alias("u"), status.alias("s"))
                said = let(end, lambda e: F.when(e.isNotNull(), stop(e)).otherwise(rest))
                return let(said, lambda x: measures(samples, gold, x["p"], x["u"], x["s"]))

            return F.struct(at.cast("int").alias("at"), F.when(short & ~within, known["cut"]).otherwise(let(held - F.pmod(held, s), told)).alias("m"))

        return F.transform(F.transform(sizes, lambda s: s.cast("int")), one)

    return let(F.aggregate(samples, start, longer, lambda acc: acc["runs"]), of)
