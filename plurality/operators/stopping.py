"""Early-stopping rules over ordered samples, for a whole grid of parameters at once.

Running votes only grow, so the leader after each row is a running maximum of
``(votes, earlier first position, answer)``, and all windows share one partitioning by
question. A threshold stops at the first row whose share reaches it: the row that lifts the
running maximum of shares over it. Each row therefore knows the thresholds it stops, and no
question is multiplied by the grid. What a question adds where it does not stop is the same
for every threshold; curves add it for all questions and change it for those stopped. Rules
give one row a question, so windows and votes are found once for stops and fall-backs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _question():
    return Window.partitionBy("question_id")


def _so_far():
    return _question().orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before():
    return _question().orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)


def capped(pool: DataFrame, cap: int) -> DataFrame:
    return pool.withColumn("size", F.count("*").over(_question())).where(F.col("pos") < cap)


def running_votes(pool: DataFrame, cap: int, weight: Column, *more: str) -> DataFrame:
    """Rows with ``valid`` votes so far, the ``leader`` and its ``share`` of the weights, and
    ``more`` columns of the pool.

    Rows without answer, or with a null or negative weight, do not vote. A zero total has
    share 0.
    """
    rows = capped(pool, cap).withColumn("w", F.when(F.col("answer").isNotNull() & (weight >= 0), weight))
    own = Window.partitionBy("question_id", F.when(F.col("w").isNotNull(), F.col("answer"))).orderBy("pos")
    rows = rows.withColumn("mass", F.when(F.col("w").isNotNull(), F.sum("w").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    rows = rows.withColumn("first", F.min("pos").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    lead = F.when(F.col("w").isNotNull(), F.struct("mass", -F.col("first"), "answer"))
    rows = rows.withColumn("lead", F.max(lead).over(_so_far())).withColumn("valid", F.count("w").over(_so_far())).withColumn("total", F.sum("w").over(_so_far()))
    part = F.when(F.col("total") > 0, F.col("lead.mass").cast("double") / F.col("total").cast("double")).otherwise(0.0)
    return rows.select("question_id", "pos", "size", "valid", F.col("lead.answer").alias("leader"), part.alias("share"), *more)


def _thresholds(grid: list[float]) -> Column:
    return F.array(*[F.lit(float(t)) for t in sorted(set(grid))])


def _lifts(rows: DataFrame, value: Column, grid: list[float], prediction: str) -> DataFrame:
    """Rows with ``lift``: what is said at a row that is first to reach thresholds, and these;
    null at other rows."""
    before = F.coalesce(F.max("_v").over(_before()), F.lit(float("-inf")))
    lifted = rows.withColumn("_v", value).withColumn("_b", before)
    reached = F.filter(_thresholds(grid), lambda t: (t > F.col("_b")) & (t <= F.col("_v")))
    lift = F.when(F.col("_v") > F.col("_b"), F.struct(F.col(prediction).alias("prediction"), (F.col("pos") + 1).cast("long").alias("used"), reached.alias("reached")))
    return lifted.withColumn("lift", lift)


def _stops(lifts: Column) -> Column:
    """``array<struct<parameter, prediction, used>>`` of a question's lifts."""
    return F.flatten(F.transform(lifts, lambda x: F.transform(x["reached"], lambda t: F.struct(t.alias("parameter"), x["prediction"].alias("prediction"), x["used"].alias("used")))))


def _decided(per: DataFrame, cap: int, last: Column, full: Column, stops: Column) -> DataFrame:
    """One row a question: its stops, and where no rule stops, what is said and used."""
    short = F.col("size") < cap
    status = F.when(short, "insufficient_samples").when(last.isNull(), "no_valid_answer").otherwise("ok")
    return per.select("question_id", stops.alias("stops"), F.when(~short, last).alias("prediction"), F.when(short, F.col("size")).otherwise(full).cast("long").alias("used"), status.alias("status"))


def _tallied(rows: DataFrame, item: Column) -> DataFrame:
    """Per question its size, the answer of the largest sum of ``s`` (first seen of several),
    and all its ``item`` values; answers are summed first, all within one partitioning."""
    sums = rows.groupBy("question_id", "answer").agg(F.max("size").alias("size"), F.sum("s").alias("w"), F.min(F.when(F.col("s").isNotNull(), F.col("pos"))).alias("first"), F.collect_list(item).alias("items"))
    best = F.max(F.when(F.col("w").isNotNull() & F.col("answer").isNotNull(), F.struct("w", -F.col("first"), "answer")))["answer"]
    return sums.groupBy("question_id").agg(F.max("size").alias("size"), best.alias("last"), F.flatten(F.collect_list("items")).alias("items"))


def adaptive(pool: DataFrame, cap: int, grid: list[float], weight: Column, min_valid: int = 2) -> DataFrame:
    """Stops once ``valid >= min_valid`` and the leader's share reaches the parameter.

    As all rules do, returns ``question_id, stops, prediction, used, status``: an array of
    the parameters that stop the question with what is said then, and the fall-back.
    """
    rows = running_votes(pool, cap, weight)
    rows = _lifts(rows, F.when(F.col("valid") >= min_valid, F.col("share")), grid, "leader")
    per = rows.groupBy("question_id").agg(F.max("size").alias("size"), F.max_by("leader", "pos").alias("last"), F.collect_list("lift").alias("lifts"))
    return _decided(per, cap, F.col("last"), F.lit(cap), _stops(F.col("lifts")))


def confident(pool: DataFrame, cap: int, grid: list[float], score: Column) -> DataFrame:
    """Stops at the first answered row whose score reaches the parameter, else votes."""
    rows = capped(pool, cap).withColumn("s", F.when(F.col("answer").isNotNull(), score))
    rows = _lifts(rows, F.col("s").cast("double"), grid, "answer")
    return _decided(_tallied(rows, F.col("lift")), cap, F.col("last"), F.lit(cap), _stops(F.col("items")))


def window_outcomes(pool: DataFrame, cap: int, sizes: list[int]) -> DataFrame:
    """``question_id, parameter, early, prediction, used, status`` and the same for where no
    window stops (``rest_*``), a row for each window size.

    A window that ends at a row is unanimous if the run of equal answers up to there is as
    long as it; the vote over complete windows is the leader after the last of them. So runs
    and leaders are found once, and sizes are looked up in a question's own arrays.
    """
    sizes = sorted({min(max(2, s), cap) for s in sizes})
    rows = running_votes(pool, cap, F.lit(1), "answer")
    item = F.struct("pos", "answer", "leader")
    per = rows.groupBy("question_id").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items"))  # at most ``cap`` of them

    def longer(acc: Column, x: Column) -> Column:
        same = x["answer"].isNotNull() & (acc["last"] == x["answer"])
        run = F.when(same, acc["run"] + 1).when(x["answer"].isNotNull(), 1).otherwise(0)
        return F.struct(run.alias("run"), x["answer"].alias("last"), F.concat(acc["runs"], F.array(run)).alias("runs"))

    kind = dict(rows.dtypes)["answer"]
    start = F.struct(F.lit(0).alias("run"), F.lit(None).cast(kind).alias("last"), F.array().cast("array<int>").alias("runs"))
    counted = per.withColumn("runs", F.aggregate("items", start, longer, lambda acc: acc["runs"]))
    rowed = counted.select("question_id", "size", "items", "runs", F.explode(F.array(*map(F.lit, sizes))).alias("s"))
    n = F.least("size", F.lit(cap)).cast("int")
    usable = (n - F.pmod(n, F.col("s"))).cast("int")
    ends = F.when(usable > 0, F.sequence(F.col("s"), F.greatest(usable, F.col("s")), F.col("s"))).otherwise(F.array().cast("array<int>"))
    end = F.get(F.filter(ends, lambda e: F.get(F.col("runs"), e - 1) >= F.col("s")), F.lit(0))
    short = F.col("size") < cap
    last = F.when(usable > 0, F.get("items", usable - 1)["leader"])
    rest = F.when(~short, last), F.when(short, F.col("size")).otherwise(usable).cast("long"), F.when(short, "insufficient_samples").when(last.isNull(), "no_valid_answer").otherwise("ok")
    early = end.isNotNull()
    stop = F.get("items", end - 1)["answer"], end.cast("long"), F.lit("early_stop")
    names = ("prediction", "used", "status")
    return rowed.select(
        "question_id", F.col("s").cast("double").alias("parameter"), early.alias("early"), *(F.when(early, a).otherwise(b).alias(c) for a, b, c in zip(stop, rest, names, strict=True)), *(b.alias(f"rest_{c}") for b, c in zip(rest, names, strict=True))
    )


def unanimous_windows(pool: DataFrame, cap: int, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Stops after a complete window of equal answers; else votes over complete windows.

    ``parameter`` is the window size. The fall-back frame has one row for each size.
    """
    rows = window_outcomes(pool, cap, sizes)
    return rows.where("early").select("question_id", "parameter", "prediction", "used"), rows.select("question_id", "parameter", *(F.col(f"rest_{c}").alias(c) for c in ("prediction", "used", "status")))


def window_curve(pool: DataFrame, cap: int, sizes: list[int], expected: DataFrame) -> DataFrame:
    """The curve of ``unanimous_windows``, summed from one row a question and size."""
    rows = window_outcomes(pool, cap, sizes).join(expected, "question_id")
    right = F.coalesce(F.col("prediction") == F.col("gold"), F.lit(False))
    sums = rows.groupBy("parameter").agg(F.count_if(right).alias("correct"), F.sum("used").alias("used"), F.count_if("early").alias("early"))
    return sums.crossJoin(F.broadcast(expected.agg(F.count("*").alias("questions")))).select("parameter", "questions", "correct", "used", "early")


def window_size(value: float, cap: int) -> int:
    """A window size from a control value: rounded half to even, at most ``cap``; a value
    under 2 is a fraction of ``cap``, of at least 2 rows."""
    size = round(value)
    return min(cap, size if size >= 2 else max(2, round(value * cap)))


def buffered(pool: DataFrame, cap: int, grid: list[float], score: Column, capacity: int = 5) -> DataFrame:
    """Stops when ``capacity`` answered rows reach the parameter, with their weighted vote;
    else the weighted vote of the whole prefix.

    Thresholds between two neighbouring scores of a question fill the same buffer, so buffers
    are formed once for each different score of the question, inside its own row.
    """
    rows = capped(pool, cap).withColumn("s", F.when(F.col("answer").isNotNull(), score))
    kind = dict(rows.dtypes)["s"]
    total = f"decimal(38,{kind.rstrip(')').split(',')[1]})" if kind.startswith("decimal") else "double"
    item = F.when(F.col("s").isNotNull(), F.struct("pos", "answer", "s", F.col("s").cast("double").alias("d")))
    per = _tallied(rows, item).withColumn("items", F.array_sort("items"))  # at most ``cap`` of them
    per = per.withColumn("levels", F.array_sort(F.array_distinct(F.transform("items", lambda x: x["d"]))))

    def winner(kept: Column) -> Column:
        mass = lambda x: F.aggregate(F.filter(kept, lambda y: y["answer"] == x["answer"]), F.lit(0).cast(total), lambda acc, y: (acc + y["s"]).cast(total))
        return F.array_max(F.transform(kept, lambda x: F.struct(mass(x).alias("w"), (-x["pos"]).alias("f"), x["answer"].alias("answer"))))["answer"]

    def case(high: Column, at: Column) -> Column:
        low = F.when(at > 0, F.get("levels", at - 1)).otherwise(F.lit(float("-inf")))
        kept = F.slice(F.filter("items", lambda x: x["d"] >= high), 1, capacity)
        return F.struct(kept.alias("kept"), F.filter(_thresholds(grid), lambda t: (t > low) & (t <= high)).alias("reached"))

    cases = F.filter(F.transform("levels", case), lambda c: (F.size(c["kept"]) == capacity) & (F.size(c["reached"]) > 0))
    lifts = F.transform("cases", lambda c: F.struct(winner(c["kept"]).alias("prediction"), (F.element_at(c["kept"], -1)["pos"] + 1).cast("long").alias("used"), c["reached"].alias("reached")))
    per = per.withColumn("cases", cases).withColumn("lifts", lifts)
    return _decided(per, cap, F.col("last"), F.lit(cap), _stops(F.col("lifts")))


def outcomes(decisions: DataFrame, grid: list[float]) -> DataFrame:
    """One row for each question and parameter (for reading single predictions)."""
    rows = decisions.withColumn("parameter", F.explode(_thresholds(grid)))
    rows = rows.withColumn("e", F.get(F.filter("stops", lambda x: x["parameter"] == F.col("parameter")), F.lit(0)))
    early = F.col("e").isNotNull()
    return rows.select("question_id", "parameter", F.when(early, F.col("e.prediction")).otherwise(F.col("prediction")).alias("prediction"), F.when(early, F.col("e.used")).otherwise(F.col("used")).alias("used"), F.when(early, "early_stop").otherwise(F.col("status")).alias("status"))


def curve_sums(rows: DataFrame, base: Column, changed: Callable[[Column, Column], Column], measures: list[str]) -> DataFrame:
    """Sums of measures per parameter, from one row a question.

    ``base`` is a struct of the measures where no rule stops, ``changed(stop, base)`` of what
    a stop alters. Parameter null has the sums of all bases, the others what to add to them.
    """
    first = F.struct(F.lit(None).cast("double").alias("parameter"), *(F.col("_base")[m].cast("long").alias(m) for m in measures))
    delta = lambda x: F.struct(x["parameter"].alias("parameter"), *(changed(x, F.col("_base"))[m].cast("long").alias(m) for m in measures))
    stops = F.coalesce("stops", F.array().cast(rows.schema["stops"].dataType))
    every = rows.withColumn("_base", base).withColumn("_stops", stops).select(F.explode(F.concat(F.array(first), F.transform("_stops", delta))).alias("c")).select("c.*")
    return every.groupBy("parameter").agg(F.count("*").alias("rows"), *(F.sum(m).alias(m) for m in measures))


def over_grid(sums: DataFrame, grid: list[float], measures: list[str]) -> DataFrame:
    """``parameter, all_rows, rows, measures`` for each parameter: the base and its changes."""
    wanted = sums.sparkSession.createDataFrame([(float(p),) for p in sorted(set(grid))], "parameter double")
    names = ["rows", *measures]
    zeros = wanted.select("parameter", *(F.lit(0).cast("long").alias(c) for c in names), F.lit(True).alias("_in"))
    both = sums.withColumn("_in", F.lit(False)).unionByName(zeros).groupBy("parameter").agg(*(F.sum(c).alias(c) for c in names), F.max("_in").alias("_in"))
    base = lambda c: F.max(F.when(F.col("parameter").isNull(), F.col(c))).over(Window.partitionBy(F.lit(1)))  # noqa: E731  (one row a parameter)
    frame = both.select("*", *(base(c).alias(f"_{c}") for c in names)).where("_in AND _rows IS NOT NULL")
    return frame.select("parameter", F.col("_rows").alias("all_rows"), "rows", *((F.col(f"_{m}") + F.col(m)).alias(m) for m in measures))


def curve(decisions: DataFrame, expected: DataFrame, grid: list[float]) -> DataFrame:
    """Per parameter: ``correct``, ``used``, ``early`` over all expected questions.

    A question that is missing from the pool is wrong and uses nothing.
    """
    rows = expected.join(decisions, "question_id", "left")
    right = lambda p: F.coalesce(p == F.col("gold"), F.lit(False)).cast("long")
    base = F.struct(right(F.col("prediction")).alias("correct"), F.coalesce("used", F.lit(0)).alias("used"))
    changed = lambda stop, b: {"correct": right(stop["prediction"]) - b["correct"], "used": stop["used"] - b["used"]}
    out = over_grid(curve_sums(rows, base, changed, ["correct", "used"]), grid, ["correct", "used"])
    return out.select("parameter", F.col("all_rows").alias("questions"), "correct", "used", F.col("rows").alias("early"))
