"""Option permutations, renderings of a question, and expansion to samples."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plurality.functions.hashing import stable_id

#: Orders of up to this many options are listed; of more they are counted out one by one.
LISTED_OPTIONS = 5
#: Options whose orders can be numbered in 64 bits.
MOST_OPTIONS = 20


def permutation_table(spark: SparkSession) -> DataFrame:
    """All orders of 1 to 5 options: ``n, perm_id, sources`` (0-based original positions).

    The identity has ``perm_id`` 0. 153 rows, so it may be sent to every executor.
    """
    rows = [(n, i, list(p)) for n in range(1, LISTED_OPTIONS + 1) for i, p in enumerate(permutations(range(n)))]
    return spark.createDataFrame(rows, "n int, perm_id int, sources array<int>")


def factorial(n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(1).cast("long"), lambda acc, i: acc * i)


def _quotient(a: Column, b: Column) -> Column:
    """Whole quotient of non-negative numbers; exact, as the difference divides evenly."""
    return F.call_function("div", a, b).cast("int")


def numbered_order(n: Column, number: Column) -> Column:
    """The order of ``n`` positions with a number from 0 (the identity) to ``n! - 1``."""
    start = F.struct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("int")).alias("rest"), F.array().cast("array<int>").alias("out"), number.cast("long").alias("number"))

    def step(s: Column, left: Column) -> Column:
        block = factorial(left - 1)
        taken = F.get(s["rest"], _quotient(s["number"], block))
        return F.struct(F.filter(s["rest"], lambda x: x != taken).alias("rest"), F.concat(s["out"], F.array(taken)).alias("out"), F.pmod(s["number"], block).alias("number"))

    return F.aggregate(F.reverse(F.sequence(F.lit(1), n)), start, step, lambda s: s["out"])


def labels(n: Column) -> Column:
    return F.transform(F.sequence(F.lit(65), F.lit(64) + n), lambda c: F.char(c))


def forward_map(sources: Column) -> Column:
    """Original label to the label at which it is shown."""
    names = labels(F.size(sources))
    return F.map_from_arrays(F.transform(sources, lambda s: F.get(names, s)), names)


def inverse_map(sources: Column) -> Column:
    """Shown label to original label."""
    names = labels(F.size(sources))
    return F.map_from_arrays(names, F.transform(sources, lambda s: F.get(names, s)))


def permuted(options: Column, sources: Column) -> Column:
    return F.transform(sources, lambda s: F.get(options, s))


def rendered(question: Column, options: Column) -> Column:
    lines = F.zip_with(labels(F.size(options)), options, lambda label, text: F.concat(F.lit("("), label, F.lit(") "), text))
    return F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))


def option_views(questions: DataFrame, views: int, seed: int, key: str = "question_id", options: str = "options", strict: bool = False) -> DataFrame:
    """Each question once per view: identity first, then distinct orders by hash.

    Orders of up to ``LISTED_OPTIONS`` options are ranked by hash. Of more, order numbers are
    stepped through from a hashed start by a hashed stride below ``n``, which has no divisor
    in common with ``n! - 1``, so none comes twice. ``views`` above ``n!`` yield all orders
    there are, and with ``strict`` are an error; ``budget_violations`` reports such cases. A
    question without options (or null ones) has its identity view with no source; more than
    ``MOST_OPTIONS`` options are an error.
    """
    n = F.coalesce(F.size(options), F.lit(0))
    sized = questions.withColumn("_n", F.when(n > 0, n).otherwise(0))
    if strict:
        enough = F.when(F.col("_n") > MOST_OPTIONS, F.lit(True)).otherwise(factorial(F.col("_n")) >= views)
        sized = sized.withColumn("_n", F.when(enough, F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("fewer orders than views in question "), F.col(key).cast("string")))))
    table = F.broadcast(permutation_table(questions.sparkSession))
    fitted = sized.join(table, F.col("_n") == F.col("n")).withColumn("_h", stable_id(F.lit(seed), F.col(key), F.array_join("sources", ","), length=32))
    order = Window.partitionBy(key).orderBy((F.col("perm_id") != 0), "_h", "perm_id")
    few = fitted.withColumn("view_index", (F.row_number().over(order) - 1).cast("long")).where(F.col("view_index") < views)
    columns = [*questions.columns, "perm_id", "sources", "view_index"]
    count = F.when(F.col("_n") > MOST_OPTIONS, F.raise_error(F.lit("too many options"))).otherwise(factorial(F.col("_n")))
    stepped = (
        sized.where((F.col("_n") > LISTED_OPTIONS) | (F.col("_n") == 0))
        .withColumn("_c", count)
        .withColumn("view_index", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(views).cast("long"), F.col("_c")) - 1)))
        .withColumn("_m", F.col("_c") - 1)
    )
    hashed = lambda name, top: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col(key).cast("string")), top)
    stride = 1 + hashed("stride", F.greatest(F.col("_n"), F.lit(1)).cast("long"))
    # products stay small: the place is below the views asked for, the stride at most n
    number = F.when(F.col("view_index") == 0, F.lit(0).cast("long")).otherwise(1 + F.pmod(F.pmod(hashed("start", F.greatest(F.col("_m"), F.lit(1))), F.greatest(F.col("_m"), F.lit(1))) + (F.col("view_index") - 1) * stride, F.greatest(F.col("_m"), F.lit(1))))
    sources = F.when(F.col("_n") == 0, F.array().cast("array<int>")).otherwise(numbered_order(F.greatest(F.col("_n"), F.lit(1)), number))
    many = stepped.withColumn("sources", sources).withColumn("perm_id", F.lit(None).cast("int")).withColumn("perm_id", F.when(F.col("view_index") == 0, 0))
    return few.select(*columns).unionByName(many.select(*columns))


def sampling_profile(answer_type: Column, n_options: Column) -> Column:
    """``struct<views, per_view>``: 4 x 8, two options 2 x 16, numbers 1 x 32."""
    number = F.lower(answer_type).contains("number") | F.lower(answer_type).contains("numeric")
    views = F.when(number, 1).when(n_options == 2, 2).otherwise(4)
    return F.struct(views.alias("views"), F.when(number, 32).when(n_options == 2, 16).otherwise(8).alias("per_view"))


def view_metadata(sources: Column) -> Column:
    """``struct<labels, forward, inverse, sources>`` that a view's samples carry."""
    return F.struct(labels(F.size(sources)).alias("labels"), forward_map(sources).alias("forward"), inverse_map(sources).alias("inverse"), sources.alias("sources"))


def direction_violations(views: DataFrame, sources: str = "sources", forward: str = "forward", inverse: str = "inverse") -> DataFrame:
    """Views whose sources are no order, or whose stored maps are not theirs in both directions.

    Maps are compared as sorted pairs; what is null is not checked.
    """
    n = F.size(sources)
    order = F.array_sort(sources) == F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i.cast("int"))
    pairs = lambda m: F.array_sort(F.map_entries(m))
    same = lambda column, wanted: F.coalesce(pairs(F.col(column)) == pairs(wanted), F.col(column).isNull())
    rule = F.when(~F.coalesce(order, F.lit(False)), "not_an_order").when(~same(forward, forward_map(F.col(sources))), "wrong_forward").when(~same(inverse, inverse_map(F.col(sources))), "wrong_inverse")
    return views.withColumn("rule", rule).where("rule IS NOT NULL")


def identity_views(questions: DataFrame, per_view: int = 32) -> DataFrame:
    """A number's only view: relation ``g0``, no options, the whole budget in it."""
    fixed = {"view_index": F.lit(0).cast("long"), "relation_id": F.lit("g0"), "relation_type": F.lit("identity"), "per_view": F.lit(per_view).cast("long"), "sources": F.array().cast("array<int>")}
    return questions.withColumns(fixed)


def rolled_up(samples: DataFrame, key: str = "question_id", order: list[str] | None = None) -> DataFrame:
    """Questions with their samples in one array, in order, and how many are valid.

    A question's samples are its sampling budget, tens of rows.
    """
    order = order or ["view_index", "sample_index"]
    rest = [c for c in samples.columns if c != key]
    item = F.struct(*order, F.struct(*rest).alias("row"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"])
    return samples.groupBy(key).agg(listed.alias("samples"), F.count("*").alias("attempted_budget"), F.count_if("is_valid_answer").alias("valid_responses"))


def budget_violations(questions: DataFrame, views: str, per_view: str, total: int = 32) -> DataFrame:
    return questions.where((F.col(views) * F.col(per_view) != total) | (F.col(views) < 1))


def expand_samples(views: DataFrame, per_view: Column) -> DataFrame:
    """One row for each sample to draw of each view."""
    return views.withColumn("sample_index", F.explode(F.sequence(F.lit(0), per_view - 1)))
