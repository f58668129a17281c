"""Matching, coverage, duplicates and contract checks; violations come out as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_or_conflict(rows: DataFrame, key: list[str], order: str, signature: list[str]) -> tuple[DataFrame, DataFrame]:
    """(first row of each key, keys whose rows differ in the signature). Nulls are values."""
    mark = F.xxhash64(F.to_json(F.struct(*signature), {"ignoreNullFields": "false"}))
    conflicts = rows.withColumn("_m", mark).groupBy(*key).agg(F.count("*").alias("rows"), F.min("_m").alias("_a"), F.max("_m").alias("_b")).where("_a <> _b").select(*key, "rows")
    kept = rows.groupBy(*key).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in key]), order).alias("_r")).select(*key, "_r.*")
    return kept.select(*rows.columns), conflicts


def conflicting_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one value, null counted as one."""
    low, high, gaps = F.min(value), F.max(value), F.count_if(F.col(value).isNull())
    return rows.groupBy(key).agg(low.alias("low"), high.alias("high"), gaps.alias("nulls")).where("low <> high OR (low IS NOT NULL AND nulls > 0)").select(key, "low", "high", "nulls")


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: ``missing`` or ``unexpected``."""
    missing = expected.select(key).join(found.select(key), key, "left_anti").distinct().withColumn("status", F.lit("missing"))
    return missing.unionByName(found.select(key).join(expected.select(key), key, "left_anti").distinct().withColumn("status", F.lit("unexpected")))


def align(left: DataFrame, right: DataFrame, key: str, fallback: str) -> DataFrame:
    """``left`` joined to ``right`` by ``key``; by ``fallback`` only if no key is shared.

    One plan: whether any key is shared is a row of its own, sent to both ways.
    """
    shared = F.broadcast(left.select(key).join(right.select(key), key, "left_semi").agg((F.count(F.lit(1)) > 0).alias("_shared")))

    def way(on: str, wanted: bool) -> DataFrame:
        gate = shared.where(F.col("_shared") == wanted).drop("_shared")
        renamed = right.select(on, *[F.col(c).alias(f"other_{c}") for c in right.columns if c not in (key, fallback)])
        return left.crossJoin(gate).join(renamed, on).select(*left.columns, *renamed.columns[1:])

    return way(key, True).unionByName(way(fallback, False))


def align_warnings(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``status, rows``: how many keys only one side has; none if the sets are equal."""
    return coverage(left, right, key).groupBy("status").agg(F.count("*").alias("rows"))


def cascade(candidates: DataFrame, questions: DataFrame, levels: list[str], id_col: str, target: str) -> DataFrame:
    """Each candidate with the question of the first level that hits: ``target, level``.

    ``hits`` over 1 marks an ambiguous candidate, whose target is null. Questions are
    aggregated by key first, so a candidate is never multiplied.
    """
    out, match, number, name = candidates, F.lit(None).cast(dict(questions.dtypes)[target]), F.lit(0).cast("long"), F.lit(None).cast("string")
    for i, level in enumerate(levels):
        keys = questions.where(F.col(level).isNotNull()).groupBy(F.col(level)).agg(F.count("*").alias(f"_n{i}"), F.min(target).alias(f"_t{i}"))
        out = out.join(keys, level, "left")
    for i in reversed(range(len(levels))):
        hit = F.col(f"_n{i}").isNotNull()
        match = F.when(hit, F.when(F.col(f"_n{i}") == 1, F.col(f"_t{i}"))).otherwise(match)
        number, name = F.when(hit, F.col(f"_n{i}")).otherwise(number), F.when(hit, F.lit(levels[i])).otherwise(name)
    return out.select(id_col, match.alias("match"), name.alias("level"), number.alias("hits"))


def index_violations(pool: DataFrame, size: int) -> DataFrame:
    """Questions whose positions are not exactly 0 to ``size - 1``, each once."""
    per = pool.groupBy("question_id").agg(F.count("*").alias("rows"), F.count_distinct("pos").alias("kinds"), F.min("pos").alias("low"), F.max("pos").alias("high"))
    return per.where((F.col("rows") != size) | (F.col("kinds") != size) | (F.col("low") != 0) | (F.col("high") != size - 1))


def contract_violations(pool: DataFrame, views: int, per_view: int) -> DataFrame:
    """``question_id, rule, detail`` for each broken rule of the sampling contract."""
    checks: list[tuple[str, Column, Column]] = [
        ("answer_without_confidence", F.col("answer").isNotNull() & F.col("confidence").isNull(), F.col("pos").cast("string")),
        ("confidence_out_of_range", (F.col("confidence") < 0) | (F.col("confidence") > 1), F.col("confidence").cast("string")),
        ("view_out_of_range", (F.col("view") < 0) | (F.col("view") >= views), F.col("view").cast("string")),
    ]
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), detail.alias("detail"))) for rule, bad, detail in checks]))
    rows = pool.select("question_id", F.explode(broken).alias("v")).select("question_id", "v.rule", "v.detail")
    sizes = pool.groupBy("question_id", "view").agg(F.count("*").alias("n")).where(F.col("n") != per_view)
    return rows.unionByName(sizes.select("question_id", F.lit("view_size").alias("rule"), F.concat_ws("=", F.col("view").cast("string"), F.col("n").cast("string")).alias("detail")))


def leaks(split: DataFrame, key: str) -> DataFrame:
    """Keys that are in more than one split."""
    return split.groupBy(key).agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def expected_questions(manifests: DataFrame) -> DataFrame:
    """Per source: the sum over disjoint shards, the largest over modulo shards."""
    return manifests.groupBy("source").agg(F.when(F.bool_and("disjoint"), F.sum("questions")).otherwise(F.max("questions")).alias("questions"))


def pool_diagnostics(pool: DataFrame) -> DataFrame:
    """One row: questions, rows, answers, scores, and the sizes of questions."""
    per = pool.groupBy("question_id").agg(F.count("*").alias("n"), F.count("answer").alias("answered"), F.count("confidence").alias("scored"))
    return per.agg(F.count("*").alias("questions"), F.sum("n").alias("rows"), F.sum("answered").alias("answered"), F.sum("scored").alias("scored"), F.min("n").alias("smallest"), F.max("n").alias("largest"), F.count_if(F.col("n") < 32).alias("short"))


def first_reason(rows: DataFrame, reasons: list[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """How many rows each exclusion reason takes, the first that fits counting."""
    reason = F.lit(kept)
    for name, bad in reversed(reasons):
        reason = F.when(bad, F.lit(name)).otherwise(reason)
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("rows"))


def wrong_consensus(own: DataFrame, relations: DataFrame, gold: DataFrame, least: float) -> DataFrame:
    """Confident wrong answers of the identity pool and what the relation pool makes of them.

    ``status`` is ``evaluated``, ``unmatched`` (no relation answers) or ``undefined`` (none
    with a score), the other columns null then. ``drop``: support lost by the wrong answer;
    ``broken``: it is not the only top any more (ties within 1e-12); ``displaced``: it is
    below every top; ``corrected``: the top answer (of several the smallest text) is right.
    """
    from plurality.operators.support import top_answer

    wrong = top_answer(own, "ssc").join(gold, "question_id").where(F.col("answer") != F.col("gold")).where(F.col("ssc") >= least)
    tops = relations.groupBy("question_id").agg(F.max("relsc").alias("top"), F.count("*").alias("answers"))
    per = relations.join(tops, "question_id").withColumn("is_top", F.coalesce(F.abs(F.col("relsc") - F.col("top")) <= 1e-12, F.lit(False)))
    w = wrong.withColumnRenamed("answer", "wrong")
    rows = w.join(per, "question_id", "left").groupBy("question_id", "wrong", "gold", "ssc").agg(
        F.coalesce(F.max(F.when(F.col("answer") == F.col("wrong"), F.col("relsc"))), F.lit(0.0)).alias("found"),
        F.count_if("is_top").alias("tops"),
        F.max("answers").alias("answers"),
        F.coalesce(F.bool_or(F.col("is_top") & (F.col("answer") == F.col("wrong"))), F.lit(False)).alias("wrong_top"),
        F.min(F.when(F.col("is_top"), F.col("answer"))).alias("top_answer"),
    )
    status = F.when(F.col("answers").isNull(), "unmatched").when(F.col("tops") == 0, "undefined").otherwise("evaluated")
    rows = rows.withColumn("status", status)
    told = lambda value: F.when(F.col("status") == "evaluated", value)
    drop = F.col("ssc") - F.col("found")
    return rows.select(
        "question_id", "wrong", "gold", "ssc", "status", told(F.col("found")).alias("relsc"), told(drop).alias("drop"), told(F.try_divide(drop, F.col("ssc"))).alias("relative_drop"),
        told(~(F.col("wrong_top") & (F.col("tops") == 1))).alias("broken"), told(~F.col("wrong_top")).alias("displaced"), told(F.col("top_answer") == F.col("gold")).alias("corrected"),
    )


def consensus_summary(cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, means and rates of ``wrong_consensus`` cases; means and rates are of evaluated
    ones. ``relative_drop_of_means`` is the ratio of the means, not the mean of the ratios."""
    ok = F.col("status") == "evaluated"
    n = F.count_if(ok)
    mean = lambda c: F.avg(F.when(ok, F.col(c)))
    counts = {f"{c}_count": F.count_if(ok & F.col(c)) for c in ("broken", "displaced", "corrected")}
    rates = {f"{c}_rate": F.try_divide(F.count_if(ok & F.col(c)), n) for c in ("broken", "displaced", "corrected")}
    values = {
        "candidates": F.count("*"), "evaluated": n, "unmatched": F.count_if(F.col("status") == "unmatched"), "undefined": F.count_if(F.col("status") == "undefined"), "mean_ssc_all": F.avg("ssc"),
        "mean_ssc": mean("ssc"), "mean_relsc": mean("relsc"), "mean_drop": mean("drop"), "mean_relative_drop": mean("relative_drop"),
        "relative_drop_of_means": F.when(mean("ssc") > 0, (mean("ssc") - mean("relsc")) / mean("ssc")), **counts, **rates,
    }
    return cases.groupBy(*(by or [])).agg(*(v.alias(name) for name, v in values.items()))
