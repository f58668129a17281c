"""Reports of many models and data sets, made anew from their stored pools.

Pools lie in one table partitioned by model and data set, and so do their reports. What has no
report yet is evaluated in one pass over its partitions only, so a run that was stopped, or a
model that came later, costs no more than what is missing.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.operators import evaluation
from plurality.sources import artifacts

PARTS = ["model", "dataset_name"]


def pending(pools: DataFrame, done: DataFrame | None, parts: list[str] | None = None) -> list[dict[str, str]]:
    """Partitions of ``pools`` that ``done`` does not have, in order (one for each model and
    data set). Only partition columns are read."""
    parts = parts or PARTS
    found = pools.select(*parts).distinct()
    if done is not None:
        found = found.join(done.select(*parts).distinct(), parts, "left_anti")
    return [r.asDict() for r in found.orderBy(*parts).collect()]


def of_parts(wanted: list[dict[str, str]]) -> Column:
    """A condition on partition columns alone, so that other partitions are not listed."""
    one = lambda part: functools.reduce(lambda a, b: a & b, (F.col(k) == v for k, v in part.items()))
    return functools.reduce(lambda a, b: a | b, map(one, wanted), F.lit(False))


def reports(pools: DataFrame, expected: DataFrame, settings: evaluation.Settings | None = None, phase: str = "analysis", parts: list[str] | None = None, **more) -> DataFrame:
    """Report rows of every model and data set; ``expected`` has a data set's questions, which
    are those of each of its models (or of one, if it names the model too)."""
    parts = parts or PARTS
    missing = [c for c in parts if c not in expected.columns]
    if missing:
        shared = [c for c in parts if c in expected.columns]
        models = pools.select(*parts).distinct()
        expected = models.join(expected, shared) if shared else models.crossJoin(expected)
    return evaluation.evaluate(pools, expected, settings, phase, by=parts, **more)


def reaggregate(spark: SparkSession, pools: str, expected: DataFrame, out: str, settings: evaluation.Settings | None = None, parts: list[str] | None = None) -> list[dict[str, str]]:
    """Adds the missing reports to the table ``out``; returns the partitions done now.

    Rows are appended by the writer's own commit, so a failed run adds none, and is done
    again by the next.
    """
    parts = parts or PARTS
    every = spark.read.parquet(pools)
    done = spark.read.parquet(out) if artifacts.exists(spark, out) else None
    wanted = pending(every, done, parts)
    if wanted:
        rows = reports(every.where(of_parts(wanted)), expected, settings, parts=parts)
        rows.write.partitionBy(*parts).mode("append").parquet(out)
    return wanted
