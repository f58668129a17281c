"""Response pools from star-schema tables: one question has many ordered answers.

``pool``: a part is a question, its order lines are the samples. ``events_pool``: a user is
a question, events are the samples. ``gold``: the right answer of each part. Weights are
decimals, so sums do not depend on the order of rows. ``SQL`` has the same views for a SQL
engine. Pools are dealt by question to tasks of ``ROWS_A_TASK`` rows or so, so that a task's
sorts and sums do not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CODES = ["AF", "AO", "NF", "NO", "RF", "RO"]
#: Rows of a pool that one task takes; a question's rows stay together.
ROWS_A_TASK = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(rows: DataFrame) -> int:
    """As many tasks as the number of rows asks for, and no fewer than run at once. Rows should
    be a plain read, whose files tell how many they are."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS_A_TASK))


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(tasks(rows), *keys)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each question; one shuffle by question, which later windows reuse."""
    order = Window.partitionBy("question_id").orderBy("l_orderkey", "l_suppkey", "l_linenumber", "l_shipdate")
    view = F.pmod(F.col("l_linenumber") - 1, F.lit(4)).cast("long")
    return dealt(read(spark, sf_dir, "lineitem").withColumn("question_id", F.col("l_partkey")), "question_id").select(
        "question_id",
        (F.row_number().over(order) - 1).cast("long").alias("pos"),
        F.when(F.col("l_tax") != 0.08, F.concat("l_returnflag", "l_linestatus")).alias("answer"),
        F.when(F.col("l_tax") != 0.07, F.round(F.col("l_discount") * 10, 6).cast("decimal(8,6)")).alias("confidence"),
        view.alias("view"),
        (F.lit(1) - view / 10).cast("decimal(8,6)").alias("relation_weight"),
        (F.lit(1) / (1 + F.col("l_quantity") % 2)).cast("decimal(8,6)").alias("dependency_weight"),
        (F.col("l_suppkey") % 7 == 0).alias("duplicate_view"),
        F.round(F.col("l_tax") * 5, 6).cast("decimal(8,6)").alias("fragility"),
        (F.col("l_partkey") % 3).alias("dataset_id"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.array(*map(F.lit, CODES))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("question_id"), F.get(codes, (F.col("p_size") + F.col("p_partkey")) % 6).alias("gold"))


def events_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy("ts", "event_id")
    return dealt(read(spark, sf_dir, "events").withColumn("question_id", F.col("user_id")), "question_id").select(
        "question_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), F.col("event_type").alias("answer"), F.least(F.lit(1.0), F.round(F.col("value") / 500, 6)).cast("decimal(8,6)").alias("confidence")
    )


SQL = """
pool AS (
  SELECT l_partkey AS question_id,
    row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey, l_linenumber, l_shipdate) - 1 AS pos,
    CASE WHEN l_tax <> 0.08 THEN l_returnflag || l_linestatus END AS answer,
    CASE WHEN l_tax <> 0.07 THEN CAST(round(l_discount * 10, 6) AS DECIMAL(8,6)) END AS confidence,
    CAST((l_linenumber - 1) % 4 AS BIGINT) AS "view",
    CAST(1 - ((l_linenumber - 1) % 4) / 10 AS DECIMAL(8,6)) AS relation_weight,
    CAST(1 / (1 + l_quantity % 2) AS DECIMAL(8,6)) AS dependency_weight,
    l_suppkey % 7 = 0 AS duplicate_view,
    CAST(round(l_tax * 5, 6) AS DECIMAL(8,6)) AS fragility,
    l_partkey % 3 AS dataset_id
  FROM lineitem
), gold AS (
  SELECT p_partkey AS question_id, ['AF', 'AO', 'NF', 'NO', 'RF', 'RO'][(p_size + p_partkey) % 6 + 1] AS gold FROM part
), events_pool AS (
  SELECT user_id AS question_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    event_type AS answer, CAST(least(1.0, round(value / 500, 6)) AS DECIMAL(8,6)) AS confidence
  FROM events
)"""
