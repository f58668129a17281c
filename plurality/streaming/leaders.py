"""An extension beyond batch parity: running votes over arriving samples.

Samples of a question arrive in any order within the watermark; counts per window and
answer are kept by Spark's own state store, and a batch query reads the leader from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(samples: DataFrame, time: str = "ts", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """``question_id, start, answer, votes, first_seen`` for tumbling windows of a stream.

    Works on a batch frame too. Rows without answer do not vote; rows later than the
    watermark are dropped by the stream, as watermarks do.
    """
    rows = samples.where("answer IS NOT NULL").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = rows.groupBy("question_id", F.window(time, window).alias("w"), "answer").agg(F.count("*").alias("votes"), F.min(time).alias("first_seen"))
    return grouped.select("question_id", F.col("w.start").alias("start"), "answer", "votes", "first_seen")


def leaders(votes: DataFrame) -> DataFrame:
    """The first-seen leader of each question and window of a batch of ``windowed_votes``."""
    best = F.max(F.struct("votes", (-F.unix_micros(F.col("first_seen").cast("timestamp"))).alias("age"), "answer")).alias("b")
    return votes.groupBy("question_id", "start").agg(best, F.sum("votes").alias("total")).select("question_id", "start", F.col("b.answer").alias("leader"), (F.col("b.votes") / F.col("total")).alias("share"))
