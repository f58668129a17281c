"""Votes of first samples stand beside the samples, and are as if taken anew."""

from pyspark.sql import functions as F

from plurality.operators import folds, profiles


def test_states_are_votes_of_prefixes(spark):
    rows = [(q, i, [None, "A", "B", "<INVALID>"][(i * 7 + q * 3 + i // 3) % 4], None if (i + q) % 5 == 0 else ((i * 3 + q) % 4 - (1 if q == 9 else 0)) / 4) for q in range(10) for i in range(1, 12) if (q + i) % 6]
    pool = spark.createDataFrame(rows, "question_id long, pos long, answer string, confidence double").withColumn("confidence", F.col("confidence").cast("decimal(8,6)"))
    gold = spark.createDataFrame([(q, "AB"[q % 2]) for q in range(10)], "question_id long, gold string")
    found, kind = profiles._question_rows(pool.withColumn("subtype", F.lit("identity")), pool, gold)
    vote = lambda e: profiles._judged(folds.vote(e, lambda x: x["confidence"], kind), F.col("gold"))
    anew = lambda name, e: vote(profiles._kept(e) if name == "paper" else e)
    sized = found.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("e", F.filter("base", lambda x: x["pos"] < F.col("k")))
    pairs = [c for n in ("weight", "paper") for c in (profiles._said(F.col("e"), n, F.col("gold"), kind).alias(n), anew(n, F.col("e")).alias(f"{n}_anew"))]
    got = sized.select("question_id", "k", "falls", *pairs).collect()
    assert len(got) == 130 and {r.question_id for r in got if r.falls} == {9}
    assert all(r.weight == r.weight_anew and r.paper == r.paper_anew for r in got)
