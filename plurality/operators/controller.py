"""Strategy clusters and the controller that replays a question's samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plurality.functions.arrays import let


def strategy_clusters(rows: DataFrame, tokens: Column, threshold: float = 0.86, explicit: Column | None = None) -> DataFrame:
    """Rows with ``cluster``: greedy leaders in order of ``pos`` within a question.

    A row joins the earlier leader with the same answer and the largest Jaccard similarity
    of tokens, at least ``threshold`` (the first of several); else it leads a new cluster
    ``B0000``, ``B0001``... An explicit id is taken as it is, and its first row leads too.
    Rows without answer have no cluster. A question's rows are folded in one array: its
    size is the sampling budget, tens of rows.
    """
    own = F.lit(None).cast("string") if explicit is None else explicit.cast("string")
    item = F.struct("pos", F.col("answer").cast("string").alias("answer"), tokens.alias("tokens"), own.alias("own"))
    lists = rows.where("answer IS NOT NULL").groupBy("question_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    leader = "array<struct<id:string,answer:string,tokens:array<string>>>"
    start = F.struct(F.array().cast(leader).alias("leaders"), F.array().cast("array<struct<pos:bigint,cluster:string>>").alias("out"), F.lit(0).alias("made"))

    def similarity(a: Column, b: Column) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)

    def step(s: Column, x: Column) -> Column:
        scored = F.transform(F.filter(s["leaders"], lambda r: r["answer"] == x["answer"]), lambda r: F.struct(similarity(r["tokens"], x["tokens"]).alias("v"), r["id"].alias("id")))
        top = F.array_max(F.transform(scored, lambda r: r["v"]))
        joined = F.when(top >= threshold, F.get(F.filter(scored, lambda r: r["v"] == top), F.lit(0))["id"])
        fresh = F.concat(F.lit("B"), F.lpad(s["made"].cast("string"), 4, "0"))
        cluster = F.coalesce(x["own"], joined, fresh)
        leads = F.when(x["own"].isNotNull(), ~F.exists(s["leaders"], lambda r: r["id"] == x["own"])).otherwise(joined.isNull())
        entry = F.array(F.struct(cluster.alias("id"), x["answer"].alias("answer"), x["tokens"].alias("tokens")))
        return F.struct(
            F.when(leads, F.concat(s["leaders"], entry)).otherwise(s["leaders"]).cast(leader).alias("leaders"),
            F.concat(s["out"], F.array(F.struct(x["pos"].cast("bigint").alias("pos"), cluster.alias("cluster")))).alias("out"),
            (s["made"] + F.when(x["own"].isNull() & joined.isNull(), 1).otherwise(0)).alias("made"),
        )

    found = lists.select("question_id", F.explode(F.aggregate("items", start, step, lambda s: s["out"])).alias("o")).select("question_id", "o.*")
    return rows.join(found, ["question_id", "pos"], "left")


STATES = "array<struct<prefix:bigint,leader:string,ratio:double,fragility:double,valid:bigint>>"


def _folded(rows: DataFrame, cap: int, beta: float, cluster: str) -> DataFrame:
    """``question_id, size, states``: what is known after each prefix, in one row a question.

    The fold keeps the sizes of clusters, the sums of each cluster's answers, and the votes of
    each answer. A sample changes its own cluster's weight, so only that cluster's answers
    are touched: as many as it has, whatever the length of the prefix.
    """
    ok = F.col("answer").isNotNull() & F.col("confidence").isNotNull() & F.col("fragility").isNotNull()
    item = F.struct(F.col("pos").cast("long").alias("pos"), ok.alias("ok"), F.col(cluster).cast("string").alias("g"), F.col("answer").cast("string").alias("answer"), F.col("confidence").cast("double").alias("c"), (F.col("confidence").cast("double") * F.col("fragility").cast("double")).alias("cf"))
    lists = rows.withColumn("_size", F.count("*").over(Window.partitionBy("question_id"))).where(F.col("pos") < cap).groupBy("question_id").agg(F.max("_size").alias("size"), F.array_sort(F.collect_list(item)).alias("items"))
    kinds = {"clusters": "array<struct<g:string,n:bigint>>", "cells": "array<struct<g:string,answer:string,c:double,cf:double>>", "votes": "array<struct<answer:string,first:bigint,dc:double,dcf:double>>", "valid": "bigint", "out": STATES}

    def state(**values: Column) -> Column:
        return F.struct(*(values[k].cast(kind).alias(k) for k, kind in kinds.items()))

    def added(s: Column, x: Column) -> Column:
        here = lambda y: y["g"].eqNullSafe(x["g"])
        same = lambda y: y["answer"] == x["answer"]

        def sized(n: Column) -> Column:
            weight = F.pow((n + 1).cast("double"), F.lit(-beta))
            more = weight - F.when(n > 0, F.pow(n.cast("double"), F.lit(-beta))).otherwise(0.0)

            def told(cells: Column) -> Column:
                of = lambda v, c: F.coalesce(F.get(F.filter(cells, lambda y: y["answer"] == v["answer"]), F.lit(0))[c], F.lit(0.0)) * more + F.when(same(v), weight * x[c]).otherwise(0.0)
                fresh = F.struct(x["answer"].alias("answer"), x["pos"].alias("first"), F.lit(0.0).alias("dc"), F.lit(0.0).alias("dcf"))
                known = F.when(F.exists(s["votes"], same), s["votes"]).otherwise(F.concat(s["votes"], F.array(fresh)).cast(kinds["votes"]))
                votes = F.transform(known, lambda v: F.struct(v["answer"].alias("answer"), v["first"].alias("first"), (v["dc"] + of(v, "c")).alias("dc"), (v["dcf"] + of(v, "cf")).alias("dcf")))
                before = F.get(F.filter(cells, same), F.lit(0))
                cell = F.struct(x["g"].alias("g"), x["answer"].alias("answer"), (F.coalesce(before["c"], F.lit(0.0)) + x["c"]).alias("c"), (F.coalesce(before["cf"], F.lit(0.0)) + x["cf"]).alias("cf"))
                return state(
                    clusters=F.concat(F.filter(s["clusters"], lambda y: ~here(y)), F.array(F.struct(x["g"].alias("g"), (n + 1).alias("n")))),
                    cells=F.concat(F.filter(s["cells"], lambda y: ~(here(y) & same(y))), F.array(cell)), votes=votes, valid=s["valid"] + 1, out=s["out"],
                )

            return let(F.filter(s["cells"], here), told)

        return let(F.coalesce(F.get(F.filter(s["clusters"], here), F.lit(0))["n"], F.lit(0).cast("long")), sized)

    def shown(s: Column, x: Column) -> Column:
        tops = F.transform(s["votes"], lambda v: F.struct(F.round(v["dc"] - v["dcf"], 9).alias("w"), (-v["first"]).alias("f"), v["answer"].alias("answer"), v["dc"].alias("dc"), v["dcf"].alias("dcf")))

        def of(t: Column) -> Column:
            total = F.aggregate(t, F.lit(0.0), lambda acc, v: acc + v["w"])
            entry = let(F.array_max(t), lambda b: F.struct(
                x["pos"].alias("prefix"), b["answer"].alias("leader"), let(total, lambda w: F.when(w > 0, b["w"] / w).otherwise(0.0)).alias("ratio"), F.when(b["dc"] > 0, b["dcf"] / b["dc"]).otherwise(1.0).alias("fragility"), s["valid"].alias("valid"),
            ))
            return F.concat(s["out"], F.array(entry))

        out = F.when(s["valid"] > 0, let(tops, of)).otherwise(s["out"])
        return state(clusters=s["clusters"], cells=s["cells"], votes=s["votes"], valid=s["valid"], out=out)

    start = state(clusters=F.array(), cells=F.array(), votes=F.array(), valid=F.lit(0), out=F.array())
    step = lambda s, x: let(F.when(x["ok"], added(s, x)).otherwise(s), lambda after: shown(after, x))
    return lists.select("question_id", "size", F.aggregate("items", start, step, lambda s: s["out"]).alias("states"))


def effective_states(rows: DataFrame, cap: int, beta: float = 0.5, cluster: str = "cluster") -> DataFrame:
    """After each prefix: ``leader``, its ``ratio``, mean ``fragility``, and valid rows.

    A vote weighs ``size ** -beta * confidence * (1 - fragility)``, the size being that of
    its cluster in the prefix, so earlier votes change as clusters grow. Votes keep 9
    decimals, so ties do not hang on the order of sums.
    """
    return _folded(rows, cap, beta, cluster).select("question_id", F.explode("states").alias("s")).select("question_id", "s.*")


def replay(rows: DataFrame, cap: int, support: float, fragile: float, beta: float = 0.5, min_valid: int = 2, cluster: str = "cluster") -> DataFrame:
    """Per question the first prefix that is decided: ``STOP`` or ``INTERVENE``; else
    ``SAMPLE`` after the last row."""
    ready = lambda s: (s["valid"] >= min_valid) & (F.round(s["ratio"], 9) >= support)
    first = F.get(F.filter("states", ready), F.lit(0))
    out = _folded(rows, cap, beta, cluster).select("question_id", F.least("size", F.lit(cap)).alias("rows"), first.alias("b"))
    action = F.when(F.col("b").isNull(), "SAMPLE").when(F.round("b.fragility", 9) <= fragile, "STOP").otherwise("INTERVENE")
    return out.select("question_id", action.alias("action"), F.col("b.leader").alias("leader"), F.coalesce(F.col("b.prefix") + 1, F.col("rows")).alias("used"))
