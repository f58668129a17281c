import math

from pyspark.sql import functions as F

from plurality.functions import prompts as P
from plurality.functions import scores as S


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def test_prompts(spark):
    names = [("x/DeepSeek-R1-Distill-Qwen",), ("Llama-3",), ("qwen2",), ("other",)]
    assert values(spark, names, "n string", P.model_family(F.col("n"))) == ["deepseek", "llama", "qwen", None]
    family = [("qwen",), ("none",)]
    assert values(spark, family, "f string", P.generation_limits(F.col("f"))["max_model_len"]) == [8192, None]
    assert values(spark, family, "f string", P.confidence_suffix(F.col("f")))[0].endswith("<|im_start|>assistant\n")
    think = [("a<｜Assistant｜><think>\n",), ("<think> b",), ("a<｜Assistant｜><think>\\n",)]
    assert values(spark, think, "t string", P.without_forced_think(F.col("t"))) == ["a<｜Assistant｜>", "<think> b", "a<｜Assistant｜>"]
    assert values(spark, [("x<｜Assistant｜><think>\\ny",)], "t string", P.template_without_forced_think(F.col("t"))) == ["x<｜Assistant｜>y"]
    text = values(spark, [("2+2?", "option letter")], "q string, t string", P.reasoning_prompt(F.col("q"), F.col("t")))[0]
    assert "a option letter (e.g., (A))" in text and text.endswith("\n\nQuestion: 2+2?\nAnswer:")
    chat = "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\nQuestion: question : Why?\nOptions:\nA) one\nb. two<|im_end|>\n<|im_start|>assistant\n"
    assert values(spark, [(chat,), ("plain",)], "p string", P.without_chat_wrapper(F.col("p"))) == ["Why?\nOptions:\nA) one\nb. two", "plain"]
    got = values(spark, [(chat,), ("stem only",), ("s\nA) x\nC) y",), ("s\nA) x\nA) z\nB) y",)], "p string", P.question_and_options(F.col("p")))
    assert [(g.stem, g.options) for g in got] == [("Why?", ["one", "two"]), ("stem only", []), (None, []), ("s", ["x", "y"])]


def test_scores(spark):
    rows = [([[0.5, 0.25]], 2), ([[0.5, 0.0]], 2), ([[0.5]], 2), ([], 2), (None, None), ([[0.5], [0.25, 0.25]], None)]
    got = values(spark, rows, "v array<array<double>>, n int", S.self_certainty(F.col("v"), F.col("n"), logs=False))
    want = -(math.log(2 * 0.5) + math.log(2 * 0.25)) / 2
    mixed = -(math.log(0.5) + 2 * math.log(2 * 0.25)) / 3
    assert abs(got[0] - want) < 1e-12 and got[1:5] == [None] * 4 and abs(got[5] - mixed) < 1e-12
    logs = values(spark, [([[math.log(0.5), math.log(0.25)]], 2)], "v array<array<double>>, n int", S.self_certainty(F.col("v"), F.col("n"), logs=True))
    assert abs(logs[0] - want) < 1e-12
    frame = spark.createDataFrame([(None, 0.3, 0.9), (float("nan"), None, 0.8), (0.1, 0.2, 0.7)], "cisc_confidence double, base_confidence double, confidence double").coalesce(1)
    score, source = S.method_score(frame.columns, "informed", F.col("confidence"))
    assert [tuple(r) for r in frame.select(score, source).collect()] == [(0.3, "base_confidence"), (0.8, "confidence"), (0.1, "cisc_confidence")]
