"""Prompts: what a model family needs, stripping wrappers, and option blocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Generation limits and the question for a confidence by model family.
LIMITS = {"llama": (1024, 8192), "qwen": (1024, 8192), "deepseek": (2048, 8192)}
CONFIDENCE_SUFFIX = {
    "llama": "<|eot_id|><|start_header_id|>user<|end_header_id|>\n\nIs the answer correct? (Yes/No)<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n",
    "qwen": "<|im_end|>\n<|im_start|>user\nIs the answer correct? (Yes/No)<|im_end|>\n<|im_start|>assistant\n",
    "deepseek": "<｜end▁of▁sentence｜><｜User｜>Directly answer the question by Yes or No:Is the answer correct?<｜Assistant｜>",
}
# Chat markers, control tokens, and option lines.
USER_MARKERS = ["<|im_start|>user\n", "<|start_header_id|>user<|end_header_id|>", "<｜User｜>", "[INST]"]
END_MARKERS = ["<|im_end|>", "<|eot_id|>", "<｜Assistant｜>", "<|start_header_id|>assistant<|end_header_id|>", "[/INST]"]
CONTROL = r"(?:<\|[^>\n]+\|>|<｜[^>\n]+｜>|</?s>|\[/?INST\])"
OPTION_LINE = r"(?md)^[ \t]*([A-Ea-e])[.)][ \t]+(.+?)[ \t]*$"
# The instruction of a reasoning prompt.
INSTRUCTION = (
    "For the following question, provide a step-by-step explanation of your thought process.\n"
    "Use the format demonstrated below for your response.\n"
    "```Example Format:\n"
    "Explanation: <Your detailed explanation here, outlining how you arrived at your answer.>\n"
    "Answer: <Insert your concise answer here, which should include a {type} (e.g., {demo})>\n"
    "Ensure that your response strictly adheres to this format. Explicitly include the words 'Explanation:', 'Answer:'."
)
FORCED_THINK = r"(<｜Assistant｜>)<think>[ \t]*(?:\\n|\n)?\s*\z"


def model_family(name: Column) -> Column:
    """``deepseek`` before ``llama`` before ``qwen``, as distilled names hold two; else null."""
    low = F.lower(name)
    return F.when(low.contains("deepseek") | low.contains("/ds") | low.startswith("ds"), "deepseek").when(low.contains("llama"), "llama").when(low.contains("qwen"), "qwen")


def _by_family(family: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(family == name, value).otherwise(out)
    return out


def confidence_suffix(family: Column) -> Column:
    return _by_family(family, {k: F.lit(v) for k, v in CONFIDENCE_SUFFIX.items()})


def generation_limits(family: Column) -> Column:
    """``struct<max_new_tokens, max_model_len>``."""
    return _by_family(family, {k: F.struct(F.lit(a).alias("max_new_tokens"), F.lit(b).alias("max_model_len")) for k, (a, b) in LIMITS.items()})


def without_forced_think(prompt: Column) -> Column:
    """A prompt without the think tag that a template put at its end."""
    return F.regexp_replace(prompt, FORCED_THINK, "$1")


def template_without_forced_think(template: Column) -> Column:
    start = "<｜Assistant｜>"
    return F.replace(F.replace(template, F.lit(start + "<think>\\n"), F.lit(start)), F.lit(start + "<think>\n"), F.lit(start))


def reasoning_prompt(question: Column, answer_type: Column) -> Column:
    """The prompt for a model without a chat template of its own."""
    demo = F.when(answer_type == "option letter", "(A)").otherwise("1")
    text = F.replace(F.replace(F.lit(INSTRUCTION), F.lit("{type}"), answer_type), F.lit("{demo}"), demo)
    return F.concat(text, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def without_chat_wrapper(prompt: Column) -> Column:
    """The last user turn, without control tokens and up to two ``Question:`` labels."""
    tails = [F.substring_index(prompt, m, -1) for m in USER_MARKERS]
    text = tails[0]
    for tail in tails[1:]:  # the marker that stands last leaves the shortest rest
        text = F.when(F.length(tail) < F.length(text), tail).otherwise(text)
    for mark in END_MARKERS:
        text = F.substring_index(text, mark, 1)
    text = F.regexp_replace(F.regexp_replace(text, CONTROL, ""), r"^\s+|\s+$", "")
    for _ in range(2):
        text = F.regexp_replace(text, r"(?i)^\s*Question\s*:\s*", "")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def question_and_options(prompt: Column) -> Column:
    """``struct<stem, options>`` of a prompt: the first line of each label, accepted only if
    the labels are A, B... without a gap; a prompt without option lines is all stem."""
    text = without_chat_wrapper(prompt)
    labels = F.transform(F.regexp_extract_all(text, F.lit(OPTION_LINE), F.lit(1)), F.upper)
    texts = F.transform(F.regexp_extract_all(text, F.lit(OPTION_LINE), F.lit(2)), lambda t: F.trim(F.regexp_replace(t, CONTROL, "")))
    kinds = F.array_sort(F.array_distinct(labels))
    whole = F.array(*[F.lit(c) for c in "ABCDE"])
    ok = (F.size(kinds) >= 2) & (kinds == F.slice(whole, 1, F.size(kinds)))
    options = F.transform(kinds, lambda k: F.get(texts, (F.array_position(labels, k) - 1).cast("int")))
    before = F.get(F.split(text, OPTION_LINE, 2), F.lit(0))
    stem = F.regexp_replace(F.regexp_replace(before, r"(?i)\n?\s*Options\s*:\s*$", ""), r"^\s+|\s+$", "")
    none = F.size(labels) == 0
    empty = F.array().cast("array<string>")
    return F.struct(F.when(none, text).when(ok, F.nullif(stem, F.lit(""))).alias("stem"), F.when(ok, options).otherwise(empty).alias("options"))
