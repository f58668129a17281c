"""Native operators on long runs of what their patterns repeat: no call a repeat in Java, and
time in proportion to the text."""

import re
import time
from pathlib import Path

import pytest

from plurality.llm import decontaminate, secrets, threads

ATOMS = [">", "> ", "\t>", "1,", "1.2", "a_", "A1-", "=", "x.", "\n", "token=abcdef ", "example", "é ", "On ", "!"]


@pytest.mark.parametrize("operator", [5, 6, 9])
def test_long_runs(spark, operator):
    texts = [atom * n + end for atom in ATOMS for n, end in ((3_000, " word"), (100_000 // len(atom), "\nword > 1"))]
    spec = "doc_id long, conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(i, i, 0, "user", t) for i, t in enumerate(texts)], spec).repartition(4)
    start = time.time()
    if operator == 5:
        assert threads.reply_threads(rows.drop("doc_id")).count() == len(texts)
    elif operator == 6:
        items = spark.createDataFrame([(1, "1,2 " * 20), (2, "> On x. token=abcdef word by word it goes"), (3, "1.2" * 4000)], "item_id long, text string")
        assert decontaminate.contaminated(rows, items).count() >= 0
    else:
        assert secrets.secret_spans(rows).count() == len(texts)
    assert time.time() - start < 120


def test_many_levels_of_many_lines(spark):
    deep = "\n".join(">" * i + f" line {i}" for i in range(1, 3001))
    rows = [(1, 0, "user", "> " * 100_000 + "far"), (1, 1, "user", deep), (1, 2, "user", "line 7\n\nline 9"), (1, 3, "user", deep)]
    start = time.time()
    got = {r.turn: r for r in threads.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert time.time() - start < 60
    assert got[0].n_quotes == 1 and got[1].n_quotes == got[3].n_quotes == 3000
    assert got[3].parent_turn == 2 and got[3].n_linked == 2 and got[1].parent_turn is None


def test_one_root_with_very_many_replies(spark):
    rows = [(1, 0, "user", "question")] + [(1, t, "user", "> question\nme too") for t in range(1, 3000)] + [(None, t, "user", "> question") for t in range(300)]
    got = threads.reply_threads(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert sum(r.parent_turn == 0 and r.depth == 1 and r.thread_turn == 0 for r in got) == 2999


def test_java_patterns_repeat_no_group_of_variable_length():
    """Groups in column expressions repeat possessively, or hold a fixed length."""
    for path in Path("plurality").rglob("*.py"):
        for line in path.read_text().splitlines():
            if re.search(r"re(gex)?\.(compile|fullmatch|search|match|sub)|CORE = r|^    \{?'|oracle", line) or not re.search(r"r\"|\br'|f\"\^", line):
                continue
            for found in re.finditer(r"\)(\*|\+|\{\d+,\d*\})(?!\+)", line):
                before = line[: found.start()]
                group = before[before.rindex("(") :]
                assert not re.search(r"[*+?]|\|", group.removeprefix("(?:")), (path, line)
