import random
import re

import duckdb
import pytest

from plurality.llm import threads

ROWS = [
    (1, 0, "user", "How do I boil\nan egg?\n\nI have a pot."),
    (1, 1, "assistant", "> How do I boil an egg?\n\nUse water."),
    (1, 2, "user", ">> how do I boil\n>> an egg?\n> Use   water.\nHow long?"),
    (1, 3, "assistant", "> I have a pot.\nGood."),
    (1, 4, "user", "> > Use water.\n> How long?\nTell me, is 3 < 5 > 2?"),
    (1, 5, "user", "> never said this\nwhat?"),
    (2, 0, "user", "> Use water.\nother conversation"),
    (2, 1, None, None),
    (3, 0, "user", ""),
    (None, 1, "user", "> x\ny"),
    (4, None, "user", "> x\ny"),
    (5, 0, "user", "same"),
    (5, 0, "user", "same"),
    (5, 1, "user", " > same\r\n"),
    (6, 0, "system", "\t>\t> \n>\n  lead and trail  \n\n"),
]


def test_threads_equal_sql(spark):
    messages = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS body", "2 AS conv")
    got = threads.reply_threads(messages)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
    want = con.sql(threads.ORACLE_SQL)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    by = {(r[0], r[1]): r for r in rows}
    assert [by[1, t][6] for t in range(6)] == [None, 0, 1, 0, 2, None]
    assert [by[1, t][7:9] for t in range(6)] == [(0, 0), (0, 1), (0, 2), (0, 1), (0, 3), (5, 0)]
    assert by[1, 2][3] == "How long?" and by[1, 4][3] == "Tell me, is 3 < 5 > 2?" and by[5, 1][6] == 0
    assert threads.reply_threads(messages.limit(0)).count() == 0


def brute(rows):
    """Levels, links, parents, threads and depths by plain loops over a small table."""
    parsed = []
    for conv, turn, role, text in rows:
        lines = []
        for line in (text or "").replace("\r", "").split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", line)[0]
            lines.append([marks.count(">"), line[len(marks) :]])
        lines = [[-1 if i + 1 < len(lines) and lines[i + 1][0] > level and re.search(threads.ATTRIBUTION, body) else level, body] for i, (level, body) in enumerate(lines)]

        def passages(level, lines=lines):
            kept = [b.strip(" ") if n == level else "" for n, b in lines]
            return {x for x in (re.sub(r"[ \t\n\x0b\x0c\r]+", " ", p).strip(" ").lower() for p in [*re.split("\n\n+", "\n".join(kept)), *kept]) if x}

        quoted = {(k, p) for k in range(1, max(n for n, _ in lines) + 1) for p in passages(k)}
        parsed.append((conv, turn, role, "\n".join(b for n, b in lines if n == 0).strip(), passages(0), quoted))
    origin = {}
    for conv, turn, _, _, own, _ in parsed:
        for p in own:
            if turn is not None:
                origin[conv, p] = min(turn, origin.get((conv, p), turn))
    links = {}
    for conv, turn, _, _, _, quoted in parsed:
        if conv is not None and turn is not None:
            hits = {(k, p) for k, p in quoted if origin.get((conv, p), turn) < turn}
            links.setdefault((conv, turn), set()).update((k, origin[conv, p], p) for k, p in hits)
    parent = {key: max((-k, o) for k, o, _ in hits)[1] for key, hits in links.items() if hits}
    out = []
    for conv, turn, role, body, _, _ in parsed:
        depth, root = 0, turn
        while (conv, root) in parent:
            depth, root = depth + 1, parent[conv, root]
        same_turn = set().union(*(q for c, t, *_, q in parsed if (c, t) == (conv, turn)))
        out.append((conv, turn, role, body, len(same_turn), len(links.get((conv, turn), ())), parent.get((conv, turn)), root, depth))
    return out


def generated(seed, conversations=12, turns=30):
    """Replies that quote one or two earlier messages with their quotes, and say things twice."""
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        said = []
        for turn in range(turns):
            lines = []
            for _ in range(rng.choice([0, 1, 1, 1, 2])):
                if said:
                    if rng.random() < 0.5:
                        lines.append(rng.choice(["On Monday Ann wrote:", "Am 3. Mai schrieb Bo:", "Le lundi Cy a écrit :"]))
                    old = rng.choice(said[-6:]).split("\n")
                    at = rng.randrange(len(old))
                    lines += [rng.choice([">", "> "]) + x for x in old[at : at + rng.randint(1, 6)]]
            lines += [rng.choice(["", f"line {rng.randrange(40)} Here", f"unique {conv} {turn}", "On Tuesday we wrote:"]) for _ in range(rng.randint(0, 4))]
            said.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), said[-1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_quotes_equal_brute_force_and_sql(spark, seed):
    rows = generated(seed) + [(99, t, "user", ("> " * t) + "chain\n" + f"turn {t}") for t in range(40)]
    rows += [(100, 0, "user", "a long line " * 30_000), (100, 1, "user", "> " + "A long  line " * 30_000 + "\nyes")]
    want = brute(rows)
    assert max(r[8] for r in want) >= 5 and sum(r[5] for r in want) > 200
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r)[:9] for r in threads.reply_threads(messages).collect())
    assert got == sorted(want)
    if seed == 1:
        con = duckdb.connect()
        con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        assert sorted(r[:9] for r in con.sql(threads.ORACLE_SQL).fetchall()) == got
