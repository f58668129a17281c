import duckdb

from plurality.llm import decontaminate as dec

ITEM = "A farmer has 12 cows and sells 5 of them to Mary for 300 dollars each. How many cows has the farmer left when Mary returns 2 of them?"
ROWS = [
    (1, "Intro words here. " + ITEM + " More text follows."),
    (2, ITEM.replace("12", "40").replace("Mary", "John").replace("300", "1,250.5").replace("dollars", "euros")),
    (3, ITEM.replace("when Mary", "when Peter")),
    (4, "Nothing of that kind, only 12 cows and some 300 dollars for a farmer."),
    (5, None),
    (6, ""),
    (None, ITEM),
    (7, " ".join(f"{i} Name{i}" for i in range(50))),
    (8, " ".join(ITEM.split()[:12])),
    (9, "tiny item of five words stands here"),
    (1, "Intro words here. " + ITEM + " More text follows."),
]
ITEMS = [(100, ITEM), (101, "tiny item of five words"), (102, "no"), (103, None), (104, "1 2 3 4 5 6 7 8 9 10")]


def run(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id", "'a' AS hash")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    return sorted(map(tuple, dec.contaminated(docs, bench).collect()), key=str), docs, bench


def oracle(rows, items):
    con = duckdb.connect()
    for name, key, data in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        if data:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", data)
    return sorted(con.sql(dec.oracle_sql()).fetchall(), key=str)


def test_reparameterised_questions(spark):
    got, docs, bench = run(spark, ROWS, ITEMS)
    found = {(d, i) for d, i, *_ in got}
    assert {(1, 100), (2, 100), (None, 100), (9, 101)} <= found
    assert not {d for d, _ in found} & {4, 5, 6, 7}
    assert all(n == t for d, i, n, t in got if d in (1, 2))
    assert got == oracle(ROWS, ITEMS)
    kept = dec.without_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {None, 4, 5, 6, 7}


def test_inconsistent_slots_do_not_count(spark):
    twice = "the prize goes to Anna and later on to Bert and then to Anna once more in the end"
    rows = [(1, twice.replace("Anna", "Carl")), (2, twice.replace("Anna", "Carl", 1))]
    got, *_ = run(spark, rows, [(1, twice)])
    assert got == oracle(rows, [(1, twice)]) and [d for d, *_ in got] == [1]


def test_shuffled_when_too_large_to_send(spark, monkeypatch):
    monkeypatch.setattr(dec, "BROADCAST_WINDOWS", 0)
    assert run(spark, ROWS, ITEMS)[0] == oracle(ROWS, ITEMS)


def test_empty_tables(spark):
    assert run(spark, ROWS[:2], ITEMS[3:4])[0] == [] and run(spark, ROWS[5:6], ITEMS)[0] == []
    _, docs, bench = run(spark, ROWS, ITEMS)
    assert dec.contaminated(docs.limit(0), bench).count() == 0 == dec.contaminated(docs, bench.limit(0)).count()


def test_documents_equal_oracle(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = sorted(con.sql(dec.oracle_sql()).fetchall())
    assert want and sorted(map(tuple, dec.contaminated(docs, bench).collect())) == want


def test_long_lists_of_numbers(spark):
    rows = [(1, "12," * 100_000), (2, ITEM)]
    got, *_ = run(spark, rows, ITEMS[:1])
    assert got == oracle(rows, ITEMS[:1]) and [d for d, *_ in got] == [2]


def test_copies_in_capitals(spark):
    rows = [(1, "So it reads. " + ITEM.upper()), (2, ITEM.title()), (3, ITEM.lower()), (4, "ONLY 12 COWS AND SOME 300 DOLLARS FOR A FARMER")]
    got, *_ = run(spark, rows, ITEMS[:1])
    assert {d for d, *_ in got} == {1, 2, 3} and set(oracle(rows, ITEMS[:1])) <= set(got)


def test_items_of_few_literals(spark):
    items = ["What is 17 times 24?", "Who wrote Hamlet in 1603?", "Compute 12 + 45 - 7 + 88 - 3 + 19.", "Solve 3x + 7 = 22 for x.", "Name Ann, Bob, Carl, Dora, Emil, Fritz, Gus and Hans in order", "Define entropy"]
    rows = [(i, f"Some words before. {x} Some words after.") for i, x in enumerate(items)]
    rows += [(100, "What is 18 times 25? Compute 1 + 5 - 7 + 8 - 3 + 9. Define nothing but entropy")]
    assert [(d, i) for d, i, *_ in run(spark, rows, list(enumerate(items)))[0]] == [(i, i) for i in range(len(items))]


def test_other_names_at_the_beginning_of_sentences(spark):
    item = "Alice has 5 apples. Bob has 3. Alice gives 2 to Bob. Carol eats 4. How many remain?"
    changed = item.replace("Alice", "Zoe").replace("Bob", "Max").replace("Carol", "Ines")
    rows = [(1, changed), (2, "Question: " + changed.replace("5", "17")), (3, changed.replace("Zoe gives", "Ute gives").replace("to Max", "to Jan"))]
    assert [d for d, *_ in run(spark, rows, [(1, item)])[0]] == [1, 2]


def test_long_quotes_of_long_items(spark):
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    item, rows = " ".join(words), [(1, "so " + " ".join(words[50:63]) + " it goes"), (2, " ".join(words[50:62])), (3, " ".join(words[:8] + words[20:30] + words[90:101]))]
    assert run(spark, rows, [(1, item)])[0] == [(1, 1, 6, 193)]


def test_item_inside_a_very_long_text(spark):
    filler = "plain filler words go on and on. " * 20_000
    rows = [(1, filler + ITEM + filler), (2, filler)]
    got, *_ = run(spark, rows, [(100, ITEM)])
    assert [(d, i) for d, i, *_ in got] == [(1, 100)]
