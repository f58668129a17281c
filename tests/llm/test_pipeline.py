import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plurality.llm import decontaminate, quality
from tests.llm.test_jaccard import brute
from tests.llm.test_secrets import brute as brute_secrets

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    good = spark.createDataFrame(steps["quality classifier"](spark, docs, SF).collect(), docs.schema)
    assert good.columns == columns
    scores = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert {r.doc_id for r in good.collect()} == {d for d, s in scores.items() if s >= 0.5}
    marks = {r.doc_id: r.quality for r in labels.collect()}
    kept = {r.doc_id for r in good.collect()}
    assert sum(marks[d] == (d in kept) for d in marks) / len(marks) > 0.95

    rows = [(r.doc_id, r.text) for r in good.collect()]
    single = spark.createDataFrame(steps["n-gram Jaccard join"](spark, good, SF).collect(), docs.schema)
    assert {r.doc_id for r in single.collect()} == {d for d, _, c in brute(rows, 5, 80) if d == c}

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    clean = spark.createDataFrame(steps["benchmark decontamination"](spark, single, SF).collect(), docs.schema)
    bad = {r.doc_id for r in decontaminate.contaminated(single, bench).collect()}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - bad
    held = {r.doc_id for r in single.collect() if any(b.text in r.text for b in bench.collect())}
    assert held and held <= bad

    safe = spark.createDataFrame(steps["secret scans"](spark, clean, SF).collect(), docs.schema)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in safe.collect():
        spans = [tuple(map(int, s.split(":")[1:])) for s in brute_secrets(before[r.doc_id])[4].split(",") if s]
        want = before[r.doc_id]
        for s, e in sorted(spans, reverse=True):
            want = want[:s] + "[secret]" + want[e:]
        assert re.sub(r"(\[secret\])+", "[secret]", r.text) == re.sub(r"(\[secret\])+", "[secret]", want) and r.n_chars == len(r.text)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = steps["BPE encoding and decoding"](spark, safe, SF).collect()
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert len(last) == len(texts)
    for r in last:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids", "decoded"] and rows.count() > 50
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_with_nulls_repeats_and_clashing_names(spark, tmp_path):
    """Each stage keeps its columns, gives each odd row its defined result, and takes an empty table."""
    long = " ".join(f"w{i % 9973}" for i in range(60_000))
    copy = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, copy), (2, copy), (2, copy), (None, copy), (3, None), (4, ""), (5, " \n"), (6, long), (7, long + " end"), (8, "token=abcdef123456 stays elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'en' AS lang", "1 AS score", "'x' AS component_id", "2 AS n_tokens", "3 AS item_id", "4 AS _spans", "length(text) AS n_chars")
    none = tmp_path / "sf"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{none}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)
    ids = lambda frame: sorted((r.doc_id for r in frame.collect()), key=str)
    good = steps["quality classifier"](spark, docs, str(none))
    assert good.columns == docs.columns and ids(good) == ids(docs)  # no labels: all score 0.5
    single = steps["n-gram Jaccard join"](spark, docs, str(none))
    assert single.columns == docs.columns and ids(single) == sorted([1, None, 3, 4, 5, 6, 8], key=str)
    clean = steps["benchmark decontamination"](spark, docs, str(none))
    assert clean.columns == docs.columns and ids(clean) == ids(docs)
    safe = {r.doc_id: r for r in steps["secret scans"](spark, docs, str(none)).collect()}
    assert safe[8].text == "[secret] stays elsewhere" and safe[8].n_chars == 24 and safe[3].text is None and safe[3].n_chars is None
    assert steps["secret scans"](spark, docs.drop("n_chars"), str(none)).columns == docs.drop("n_chars").columns
    done = steps["BPE encoding and decoding"](spark, docs, str(none))
    assert ids(done) == ids(docs) and {r.doc_id: r.n_tokens for r in done.collect()}[3] == 0
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.limit(0), str(none)).count() == 0, name
