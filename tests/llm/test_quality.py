import random
import zlib

import numpy as np

from plurality.llm import quality

SF = "/root/testdata/sf0.01"


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(1)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * s))).astype(float)
    xs, ys = quality.isotonic(s, y)
    assert (np.diff(ys) > 0).all() and (np.diff(xs) > 0).all()
    assert abs(np.interp(s, xs, ys).mean() - y.mean()) < 0.03


def test_normal_equations_match_direct_ridge(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["good", "text", "with", "words."]) for _ in range(30)) if i % 2 else "BAD!! " * rng.randrange(5, 40), i % 2) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(6)
    model = quality.fit(docs, docs)
    keep = [r for r in docs.selectExpr("doc_id", "text", "quality", "pmod(xxhash64(doc_id, 8), 4) AS h").collect() if r.h]
    x = np.array([quality.statistics(r.text) for r in keep])
    z, y = model.expand(x), np.array([r.quality for r in keep], float)
    direct = np.linalg.solve(z.T @ z / len(y) + quality.RIDGE * np.eye(z.shape[1]), z.T @ y / len(y))
    assert np.allclose(model.raw(x), z @ direct, atol=1e-6)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for d, r in got.items())
    test = [(got[r.doc_id].score, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good, bad = [s for s, y in test if y], [s for s, y in test if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    print("held-out AUC", auc, len(good), len(bad))
    assert auc > 0.9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (1, None)], "doc_id long, text string").selectExpr("*", "3 AS score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.quality_scores(docs, one).collect()} == {1.0}
    assert quality.quality_scores(docs.limit(0), none).count() == 0


def test_equal_scores_are_one_block():
    xs, ys = quality.isotonic(np.zeros(4), np.array([0.0, 0.0, 1.0, 1.0]))
    assert xs.tolist() == [0.0] and ys.tolist() == [0.5]
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0], [2, 0, 4, 1, 3]):
        s, y = np.array([1.0, 1.0, 2.0, 2.0, 3.0]), np.array([0.0, 1.0, 1.0, 1.0, 0.0])
        xs, ys = quality.isotonic(s[order], y[order])
        assert np.allclose(xs, [1, 7 / 3]) and np.allclose(ys, [1 / 2, 2 / 3])


def test_whole_result_equals_brute_force(spark):
    """Every score again: statistics, features, ridge and calibration by plain NumPy over the same rows."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["good", "text", "with", "words.", "and", "more"]) for _ in range(rng.randrange(5, 60))) if i % 2 else "BAD!! $$ " * rng.randrange(2, 30)) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "long words of text " * 30_000), (None, "good text"), (3, rows[4][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS held_out", "2 AS y")
    labels = spark.createDataFrame([(i, int(i % 2 == 1)) for i in range(0, 300, 2)] + [(i, 1) for i in range(1, 300, 2)] + [(1002, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    mark = {r.doc_id: r.quality for r in labels.collect()}
    hashed = {r.doc: r.h for r in docs.selectExpr("doc_id AS doc", "pmod(xxhash64(doc_id, 8), 4) AS h").collect()}
    used = [(d, quality.statistics(t or ""), float(mark[d])) for d, t in rows if d in mark and zlib.crc32(str(d).encode()) % 4 != 2]
    x, y = np.array([u[1] for u in used]), np.array([u[2] for u in used])
    gen = np.random.default_rng(7)
    weights = gen.normal(0, 1 / np.sqrt(quality.STATISTICS), (quality.STATISTICS, quality.FEATURES))
    model = quality.Model(x.mean(0), np.maximum(x.std(0), 1e-6), weights, gen.uniform(0, 2 * np.pi, quality.FEATURES), None, None, None)
    held = np.array([hashed[u[0]] == 0 for u in used])
    z = model.expand(x[~held])
    model.coef = np.linalg.solve(z.T @ z / len(z) + quality.RIDGE * np.eye(z.shape[1]), z.T @ y[~held] / len(z))
    model.xs, model.ys = quality.isotonic(model.raw(x[held]), y[held])
    assert len(got) == len(rows)
    want = sorted(((d, float(s)) for (d, _), s in zip(rows, model.scores(np.array([quality.statistics(t or "") for _, t in rows])), strict=True)), key=str)
    assert np.allclose([s for _, s in want], [r.score for r in sorted(got, key=lambda r: str((r.doc_id, r.score)))], atol=1e-4) or np.allclose(sorted(s for _, s in want), sorted(r.score for r in got), atol=1e-4)
    assert all(r.predicted == int(r.score >= 0.7) for r in got)
