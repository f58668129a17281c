"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

A document becomes a vector of statistics. ``D`` random cosines of the standardised vector
approximate a Gaussian kernel, and ridge regression on them needs only the D x D normal
equations, which each partition sums on its own. A part of the labelled rows is left out of
that fit and calibrates its scores to probabilities by pooling adjacent violators.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.llm.common import Scratch, bound_batches, map_batches, texts, tidied

#: Most labelled rows that a fit uses; of more, a share chosen by a hash of the id.
MAX_FIT_ROWS = 20_000
FIT_PARTS = 8
FEATURES = 256
RIDGE = 1e-3
# Byte classes counted by the statistics.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!?", b"#*$%&|<>", b"@/\\=_~^+{}[]`", b"-'\"():;", b"\n"]
STATISTICS = 24


def _class_matrix() -> np.ndarray:
    out = np.zeros((256, len(CLASSES) + 1))
    for i, members in enumerate(CLASSES):
        out[list(members), i] = 1
    out[128:, -1] = 1
    return out


CLASS_OF = _class_matrix()


def statistics(text: str) -> list[float]:
    """Length, character classes, word shape, and repetition, each of moderate size."""
    data = text.encode("utf-8")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * (STATISTICS - 1) + [1.0]
    classes = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASS_OF / len(data)
    counts = Counter(words)
    common = counts.most_common(5)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    stuck = sum(map(bytes.__eq__, words, words[1:]))
    shape = [
        np.log1p(n) / 10,
        lengths.mean() / 10,
        lengths.std() / 10,
        len(counts) / n,
        len(counts) / n**0.7,
        common[0][1] / n,
        sum(c for _, c in common) / n,
        stuck / n,
        (lengths <= 1).sum() / n,
        (lengths > 15).sum() / n,
        1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(data) / max(1, len(lines))) / 10,
    ]
    return [float(x) for x in (*classes, *shape, 0.0)]


class Model:
    """Everything that scoring needs; its size does not depend on the data."""

    def __init__(self, mean, scale, weights, phases, coef, xs, ys):
        self.mean, self.scale, self.weights, self.phases, self.coef, self.xs, self.ys = mean, scale, weights, phases, coef, xs, ys

    def expand(self, rows: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((rows - self.mean) / self.scale, -6, 6) @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.expand(rows) @ self.coef

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(rows), self.xs, self.ys), 0, 1)


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of labels to scores: centre and level of each pooled block.

    Equal scores are one block from the start, so the order of ties does not matter.
    """
    values, where, counts = np.unique(scores, return_inverse=True, return_counts=True)
    sums = np.bincount(where, labels, len(values))
    blocks: list[list[float]] = []
    for s, y, n in zip((values * counts).tolist(), sums.tolist(), counts.tolist(), strict=True):
        blocks.append([s, y, float(n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s2, y2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + y2, blocks[-1][2] + n2]
    xs, ys = np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
    return xs, ys


def constant_model(level: float) -> Model:
    size = STATISTICS
    return Model(np.zeros(size), np.ones(size), np.zeros((size, 1)), np.zeros(1), np.zeros(2), np.array([0.0]), np.array([level]))


def _normal_equations(model: Model):
    def run(batches):
        size = len(model.phases) + 1
        square, line, n = np.zeros((size, size)), np.zeros(size), 0
        for batch in batches:
            rows = np.array(batch.column(0).to_pylist(), float)
            if len(rows):
                z = model.expand(rows)
                square += z.T @ z
                line += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
                n += len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([square.tobytes()]), pa.array([line.tobytes()]), pa.array([n], pa.int64())], ["square", "line", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS, seed: int = 7) -> Model:
    """Fit on at most about ``max_rows`` labelled documents (chosen by a hash of the id).

    ``labels`` may repeat an id (its mean label, at least one half, counts as 1) and hold
    nulls (not used). With no usable label every score is 0.5; with one class only, that
    class's share. What reaches the driver: the sums of ``FIT_PARTS`` partitions, and the
    calibration part of the bounded sample (all of the sample if that part is empty).
    """
    scratch = Scratch(docs.sparkSession)
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("doc")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    total = usable.count()
    if not total:
        return constant_model(0.5)
    share = min(1.0, max_rows / total)
    spread = F.pmod(F.xxhash64("doc", F.lit(seed)), F.lit(1_000_000)) / 1e6
    # at most about max_rows rows of two numbers: small enough for every executor
    chosen = F.broadcast(usable.where(spread < share))
    joined = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(chosen, "doc")

    def describe(ids: pa.Array, column: pa.Array, y: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array([statistics(x) for x in texts(column)], pa.list_(pa.float64())), y], ["doc", "x", "y"])

    kind = dict(joined.dtypes)["doc"]
    sample = scratch.keep(map_batches(joined, ["doc", "text", "y"], describe, f"doc {kind}, x array<double>, y double"))
    parts = [F.col("x")[i] for i in range(STATISTICS)]
    held = F.pmod(F.xxhash64("doc", F.lit(seed + 1)), F.lit(4)) == 0
    row = sample.agg(*(F.avg(p) for p in parts), *(F.stddev_pop(p) for p in parts), F.avg("y"), F.count("*")).first()
    if not row[-1]:
        return constant_model(0.5)
    if row[-2] in (0.0, 1.0):
        return constant_model(row[-2])
    mean, scale = np.array(row[:STATISTICS]), np.maximum(np.array(row[STATISTICS : 2 * STATISTICS]), 1e-6)
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES))
    model = Model(mean, scale, weights, rng.uniform(0, 2 * np.pi, FEATURES), None, None, None)
    sums = sample.where(~held).select("x", "y").coalesce(FIT_PARTS).mapInArrow(_normal_equations(model), "square binary, line binary, n long").collect()
    size = FEATURES + 1
    square = sum(np.frombuffer(r.square).reshape(size, size) for r in sums) if sums else np.zeros((size, size))
    line = sum(np.frombuffer(r.line) for r in sums) if sums else np.zeros(size)
    n = max(1, sum(r.n for r in sums))
    model.coef = np.linalg.solve(square / n + RIDGE * np.eye(size), line / n)
    rest = sample.where(held).select("doc", "x", "y").collect() or sample.select("doc", "x", "y").collect()
    rest.sort(key=lambda r: (r.doc, r.x))
    raw = model.raw(np.array([r.x for r in rest]))
    model.xs, model.ys = isotonic(raw, np.array([r.y for r in rest]))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` per input row; null and empty texts get the score of an empty text, and
    a text of any length is read whole."""
    kind = dict(docs.dtypes)[id_col]

    def step(ids: pa.Array, column: pa.Array) -> pa.RecordBatch:
        rows = np.array([statistics(x) for x in texts(column)], float).reshape(-1, STATISTICS)
        return pa.RecordBatch.from_arrays([ids, pa.array(model.scores(rows))], [id_col, "score"])

    return map_batches(docs, [id_col, text_col], step, f"`{id_col}` {kind}, score double")


def accept(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``least``, all columns as they were.

    A null or empty text has the score of an empty text; a text of any length is read whole,
    and a worker holds one Arrow batch at a time.
    """
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(x) for x in texts(batch.column(at))], float).reshape(-1, STATISTICS)
            yield batch.filter(pa.array(model.scores(rows) >= least))

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out(column: str = "doc_id") -> Column:
    """Rows never learnt from: CRC-32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> DataFrame:
    """One row per input row: ``id, held_out, score, predicted``.

    Learns from labels of rows that are not ``held_out``. ``predicted`` is 1 if the score is
    at least ``threshold``. A null id is not held out and gets a score from its text.
    """
    model = fit(docs, labels.where(~F.coalesce(held_out(id_col), F.lit(True))), label, id_col, text_col, max_rows)
    scored = score(docs, model, id_col, text_col)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
