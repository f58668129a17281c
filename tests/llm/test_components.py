import random

import pytest

from plurality.llm.common import Scratch
from plurality.llm.components import connected_components


def brute(edges):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {x: root(x) for x in list(up)}


@pytest.mark.parametrize("kind", ["path", "shuffled path", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(5)
    ids = list(range(300))
    if kind == "shuffled path":
        rng.shuffle(ids)
    edges = {"path": list(zip(ids, ids[1:])), "shuffled path": list(zip(ids, ids[1:])), "star": [(150, i) for i in ids], "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "empty": []}[kind]  # noqa: B905
    edges = edges + [(7, 7), (None, 3), (3, None)] + edges[:5]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(frame, Scratch(spark)).collect()}
    assert got == brute(edges)
