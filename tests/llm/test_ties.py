"""Neighbours where far more vectors tie than are asked for."""

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import corpus

from edurank.llm import neighbours


def tied(kind):
    rng = np.random.default_rng(9)
    if kind == "signs":
        vectors = np.unique(rng.choice([-1.0, 1.0], (2500, 14)), axis=0)
    elif kind == "one-hot":
        vectors = np.eye(400) * rng.integers(1, 3, 400)[:, None]
    else:  # one id with many vectors of its own
        vectors = rng.integers(0, 3, (600, 8)).astype(float) + 1
    ids = rng.permutation(len(vectors))
    if kind == "own":
        ids[:200] = 0
    return [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]


@pytest.mark.parametrize("kind", ["signs", "one-hot", "own"])
def test_ties_go_to_the_smaller_id(spark, kind):
    rows = tied(kind)
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = [r for r in rows if r[0] % 50 == 0][:: 1 if kind != "own" else 400]
    points, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    expected = []
    for i, v in asked:
        score = neighbours.inner_products(points, np.array(v))
        distinct = sorted({(-float(s), int(j), tuple(p)) for s, j, p in zip(score, ids, points.tolist(), strict=True) if j != i})
        expected += [(i, n + 1, j, -s) for n, (s, j, _) in enumerate(distinct[:20])]
    queries = spark.createDataFrame(asked, vectors.schema)
    corpus.same(map(tuple, neighbours.nearest(vectors, queries).collect()), expected)
