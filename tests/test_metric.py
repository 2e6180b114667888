"""Cells of vectors: the same as comparing everything, and less of it where vectors have structure."""

import numpy as np
import pytest

from quernal.operators import metric

VECTORS, QUERIES = "vec_id long, embedding array<float>", "qid long, asked array<float>"


def brute(queries, vectors, k):
    out = set()
    unit = lambda v: np.array(v, float) / (np.linalg.norm(np.array(v, float)) or 1)
    kept = [(i, unit(v)) for i, v in vectors if v is not None]
    for q, v in queries:
        if v is not None:
            ranked = sorted((-round(float(unit(v) @ w), 9), i, float(unit(v) @ w)) for i, w in kept)[:k]
            out |= {(q, i, n + 1, round(s, 5) + 0.0) for n, (_, i, s) in enumerate(ranked)}
    return out


def got(found):
    return {(r.qid, r.vec_id, r["rank"], round(r.similarity, 5) + 0.0) for r in found.collect()}


@pytest.mark.parametrize("pivots", [1, 7, 256])
def test_cells_give_the_nearest(spark, monkeypatch, pivots):
    monkeypatch.setattr(metric, "BLOCK", 13)
    monkeypatch.setattr(metric, "ROWS", 16)
    rng = np.random.default_rng(pivots)
    points = [(rng.normal(size=6) + 4 * np.eye(6)[i % 6]).astype(np.float32).tolist() for i in range(300)]
    vectors = [*enumerate(points), *[(1000 + i, points[5]) for i in range(20)], (2000, [0.0] * 6), (2001, None), (2002, (2 * np.array(points[5])).tolist())]
    queries = [(i, v) for i, v in vectors[::11]] + [(3000, [0.0] * 6), (3001, None), (3002, points[5])]
    cells = metric.Cells(spark.createDataFrame(vectors, VECTORS), pivots)
    for k in (1, 10):
        assert got(cells.search(spark.createDataFrame(queries, QUERIES), k)) == brute(queries, vectors, k)
    many = cells.search(spark.createDataFrame(queries[:3], QUERIES), 400)
    assert many.count() == 3 * 322  # all there are


def test_structure_leaves_cells_out(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    points = [(centres[i % 40] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(4000)]
    vectors = list(enumerate(points))
    cells = metric.Cells(spark.createDataFrame(vectors, VECTORS), 64)
    assert got(cells.search(spark.createDataFrame(vectors[:40], QUERIES), 5)) == brute(vectors[:40], vectors, 5) and cells.share < 0.1


def test_no_vectors_and_no_queries(spark):
    none = spark.createDataFrame([], VECTORS)
    asked = spark.createDataFrame([(1, [1.0])], QUERIES)
    assert metric.knn(asked, none, 3).count() == 0
    one = spark.createDataFrame([(7, [2.0])], VECTORS)
    assert metric.knn(asked.limit(0), one, 3).count() == 0 and got(metric.knn(asked, one, 3)) == {(1, 7, 1, 1.0)}
    with pytest.raises(ValueError):
        metric.knn(asked, one, 0)
