"""The inverted file: exact at full probing, its recall, filters inside the probe, copies and odd vectors."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import retrieval, serve, vectors
from quern.session import scratch

POINTS = "point_id long, vec array<double>, tenant int"


@pytest.fixture(scope="module")
def points(spark):
    """Vectors around twelve centres, a third of all rows one vector, and odd ones."""
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 12]], i % 3) for i in range(900)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(450)]
    rows += [(2000, None, 0), (2050, [], 0), (2001, [1.0, 2.0], 0), (2002, [0.0] * 16, 0), (2003, [None] * 16, 0)]
    return spark.createDataFrame(rows, POINTS).repartition(3)


def asks(points):
    return points.where("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), F.col("vec").alias("qvec"), "tenant")


def rows(found):
    return sorted((r["query_id"], r["rank"], r["point_id"], round(r["score"], 9)) for r in found.collect())


@pytest.mark.parametrize("most", [4096, 7])
def test_all_cells_give_the_exact_search(spark, points, monkeypatch, most):
    monkeypatch.setattr(retrieval, "MOST_QUERIES", most)
    index = vectors.VectorIndex.build(points, scratch(spark, "v"), columns=("tenant",))
    assert len(index.sizes) > 10 and sum(index.sizes.values()) == points.count()
    found = index.search(asks(points), 10, 1.0)
    assert rows(found) == rows(retrieval.topk(points, asks(points), 10)) and index.read == points.count()
    own = index.search(asks(points), 10, 1.0, same="tenant")
    assert rows(own) == rows(retrieval.topk(points, asks(points), 10, same="tenant"))
    again = vectors.VectorIndex(spark, index.root)  # tables outlive the object
    assert rows(again.search(asks(points), 10, 1.0)) == rows(found)


def test_calibrated_recall_and_points_read(spark, points):
    live = points.where("point_id < 1000")
    index = vectors.VectorIndex.build(live, scratch(spark, "v"))
    share = index.calibrate(asks(live), 10, 0.95)
    exact = {r[::2] for r in rows(retrieval.topk(live, asks(live), 10))}
    got = {r[::2] for r in rows(index.search(asks(live), 10, share))}
    assert len(got & exact) >= 0.95 * len(exact) and share < 0.6 and index.read < 0.6 * live.count()
    assert len({r[::2] for r in rows(serve.approximate_topk(live, asks(live), 10))} & exact) >= 0.95 * len(exact)


def test_rare_points_are_found_by_reading_more_cells(spark, points):
    marked = points.withColumn("rare", F.col("point_id") % 101 == 0)
    index = vectors.VectorIndex.build(marked, scratch(spark, "v"), columns=("rare",))
    found = index.search(asks(points), 5, 0.05, where=F.col("rare"))
    # A query stops once it has five, so it may miss a better one; with fewer than five left all cells are read.
    assert {r["n"] for r in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {5}
    assert found.join(marked.where("rare"), "point_id", "left_anti").count() == 0
    few = index.search(asks(points), 50, 0.05, where=F.col("rare"))
    want = retrieval.topk(marked.where("rare"), asks(points), 50)
    assert rows(few) == rows(want) and index.read > 0.9 * points.count()


def test_empty_index_and_no_queries(spark, points):
    none = points.limit(0)
    assert vectors.VectorIndex.build(none, scratch(spark, "v")).search(asks(points), 3, 0.5).count() == 0
    index = vectors.VectorIndex.build(points.where("point_id = 2000"), scratch(spark, "v"))
    assert index.search(asks(points).limit(0), 3, 0.5).count() == 0 and index.search(asks(points), 3, 0.5).count() > 0


def test_codes_bound_scores():
    r = np.random.default_rng(1)
    u = r.normal(size=(200, 24))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    c = vectors.centres(u, 9)
    near = np.argmax(u @ c.T, 1)
    codes, scale = vectors.code(u, near, c)
    q = u[:20]
    about = (codes.astype(float) @ q.T) * scale[:, None] + np.einsum("ij,kj->ik", c[near], q)
    assert (np.abs(about - u @ q.T) <= 0.5 * scale[:, None] * np.abs(q).sum(1)[None, :] + 1e-9).all()
