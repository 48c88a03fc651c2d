"""Nearest neighbours among many equal scores, and from lists that hold few rows."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import ann


def test_top_ties_go_to_smaller_id():
    rng = np.random.default_rng(1)
    vecs = np.vstack([np.tile(rng.normal(size=24), (300, 1)), rng.normal(size=(50, 24)) * 0.01])
    ids = rng.permutation(len(vecs))
    asked = np.vstack([vecs[0], -vecs[0]])
    at, column, _ = ann.top(asked @ vecs.T, asked, vecs, ids, 20)
    assert sorted(ids[column[at == 0]]) == sorted(ids[:300])[:20]


def test_copies_across_blocks_give_smallest_ids(spark):
    rng = np.random.default_rng(2)
    copied, rows = rng.normal(size=16), [(int(i), rng.normal(size=16).tolist()) for i in range(3000, 3300)]
    rows += [(int(i), copied.tolist()) for i in rng.permutation(3000)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 2999).collect()
    assert sorted(r["vec_id"] for r in found) == list(range(20))


def test_search_goes_on_until_lists_hold_enough():
    points = np.vstack([np.eye(8), [[0.9, 0.1, 0, 0, 0, 0, 0, 0]]])
    links = [np.array([j for j in range(9) if j != i]) for i in range(9)]
    held = np.array([1, 5, 5, 5, 5, 5, 5, 5, 2])
    lists = ann.Centroids(points, links).search(points[0], 1.2, held, 21)
    assert held[lists].sum() >= 21 and {0, 8} <= set(lists)


def test_outlier_that_is_its_own_centroid_gets_k(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(1500, 16)) * 0.05 + np.eye(16)[0]
    rows = np.vstack([rows, -np.eye(16)[:1]])
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    assert ann.search(table, F.col("vec_id") == 1500).count() == 20
