"""Recall of the nearest-neighbour search, and the share of rows it compares, on tables of 20,000 vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import ann

N, K = 20_000, 20


def _vectors(clustered):
    rng = np.random.default_rng(3)
    if not clustered:
        return rng.normal(size=(N, 24))
    centers = rng.normal(size=(200, 24)) * 3
    return centers[rng.integers(0, 200, N)] + rng.normal(size=(N, 24)) * 0.3


@pytest.mark.parametrize("clustered", [True, False])
def test_recall(spark, clustered):
    x = _vectors(clustered)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    found = {}
    for r in ann.search(rows, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, N, 50):
        scores = x @ x[q]
        scores[q] = -np.inf
        assert len(found[q]) == K
        hits += len(set(found[q]) & set(np.argpartition(-scores, K)[:K].tolist()))
    assert hits >= 0.9 * K * (N // 50)
