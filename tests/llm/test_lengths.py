"""Vectors of several lengths are each compared with those of their own."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import ann, nndescent


def _rows():
    rng = np.random.default_rng(9)
    rows, at = [], 0
    for dim, n in ((8, 120), (5, 40), (3, 2)):
        base = rng.normal(size=(n, dim))
        for v in base:
            rows.append((at, v.tolist()))
            at += 1
        for v in base[: n // 2]:
            rows.append((at, (v + rng.normal(size=dim) * 1e-3).tolist()))
            at += 1
    return rows


def test_links_within_each_length(spark):
    rows = _rows()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    cosine = lambda a, b: len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.95
    for i, v in rows:
        assert got[i][0] == sum(cosine(v, w) for j, w in rows if j != i)
    assert sum(n > 0 for n, _ in got.values()) >= 160


def test_search_within_each_length(spark):
    rows = _rows()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, k=5).collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    dims = {i: len(v) for i, v in rows}
    asked = [i for i, _ in rows if i % 20 == 0]
    assert set(found) == set(asked) and all(dims[j] == dims[i] for i in found for j in found[i])
    hits = total = 0
    for i in asked:
        own = [(-np.dot(dict(rows)[i], w), j) for j, w in rows if j != i and dims[j] == dims[i]]
        best = [j for _, j in sorted(own)[:5]]
        hits, total = hits + len(set(best) & set(found[i])), total + len(best)
    assert hits >= 0.9 * total
