"""Links that full lists have no room for."""

import numpy as np
from pyspark.sql import functions as F

from tidewater.llm import nndescent


def _tight(rng, centre, n, spread):
    rows = centre + spread * rng.normal(size=(n, len(centre)))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def test_full_lists_hide_no_links(spark, monkeypatch):
    """Groups of far more vectors than a list holds, whose links with each other rank below those inside; no audit helps."""
    monkeypatch.setattr(nndescent, "audit", lambda vectors, *_: vectors.where("false").select(F.col("id").alias("a"), F.col("id").alias("b")))
    rng, dim = np.random.default_rng(7), 32
    first = np.eye(dim)[0]
    rows = []
    for step in range(4):  # a chain of groups, neighbours at about 0.96, inner pairs above 0.99
        angle = step * np.arccos(0.962)
        rows.append(_tight(rng, np.cos(angle) * first + np.sin(angle) * np.eye(dim)[1], 300 if step == 2 else 40, 0.01))
    rows.append(_tight(rng, np.eye(dim)[5], 60, 0.01))
    vecs = np.vstack([*rows, rng.normal(size=(300, dim))])
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(df).collect()}
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(near.sum(axis=1).tolist()))
    assert {got[i][1] for i in range(420)} == {0} and {got[i][1] for i in range(420, 480)} == {420}
