"""Orders over whole tables by ranges, and quotas of classes of any size, against plain versions."""

import random

from tidewater.operators.evaluate import stratified_sample
from tidewater.operators.relational import cumulative_share, in_ranges


def plain_share(rows):
    known = sum(x for _, x in rows if x is not None)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    out = {}
    for rank, (key, x) in enumerate(order, 1):
        running = known if x is None else sum(y for _, y in rows if y is not None and y >= x)
        out[key] = (rank, running, round(running / known, 6))
    return out


def test_cumulative_share_with_ties_and_nulls(spark):
    draw = random.Random(1)
    rows = [(i, None if i % 50 == 0 else draw.choice([7, draw.randrange(1000)])) for i in range(3000)]
    found = cumulative_share(spark.createDataFrame(rows, "id long, x long"), ["id"], "x", "id").collect()
    assert {r["id"]: (r["rank"], r["running"], r["share"]) for r in found} == plain_share(rows)


def test_cumulative_share_of_nothing(spark):
    assert cumulative_share(spark.createDataFrame([], "id long, x long"), ["id"], "x", "id").count() == 0
    only = cumulative_share(spark.createDataFrame([(1, None)], "id long, x long"), ["id"], "x", "id").collect()
    assert [(r["rank"], r["running"]) for r in only] == [(1, None)]


def test_ranges_keep_equal_values_together(spark):
    rows = spark.createDataFrame([(i % 10,) for i in range(1000)], "x long")
    assert in_ranges(rows, rows["x"]).distinct().count() == 10


def test_quota_is_filled_for_a_class_of_any_size(spark):
    rows = [(f"m{i}", "hot" if i % 5 else "cold") for i in range(5000)]
    found = stratified_sample(spark.createDataFrame(rows, "id string, label string"), "label", 60)
    assert {r["label"]: r["count"] for r in found.groupBy("label").count().collect()} == {"hot": 48, "cold": 12}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
