"""What goes through shuffles and into the shared folder."""

import datetime as dt
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from tidewater.operators import lending, messages
from tidewater.sources.shared import new_path, written, written_in_buckets


def _series(spark):
    status = spark.createDataFrame(
        [(1, 1, dt.date(1998, 10, 5), D(10), None), (2, 1, dt.date(1998, 10, 5), D(20), dt.date(1998, 11, 2)), (2, 2, dt.date(1998, 11, 5), D(5), None)],
        "loan_id long, installment_number int, due_date date, amount_due decimal(18,2), settled_date_any date",
    )
    loans = spark.createDataFrame([(1, None, 7, dt.date(1998, 10, 1)), (2, "COP", 8, dt.date(1998, 10, 1)), (3, "COP", 8, dt.date(1998, 10, 1))], "loan_id long, currency string, merchant_id long, disbursed_date date")
    rates = spark.createDataFrame([(dt.date(1998, m, d), "COP", D(1)) for m, d in ((10, 31), (11, 30), (12, 31))], "rate_date date, currency string, units_per_usd decimal(18,6)")
    return lending.month_end_series(status, loans, rates)


def test_months_are_made_behind_the_shuffle(spark):
    df = _series(spark)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" in plan.split("RepartitionByExpression")[0] and "sequence(" not in plan.split("RepartitionByExpression")[1]
    got = [(r["loan_id"], r["merchant_id"], r["month_end"].month, int(r["outstanding"]), r["dpd"]) for r in df.orderBy("loan_id", "month_end").collect()]
    assert got == [(1, 7, 10, 10, 26), (1, 7, 11, 10, 56), (1, 7, 12, 10, 87), (2, 8, 10, 25, 26), (2, 8, 11, 5, 25), (2, 8, 12, 5, 56)]


def test_shared_tables_are_zstd(spark):
    rows = spark.range(100).withColumnRenamed("id", "loan_id")
    paths = [new_path(spark, "plain"), new_path(spark, "bucketed")]
    written(rows, "plain", paths[0])
    written_in_buckets(rows, "bucketed", "loan_id", paths[1])
    files = [f for p in paths for f in os.listdir(p.removeprefix("file:")) if f.endswith(".parquet")]
    assert files and all("zstd" in f for f in files)


def test_pairs_are_judged_where_they_meet(spark):
    """Only pairs at the threshold leave a bucket, each once, and no set is joined to a pair afterwards."""
    shared = [f"w{i}" for i in range(9)]
    rows = [(f"a{k}", shared + [f"x{k}"]) for k in range(30)] + [(f"b{k}", shared[:2] + [f"y{k}{i}" for i in range(5)]) for k in range(30)]
    sets = spark.createDataFrame(rows, "rep string, tokens array<string>")
    ordered = messages.prefix_sets(sets, 0.6)
    for block in (500, 7):
        met = messages.met_in_buckets(ordered.select("rep", "n", "tokens", "prefix", F.explode("buckets").alias("bucket")), 0.6, block)
        assert sorted((r["a"], r["b"], r["jaccard"]) for r in met.collect()) == sorted((a, b, round(9 / 11, 6)) for a, _ in rows[:30] for b, _ in rows[:30] if a < b)
        plan = met._jdf.queryExecution().optimizedPlan().toString()
        assert "tokens_x" in plan and "Aggregate [a#" not in plan
