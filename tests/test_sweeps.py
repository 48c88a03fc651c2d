"""Sweeps, deltas and selections against plain versions, and the plans they are there for."""

import datetime as dt
import math
import random
import statistics
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewater.operators import lending, relational


def _plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def loans(spark):
    """Payments and installments of random loans: equal times, equal due dates, zero amounts, ends that coincide, over- and underpayment."""
    draw = random.Random(4)
    paid, due = [], []
    for loan in range(120):
        for i in range(draw.randrange(6)):
            due.append((loan, i + 1, dt.date(1998, 1, 1) + dt.timedelta(draw.choice([29, 30, 58, 89, 119, 120, draw.randrange(365)])), D(draw.choice([0, 50, 100, "33.33"]))))
        for i in range(draw.randrange(6)):
            day = dt.datetime(1998, 1 + draw.randrange(12), 1 + draw.randrange(28), draw.randrange(2))
            paid.append((loan, loan * 100 + i, day, day.date(), D(draw.choice([0, 50, 100, 150, "66.67"]))))
    payments = spark.createDataFrame(paid, "loan_id long, payment_id long, paid_at_utc timestamp_ntz, paid_date date, amount decimal(18,2)")
    return payments, spark.createDataFrame(due, "loan_id long, installment_number int, due_date date, amount_due decimal(18,2)"), paid, due


def test_sweep_equals_the_overlap_join(spark, loans):
    payments, plan, _, _ = loans
    money = payments.where("amount > 0")
    money = relational.running_sum(money, ["loan_id"], [F.col("paid_at_utc"), F.col("payment_id")], "amount", "a_end").withColumn("a_start", F.col("a_end") - F.col("amount"))
    debt = relational.running_sum(plan.where("amount_due > 0"), ["loan_id"], [F.col("due_date"), F.col("installment_number")], "amount_due", "b_end").withColumn("b_start", F.col("b_end") - F.col("amount_due"))
    joined = relational.overlap(money, debt, "loan_id").selectExpr("loan_id", "payment_id", "installment_number", "cast(least(a_end, b_end) - greatest(a_start, b_start) as decimal(18,2))", "a_end >= b_end")
    laid = lending.fifo_allocation(payments, plan)
    got = laid.select("loan_id", "payment_id", "installment_number", "allocated", "completes").collect()
    assert len(got) > 100 and sorted(map(tuple, got)) == sorted(map(tuple, joined.collect()))
    assert "Join" not in _plan_of(laid) and _plan_of(laid).count("Exchange hashpartitioning") == 1


def test_month_ends_by_deltas(spark, loans):
    payments, plan, _, due = loans
    status = lending.installment_status(lending.fifo_allocation(payments, plan), plan)
    draw = random.Random(1)
    own = [(i, "COP", i % 7, dt.date(1998, 1 + draw.randrange(12), 1 + draw.randrange(28))) for i in range(120)]
    rates = spark.createDataFrame([(dt.date(1997, 12, 25), "COP", D(4))], "rate_date date, currency string, units_per_usd decimal(18,6)")
    series = lending.month_end_series(status, spark.createDataFrame(own, "loan_id long, currency string, merchant_id int, disbursed_date date"), lending.fx_daily_calendar(rates))
    settled = {(r["loan_id"], r["installment_number"]): r["settled_date_any"] for r in status.collect()}
    expected = set()
    for loan, _, merchant, day in own:
        plan_of = [(d, a, settled[loan, n]) for i, n, d, a in due if i == loan]
        for month in range(day.month, 13) if plan_of else ():
            end = dt.date(1998, month + 1, 1) - dt.timedelta(1) if month < 12 else dt.date(1998, 12, 31)
            open_ = [(d, a) for d, a, s in plan_of if s is None or s > end]
            oldest = min((d for d, _ in open_ if d < end), default=None)
            days = (end - oldest).days if oldest else 0
            expected.add((loan, merchant, end, sum((a for _, a in open_), D(0)), days, days > 30))
    got = [tuple(r)[:6] for r in series.collect()]
    assert len(got) == len(expected) > 300 and set(got) == expected
    assert any(r[4] for r in got)


def test_selection_equals_an_ordered_list(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["hot", "hot", "hot", "a", None]), draw.choice([None, 7.5, 7.5, draw.random() * 10 ** draw.randrange(-3, 6), float(draw.randrange(5))])) for _ in range(4000)]
    rows += [("one", 1.0), ("same", 3.0), ("same", 3.0), ("nothing", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "max": 1.0}
    expected = {k: (len(x), *[sorted(x)[max(1, math.ceil(len(x) * s)) - 1] for s in shares.values()]) for k, x in by_key.items()}
    for held in (relational.HELD, 40, 1):
        assert {r["k"]: tuple(r)[1:] for r in relational.nearest_rank(df, ["k"], "v", shares, held).collect()} == expected
    assert {r["k"]: r["med"] for r in relational.median(df, ["k"], "v", held=50).collect()} == {k: statistics.median(x) for k, x in by_key.items()}
    assert relational.nearest_rank(df.where("false"), ["k"], "v", shares).count() == 0


def test_selection_joins_many_groups(spark):
    df = spark.range(3000).selectExpr("id % 600 as k", "id * 7919 % 1000 as v")
    ranks = {"a": F.lit(1), "b": F.col("n")}
    few, many = (sorted(map(tuple, relational.at_ranks(df, ["k"], "v", ranks, held=2, sent=s).collect())) for s in (10_000, 5))
    assert few == many == sorted((k, 5, max(x), min(x), max(x)) for k in range(600) for x in [[i * 7919 % 1000 for i in range(k, 3000, 600)]])


def test_overlaps_by_running_maximum(spark):
    draw = random.Random(6)
    day = lambda n: dt.date(1998, 1, 1) + dt.timedelta(n)
    rows = []
    for key in range(60):
        for i in range(draw.randrange(8)):
            a = draw.randrange(60)
            rows.append((key, f"{key}-{i}", day(a), day(a + draw.randrange(12))))
    found = relational.overlapping_versions(spark.createDataFrame(rows, "k int, sk string, valid_from date, valid_to_effective date"), "k", "sk")
    expected = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3])
    assert sorted((r["k"], r["sk_a"], r["sk_b"]) for r in found.collect()) == expected and len(expected) > 20


def test_layers_meet_by_loan_without_a_shuffle(spark):
    """Over tables in buckets of the loan, FIFO, status and snapshot deal no rows anew and the series once; sides of any size, so no broadcast either."""
    from tidewater.plans import lending as plans

    m = plans.models(spark, "/root/testdata/sf0.001")
    written = {n: getattr(m, n) for n in plans.BY_LOAN}
    assert {spark.catalog.getTable(str(n)).tableType for n in [t.name for t in spark.catalog.listTables()] if n.startswith("tidewater_")} == {"EXTERNAL"}
    few = lending.fx_daily_calendar(spark.createDataFrame([(dt.date(1998, 1, 1), "COP", D(1))], "rate_date date, currency string, units_per_usd decimal(18,6)")).limit(1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = {
            "fifo": lending.fifo_allocation(written["payments"], written["fx_installments"]),
            "status": lending.installment_status(written["allocation"], written["fx_installments"]),
            "installments": written["fx_installments"].join(written["loans"].select("loan_id"), "loan_id", "left_semi"),
            "first payments": lending.fpd30(written["status"]),
        }
        counts = {n: _plan_of(df).count("Exchange hashpartitioning") for n, df in made.items()}
        rated = {"series": lending.month_end_series(written["status"], written["loans"], few), "snapshot": lending.delinquency_snapshot(written["status"], written["payments"], written["loans"], few)}
        by_loan = {n: _plan_of(df).count("Exchange hashpartitioning(loan_id") for n, df in rated.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert counts == dict.fromkeys(made, 0) and by_loan == {"series": 1, "snapshot": 0}
