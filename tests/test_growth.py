"""What grows with the input is dealt over more partitions and buckets, and shuffled once."""

from decimal import Decimal as D

import pytest

from tidewater.operators import quality as Q
from tidewater.operators import relational as R
from tidewater.plans import lending
from tidewater.sources import shared

SF = "/root/testdata/sf0.001"


def _plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partitions_grow_with_the_given_tables(spark, monkeypatch):
    held, before = 4_000, spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(lending, "PART_BYTES", held)
    m = lending.Models(spark, SF)
    size = sum(s for _, _, s in lending._stamps(spark, SF, lending.GROWING))
    assert m.parts == -(-size // held) > int(before)
    by_loan = m.status.groupBy("loan_id").count()
    assert "Exchange" not in _plan_of(by_loan) and by_loan.rdd.getNumPartitions() == m.parts and spark.conf.get("spark.sql.shuffle.partitions") == before
    assert sorted(m.status.collect()) == sorted(lending.models(spark, SF).status.collect())
    m._drop()


def test_excess_of_payments_needs_no_join_and_goes_over_loans(spark):
    laid = spark.createDataFrame([(1, 7, D(30)), (2, 7, D(30)), (2, 8, D(20)), (2, 8, D(1)), (3, 9, D(5))], "loan_id long, payment_id long, allocated decimal(18,2)")
    paid = spark.createDataFrame([(1, 7, D(50)), (2, 8, D(21)), (3, 9, D(4)), (4, 5, D(1))], "loan_id long, payment_id long, amount decimal(18,2)")
    for over in (0, 30):
        found = Q.allocation_excess(laid, paid, ["payment_id"], "amount", over)
        assert sorted(r["payment_id"] for r in found.collect()) == [7, 9] and "Join" not in _plan_of(found)  # 7 only with both its loans
    m = lending.models(spark, SF)
    by_payment = _plan_of(Q.allocation_excess(m.allocation, m.payments, ["payment_id"], "amount"))
    assert by_payment.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" not in _plan_of(Q.allocation_excess(m.allocation, m.installments, ["loan_id", "installment_number"], "amount_due"))


@pytest.mark.parametrize("cuts", [[3.0], [-1.0, 0.0, 2.5], [float(i) for i in range(R.PIECES + 1)], [0.0, float("nan")]])
def test_pieces_by_halving_are_those_by_counting(spark, cuts):
    values = sorted({v + d for v in cuts for d in (-0.5, 0.0, 0.5)} - {float("nan")}) + [float("nan"), float("inf"), float("-inf")]
    rows = R._in_pieces(spark.createDataFrame([(cuts, v) for v in values], "cuts array<double>, _v double"))
    counted = rows.selectExpr("_p", "size(filter(cuts, c -> c < _v)) + size(filter(cuts, c -> c <= _v)) as p")
    assert all(r["_p"] == r["p"] for r in counted.collect()) and "filter(" not in _plan_of(rows)


def test_store_keeps_rows_where_they_are_dealt(spark):
    from pyspark.sql import functions as F

    from tidewater.streaming.store import BucketStore

    rows = spark.range(1000).select(F.col("id").alias("loan_id"), (F.col("id") * 2).alias("x"))
    store = BucketStore(spark, "loan_id", {"t": rows.schema}, buckets=20)
    store.commit(0, {"t": rows}, list(range(20)))
    folder = [n for n in shared.names(spark, store.root) if n.startswith("data-")][0]
    files = {b: [n for n in shared.names(spark, f"{store.root}/{folder}/t/{b}") if n.startswith("part-")] for b in shared.names(spark, f"{store.root}/{folder}/t") if b.startswith("bucket=")}
    assert all(len(f) == 1 for f in files.values()) and len(files) > 15
    assert all(int(f[0][5:10]) == int(b[7:]) for b, f in files.items())  # a bucket is the partition of its number
    assert store.read("t").count() == 1000
