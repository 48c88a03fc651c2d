"""Streams into bucket stores: any order, replay, crashes, late events, and files that stay bounded."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tidewater.operators.lending import cdc_latest_state, fifo_allocation
from tidewater.plans import lending as plans
from tidewater.sources import shared
from tidewater.streaming import store, streams

EVENTS = "event_pk long, application_id long, customer_id_raw long, merchant_id long, status string, requested_amount decimal(18,2), cdc_op string, event_at_utc timestamp_ntz, ingested_at_utc timestamp_ntz, currency string"


@pytest.fixture(scope="module")
def events(spark):
    draw = random.Random(8)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randrange(400))
    rows = [(i, draw.randrange(60), draw.choice([999999999, 5, 6]), draw.choice([1, 2]), draw.choice(["CREATED", "APPROVED", "REJECTED"]), D(i), draw.choice("IUUUUUD"), at(), at(), draw.choice(["COP", "BRL"])) for i in range(400)]
    return spark.createDataFrame(rows, EVENTS).repartition(1).cache()


def batches(events, n):
    return [events.where(F.col("event_pk") * 7 % n == i) for i in range(n)]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_upsert_any_order_and_replay(spark, events):
    upsert = streams.Upsert(spark, buckets=4)
    parts = batches(events, 6)
    for i, part in enumerate(parts):
        upsert(part, i)
        upsert(parts[0], max(0, i - 1))  # again, and an old one with other rows
    assert rows_of(upsert.state()) == rows_of(cdc_latest_state(events))
    left = shared.names(spark, upsert.store.root)
    assert [n for n in left if n.startswith("manifest")] == ["manifest-000000000004", "manifest-000000000005"]
    assert len([n for n in left if n.startswith("data-")]) <= 2 * 4 and not [n for n in left if n.startswith("aside-")]
    assert upsert.state().count() == events.select("application_id").distinct().count()


def test_untouched_buckets_stay(spark, events):
    upsert = streams.Upsert(spark, buckets=8)
    upsert(events, 0)
    before = upsert.store._folders()
    one = events.where("application_id = 7")
    upsert(one, 1)
    changed = {k for k, f in upsert.store._folders().items() if before.get(k) != f}
    assert changed == {(b, "partials") for b in upsert.store.touched(one)} and len(changed) == 1


@pytest.mark.parametrize("at", ["rename", "repartition"])
def test_crash_before_the_manifest(spark, events, monkeypatch, at):
    upsert, (a, b) = streams.Upsert(spark, buckets=3), batches(events, 2)
    upsert(a, 0)
    seen = rows_of(upsert.state())

    def dies(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        patch.setattr(store, "rename", dies) if at == "rename" else patch.setattr(streams.BucketStore, "commit", dies)
        with pytest.raises(RuntimeError):
            upsert(b, 1)
    assert rows_of(upsert.state()) == seen
    again = streams.Upsert(spark, buckets=3, root=upsert.store.root)  # a new driver over the same folder
    again(b, 1)
    again(b, 1)
    assert rows_of(again.state()) == rows_of(cdc_latest_state(events))
    assert not [n for n in shared.names(spark, again.store.root) if n.startswith("aside-")]


def test_lookback(spark, events):
    upsert = streams.Upsert(spark, lookback="10 days")
    newest, old = events.where("event_at_utc >= timestamp_ntz'2024-01-10'"), events.where("event_at_utc < timestamp_ntz'2024-01-10'")
    upsert(newest, 0)
    upsert(old, 1)
    limit = F.lit(newest.agg(F.max("event_at_utc")).first()[0] - dt.timedelta(days=10)).cast("timestamp_ntz")
    late, kept = old.where(F.col("event_at_utc") < limit), old.where(F.col("event_at_utc") >= limit)
    assert rows_of(upsert.late()) == rows_of(late) and late.count() > 0 < kept.count()
    assert rows_of(upsert.state()) == rows_of(cdc_latest_state(newest.unionByName(kept)))


def test_fifo_stream(spark):
    draw = random.Random(5)
    day = lambda: dt.datetime(1998, 1, 1) + dt.timedelta(hours=draw.randrange(8000))
    money = [(loan, loan * 100 + i, t, t.date(), D(draw.choice([0, 40, 75, 120]))) for loan in range(40) for i in range(draw.randrange(6)) for t in [day()]]
    plan = spark.createDataFrame([(loan, i + 1, day().date(), D(draw.choice([50, 80]))) for loan in range(40) for i in range(draw.randrange(5))], "loan_id long, installment_number int, due_date date, amount_due decimal(18,2)")
    payments = spark.createDataFrame(money, "loan_id long, payment_id long, paid_at_utc timestamp_ntz, paid_date date, amount decimal(18,2)")
    laid = streams.FifoStream(spark, plan, buckets=4)
    streams.drain(streams.as_stream(spark, payments.orderBy(F.rand(1)), files=5), laid)
    assert rows_of(laid.allocation()) == rows_of(fifo_allocation(payments, plan)) and laid.allocation().count() > 30
    laid(payments.where("loan_id < 9"), 99)  # the same payments under a new batch count once
    assert rows_of(laid.allocation()) == rows_of(fifo_allocation(payments, plan))
    assert len([n for n in shared.names(spark, laid.store.root) if n.startswith("manifest")]) == 2


def test_models_are_built_again_when_their_tables_are_gone(spark):
    sf = "/root/testdata/sf0.001"
    first = plans.models(spark, sf)
    n = first.fx_loans.count()
    assert plans.models(spark, sf) is first
    shared.drop_path(spark, first._paths["fx_loans"])
    again = plans.models(spark, sf)
    assert again is not first and again.fx_loans.count() == n
