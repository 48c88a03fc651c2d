"""Composite lending operators: change logs, payments, installments, delinquency, merchants.

All loan-keyed steps group and window by ``loan_id``, so Spark shuffles by it once and reuses the partitioning.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import business_date, clean_text, dpd_bucket, normalize_key, op_rank, parse_number, scale_minor_units, surrogate_key, trailing_id
from tidewater.operators.relational import as_rows, dense_grid, forward_fill, point_in_time, running_sum, series, swept
from tidewater.plans.params import PARAMS, EngineParams

OPEN_END = datetime.date(9999, 12, 31)
_D = "decimal(38,2)"


def cdc_partials(events: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """What a set of events tells of each application, in a form that adds up: maxima by each competing order, and counts."""
    real = F.when(F.col("customer_id_raw") != p.placeholder_id, F.col("customer_id_raw"))
    rank = op_rank(F.col("cdc_op"))
    told = ["status", "merchant_id", "requested_amount", "currency"]
    by_event = F.struct("event_at_utc", "ingested_at_utc", rank.alias("r"), real.isNotNull().alias("real"), "event_pk", *told)
    by_ingest = F.struct("ingested_at_utc", "event_at_utc", rank.alias("r"), real.isNotNull().alias("real"), "event_pk", *told)
    decided = F.when((F.col("cdc_op") != "D") & F.col("status").isin("APPROVED", "REJECTED"), F.col("event_at_utc"))
    return events.groupBy("application_id").agg(
        F.max(by_event).alias("by_event"), F.max(by_ingest).alias("by_ingest"), F.max(real).alias("customer_id"), F.min("event_at_utc").alias("created_at_utc"),
        F.max(decided).alias("decided_at_utc"), F.bool_or(F.col("cdc_op") == "D").alias("is_deleted"), F.count("*").alias("n_events"),
    )


def cdc_merged(partials: DataFrame) -> DataFrame:
    """Partials of several sets of events as those of all of them."""
    return partials.groupBy("application_id").agg(
        *[F.max(c).alias(c) for c in ("by_event", "by_ingest", "customer_id")], F.min("created_at_utc").alias("created_at_utc"), F.max("decided_at_utc").alias("decided_at_utc"),
        F.bool_or("is_deleted").alias("is_deleted"), F.sum("n_events").alias("n_events"),
    )


def cdc_resolved(partials: DataFrame) -> DataFrame:
    """Final state of each application."""
    status = F.col("by_event.status")
    return partials.select(
        "application_id", "customer_id", F.col("by_event.merchant_id").alias("merchant_id"), status.alias("status"), F.col("by_event.requested_amount").alias("requested_amount"), F.col("by_event.currency").alias("currency"),
        "created_at_utc", "decided_at_utc", "is_deleted", "n_events", (~F.col("is_deleted")).alias("is_valid"),
        (~F.col("is_deleted") & (status == "APPROVED")).alias("is_approved"), (status != F.col("by_ingest.status")).alias("is_out_of_order"),
        F.col("customer_id").isNull().alias("has_unresolved_customer"),
    )


def cdc_latest_state(events: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """Final state per application: event time, then ingest time, then op I < U < D, then a real customer before the placeholder.

    One aggregation by key: each competing order is a maximum over a struct, so no self-join and no window is needed. Any
    delete invalidates the application; a state that differs under ingest order marks it out of order.
    """
    return cdc_resolved(cdc_partials(events, p))


def loan_validity(loans: DataFrame, applications: DataFrame) -> DataFrame:
    """Every loan with a verdict on its application; nothing is dropped."""
    a = applications.select("application_id", "is_deleted", "is_approved", F.lit(True).alias("known"))
    reason = F.when(F.col("known").isNull(), "NO_APPLICATION").when(F.col("is_deleted"), "APPLICATION_DELETED").when(~F.col("is_approved"), "APPLICATION_NOT_APPROVED")
    joined = loans.join(a, "application_id", "left").withColumn("invalid_reason", reason)
    return joined.withColumn("is_valid_loan", F.col("invalid_reason").isNull()).drop("known", "is_deleted", "is_approved")


def staged_payments(payments: DataFrame) -> DataFrame:
    return payments.select(
        "payment_id", trailing_id(F.col("loan_ref")).alias("loan_id"), F.col("paid_at_utc").cast("timestamp_ntz").alias("paid_at_utc"),
        scale_minor_units(F.col("amount_raw"), F.col("source_system")).alias("amount"), "source_system", "status", "reversed_payment_id",
    )


def reversal_netting(staged: DataFrame) -> DataFrame:
    """EFFECTIVE, REVERSED_OUT or REVERSAL_ROW by set membership: a payment voided twice is taken out once."""
    voids = staged.where((F.col("status") == "REVERSED") & F.col("reversed_payment_id").isNotNull())
    voids = voids.groupBy(F.col("reversed_payment_id").alias("payment_id")).agg(
        F.count("*").alias("n_reversal_rows"), F.min("paid_at_utc").alias("first_reversed_at_utc"), F.sum("amount").cast("decimal(18,2)").alias("reversed_total")
    )
    kind = F.when(F.col("status") == "REVERSED", "REVERSAL_ROW").when(F.col("n_reversal_rows").isNotNull(), "REVERSED_OUT").otherwise("EFFECTIVE")
    return staged.join(voids, "payment_id", "left").withColumn("payment_class", kind).withColumn("n_reversal_rows", F.coalesce("n_reversal_rows", F.lit(0)))


def fx_daily_calendar(rates: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """Day by currency from the first rate to the last rate or the snapshot, the last published rate carried forward."""
    ends = rates.agg(F.min("rate_date").alias("a"), F.greatest(F.max("rate_date"), F.lit(p.snapshot_date)).alias("b"))
    days = ends.select(series(F.col("a"), F.col("b"), "day").alias("rate_date"))
    grid = dense_grid(rates.select("currency").distinct(), days)
    told = rates.select("currency", "rate_date", F.col("units_per_usd"), F.col("rate_date").alias("source_rate_date"))
    filled = forward_fill(
        grid.join(told, ["currency", "rate_date"], "left").withColumn("is_published", F.col("source_rate_date").isNotNull()),
        ["currency"], "rate_date", ["units_per_usd", "source_rate_date"],
    )
    return filled.withColumn("days_stale", F.datediff("rate_date", "source_rate_date"))


def usd(amount: str, rate: str) -> Column:
    """Four decimals, halves up; the margin keeps exact halves from falling by binary division."""
    return F.floor(F.col(amount).cast("double") / F.col(rate).cast("double") * 10000 + F.lit(0.5000001)).cast("double") / 10000


def _exact(c: Column) -> Column:
    """Exact sum of four-decimal amounts."""
    return F.sum(c.cast("decimal(18,4)")).cast("double")


def fx_asof(rows: DataFrame, calendar: DataFrame, day: str, rate: str) -> DataFrame:
    """The rate in force on a day; the calendar is dense, so this is an equi join on (currency, day)."""
    return rows.join(calendar.select("currency", F.col("rate_date").alias(day), F.col("units_per_usd").alias(rate)), ["currency", day], "left")


def effective_payments(netted: DataFrame, loans: DataFrame, calendar: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """Effective payments of the given (valid) loans, in USD at the payment day, with sequence and running total per loan."""
    kept = netted.where("payment_class = 'EFFECTIVE'").join(loans.select("loan_id", "currency"), "loan_id")
    dated = fx_asof(kept.withColumn("paid_date", business_date(F.col("paid_at_utc"), p.business_tz)), calendar, "paid_date", "fx_rate")
    order = [F.col("paid_at_utc"), F.col("payment_id")]
    numbered = dated.withColumn("payment_seq", F.row_number().over(Window.partitionBy("loan_id").orderBy(*order)))
    totals = running_sum(numbered, ["loan_id"], order, "amount", "cumulative_paid")
    return totals.select("payment_id", "loan_id", "currency", "paid_at_utc", "paid_date", "amount", usd("amount", "fx_rate").alias("amount_usd"), "payment_seq", "cumulative_paid")


def fifo_allocation(payments: DataFrame, installments: DataFrame) -> DataFrame:
    """Each payment's money laid over the plan by due date, then number; what is paid beyond the plan stays unallocated.

    Money and debt are running sums in exact decimals, each in its own order within a loan; a sweep over the ends of both gives each
    payment's share of each installment, in rows linear in payments and installments.
    """
    no_money, no_debt = F.lit(None).cast("struct<payment_id:long,paid_at_utc:timestamp_ntz,paid_date:date>"), F.lit(None).cast("int")
    paid = F.struct(F.col("payment_id").cast("long").alias("payment_id"), F.col("paid_at_utc").cast("timestamp_ntz").alias("paid_at_utc"), F.col("paid_date").alias("paid_date"))
    money = as_rows(
        payments.where("amount > 0"), "loan_id", side=F.lit(0), at=F.col("paid_at_utc").cast("timestamp_ntz"), id=F.col("payment_id").cast("long"),
        paid=F.col("amount").cast(_D), owed=F.lit(None).cast(_D), money=paid, debt=no_debt,
    )
    debt = as_rows(
        installments.where("amount_due > 0"), "loan_id", side=F.lit(1), at=F.col("due_date").cast("timestamp_ntz"), id=F.col("installment_number").cast("long"),
        paid=F.lit(None).cast(_D), owed=F.col("amount_due").cast(_D), money=no_money, debt=F.col("installment_number").cast("int"),
    )
    so_far = Window.partitionBy("loan_id").orderBy("side", "at", "id").rowsBetween(Window.unboundedPreceding, 0)  # money before debt; each adds up its own
    placed = money.unionByName(debt).withColumns({"_paid": F.sum("paid").over(so_far), "_owed": F.sum("owed").over(so_far)})
    placed = placed.withColumn("position", F.when(F.col("side") == 0, F.col("_paid")).otherwise(F.col("_owed")).cast(_D))
    met = swept(placed, "loan_id", "position", ["money", "debt"])
    part = (F.col("position") - F.col("below")).cast("decimal(18,2)")
    return met.select("loan_id", "money.payment_id", F.col("debt").alias("installment_number"), "money.paid_at_utc", "money.paid_date", part.alias("allocated"), (F.col("money_position") >= F.col("debt_position")).alias("completes"))


def installment_status(allocation: DataFrame, installments: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """Paid, remaining, settled, due, overdue and days past due as of the snapshot; ``_any`` columns ignore the cut.

    Plan and allocation meet in one aggregation by installment, so tables in buckets of the loan need neither join nor shuffle.
    """
    cut, zero = F.col("paid_date") <= F.lit(p.snapshot_date), F.lit(0).cast("decimal(18,2)")
    none = lambda kind: F.lit(None).cast(kind)
    plan = as_rows(installments, "loan_id", installment_number=F.col("installment_number").cast("int"), due_date=F.col("due_date"), amount_due=F.col("amount_due").cast("decimal(18,2)"), planned=F.lit(1),
                   paid_date=none("date"), allocated=none("decimal(18,2)"), completes=none("boolean"))
    laid = as_rows(allocation, "loan_id", installment_number=F.col("installment_number").cast("int"), due_date=none("date"), amount_due=none("decimal(18,2)"), planned=none("int"),
                   paid_date=F.col("paid_date"), allocated=F.col("allocated"), completes=F.col("completes"))
    parts = plan.unionByName(laid)
    rows = parts.groupBy("loan_id", "installment_number").agg(
        F.max("due_date").alias("due_date"), F.max("amount_due").alias("amount_due"), F.count("planned").alias("planned"),
        F.coalesce(F.sum(F.when(cut, F.col("allocated"))), zero).cast("decimal(18,2)").alias("paid"),
        F.coalesce(F.sum("allocated"), zero).cast("decimal(18,2)").alias("paid_any"), F.min(F.when(F.col("completes"), F.col("paid_date"))).alias("settled_date_any"),
    )
    rows = rows.where("planned > 0").drop("planned")
    rows = rows.withColumn("settled_date", F.when(F.col("settled_date_any") <= F.lit(p.snapshot_date), F.col("settled_date_any")))
    settled = F.col("settled_date").isNotNull()
    rows = rows.withColumns({
        "remaining": (F.col("amount_due") - F.col("paid")).cast("decimal(18,2)"), "is_settled": settled,
        "is_partial": ~settled & (F.col("paid") > 0), "is_due": F.col("due_date") <= F.lit(p.snapshot_date),
        "is_overdue": ~settled & (F.col("due_date") < F.lit(p.snapshot_date)),
    })
    late = F.datediff(F.coalesce("settled_date", F.lit(p.snapshot_date)), "due_date")
    return rows.withColumn("days_past_due", F.greatest(late, F.lit(0)))


def fpd30(status: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """First installments old enough to judge, and whether they went over thirty days past due."""
    ripe = (F.col("installment_number") == 1) & (F.col("due_date") <= F.date_sub(F.lit(p.snapshot_date), 30))
    return status.where("installment_number = 1").select("loan_id", "due_date", "days_past_due", ripe.alias("is_fpd_eligible"), (ripe & (F.col("days_past_due") > 30)).alias("is_fpd30"))


def delinquency_snapshot(status: DataFrame, payments: DataFrame, loans: DataFrame, calendar: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """One row per loan as of the snapshot day."""
    day = F.lit(p.snapshot_date)
    zero = F.lit(0).cast("decimal(18,2)")
    some = lambda c, v: F.coalesce(F.sum(F.when(c, v)), zero).cast("decimal(18,2)")
    open_, over = ~F.col("is_settled"), F.col("is_overdue")
    per = status.groupBy("loan_id").agg(
        F.count("*").alias("n_installments"), F.count_if("is_settled").alias("n_settled"), F.count_if(over).alias("n_overdue"),
        some(open_, F.col("amount_due")).alias("outstanding_gross"), some(open_, F.col("remaining")).alias("outstanding_net"),
        some(over, F.col("amount_due")).alias("overdue_gross"), F.min(F.when(over, F.col("due_date"))).alias("oldest_overdue"),
    )
    last = payments.where(F.col("paid_date") <= day).groupBy("loan_id").agg(F.max("paid_date").alias("last_paid"))
    rates = calendar.where(F.col("rate_date") == day).select("currency", F.col("units_per_usd").alias("snapshot_rate"))
    rows = loans.select("loan_id", "merchant_id", "currency", "disbursed_date").join(per, "loan_id").join(last, "loan_id", "left")
    rows = fx_asof(rows.join(rates, "currency", "left"), calendar, "disbursed_date", "disbursed_rate")
    dpd = F.coalesce(F.datediff(day, "oldest_overdue"), F.lit(0))
    state = F.when(F.col("n_settled") == F.col("n_installments"), "SETTLED").when(F.col("n_overdue") > 0, "DELINQUENT").otherwise("CURRENT")
    return rows.select(
        "loan_id", "merchant_id", "currency", "n_installments", "n_settled", "n_overdue", "outstanding_gross", "outstanding_net", "overdue_gross", "oldest_overdue",
        dpd.alias("dpd"), dpd_bucket(dpd).alias("dpd_bucket"), (dpd > 30).alias("is_par30"), state.alias("loan_status"),
        usd("outstanding_gross", "snapshot_rate").alias("outstanding_usd"), usd("outstanding_gross", "disbursed_rate").alias("outstanding_usd_disbursed"),
        F.datediff(day, "last_paid").alias("days_since_payment"),
    )


def month_end_series(status: DataFrame, loans: DataFrame, calendar: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """Loan by month end, from the month of disbursement to the snapshot, rebuilt from settlement days without re-allocation.

    Each installment sends signed events to the months in which something changes: its amount opens with the loan and closes in the month it is
    settled. Ordered by due date it is the oldest overdue one from the month after which all earlier ones are settled, or it is due, to the month it
    is settled itself; those spans never overlap, so each sends its due date at the start and nothing at the end. Sums and the last
    state so far over a loan's months give the series: rows are installments plus months, not their product. Loans without a plan have none.
    """
    first, last = F.trunc("disbursed_date", "month"), F.trunc(F.lit(p.snapshot_date), "month")
    spans = loans.select("loan_id", "currency", "merchant_id", first.alias("first"))
    never = F.lit(OPEN_END)
    plan = status.join(spans.select("loan_id", "first"), "loan_id")
    plan = plan.select(
        "loan_id", "first", "due_date", "amount_due", F.coalesce(F.trunc("settled_date_any", "month"), never).alias("closes"),
        F.greatest("first", F.trunc(F.date_add("due_date", 1), "month")).alias("late"), "installment_number",
    )
    earlier = Window.partitionBy("loan_id").orderBy(F.asc_nulls_last("due_date"), "installment_number").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumns({"starts": F.greatest("late", F.max("closes").over(earlier)), "closes": F.greatest("first", "closes")})
    zero = F.lit(0).cast("decimal(18,2)")
    none = lambda kind: F.lit(None).cast(kind)

    def row(month: Column, amount: Column = zero, n: int = 0, due: Column | None = None, ends: bool = False, currency: Column | None = None, merchant: Column | None = None) -> Column:
        """One row of the series: a month with what changes in it, or with the loan's own columns."""
        return F.struct(
            month.alias("month"), amount.cast("decimal(18,2)").alias("amount"), F.lit(n).alias("n"), (none("date") if due is None else due).alias("due"), F.lit(ends).alias("ends"),
            (none("string") if currency is None else currency).alias("currency"), (none("long") if merchant is None else merchant.cast("long")).alias("merchant_id"),
        )

    oldest = F.col("due_date").isNotNull() & (F.col("starts") < F.col("closes"))
    events = plan.select("loan_id", F.inline(F.filter(F.array(
        row(F.col("first"), F.col("amount_due"), 1), row(F.col("closes"), -F.col("amount_due")),
        row(F.when(oldest, F.col("starts")), due=F.col("due_date")), row(F.when(oldest, F.col("closes")), ends=True),
    ), lambda e: e["month"] <= last)))
    own = spans.where(F.col("first") <= last).select("loan_id", F.inline(F.array(F.struct(F.lit(True).alias("own"), row(F.col("first"), currency=F.col("currency"), merchant=F.col("merchant_id")).alias("r")))))
    changes = events.select("loan_id", F.lit(False).alias("own"), F.struct(*events.columns[1:]).alias("r"))
    dealt = own.unionByName(changes).repartition("loan_id")  # a loan's own row becomes its months only behind the shuffle, which carries installments and loans, not months
    months = F.transform(F.sequence("r.month", last, F.expr("interval 1 month")), lambda m: row(m, currency=F.col("r.currency"), merchant=F.col("r.merchant_id")))
    rows = dealt.select("loan_id", F.inline(F.when(F.col("own"), months).otherwise(F.array("r")))).groupBy("loan_id", "month").agg(
        F.max("currency").alias("currency"), F.max("merchant_id").alias("merchant_id"), F.coalesce(F.sum("amount"), zero).alias("change"), F.coalesce(F.sum("n"), F.lit(0)).alias("opened"),
        F.max("due").alias("due"), F.coalesce(F.bool_or("ends"), F.lit(False)).alias("ends"),
    )
    so_far = Window.partitionBy("loan_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(F.col("due").isNotNull() | F.col("ends"), F.struct("due")), ignorenulls=True).over(so_far)
    rows = rows.withColumns({"outstanding": F.sum("change").over(so_far).cast("decimal(18,2)"), "planned": F.sum("opened").over(so_far), "oldest_overdue": state["due"], "month_end": F.last_day("month")})
    dpd = F.coalesce(F.datediff("month_end", "oldest_overdue"), F.lit(0))
    rated = fx_asof(rows.where("planned > 0"), calendar, "month_end", "rate")
    return rated.select("loan_id", "merchant_id", "month_end", "outstanding", dpd.alias("dpd"), (dpd > 30).alias("is_par30"), usd("outstanding", "rate").alias("outstanding_usd"))


def scd2_from_history(history: DataFrame) -> DataFrame:
    """Versions with their validity, carried category and its origin, previous category and current name."""
    w = Window.partitionBy("merchant_id").orderBy("valid_from")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = F.last("category", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = history.withColumns({
        "valid_to": F.date_sub(F.lead("valid_from").over(w), 1), "version": F.row_number().over(w), "n_versions": F.count("*").over(whole),
        "carried": carried, "current_name": F.last("merchant_name").over(whole),
    })
    rows = rows.withColumn("category_filled", F.coalesce("carried", F.lit("UNKNOWN")))
    before = F.lag("category_filled").over(w)
    origin = F.when(F.col("category").isNotNull(), "OBSERVED").when(F.col("carried").isNotNull(), "CARRIED_FORWARD").otherwise("UNKNOWN")
    return rows.select(
        surrogate_key(F.col("merchant_id"), F.col("valid_from")).alias("merchant_sk"), "merchant_id", "merchant_name", "current_name", "country", "valid_from", "valid_to",
        F.coalesce("valid_to", F.lit(OPEN_END)).alias("valid_to_effective"), F.col("valid_to").isNull().alias("is_current"), "version", "n_versions",
        F.col("category_filled").alias("category"), origin.alias("category_origin"), before.alias("previous_category"),
        F.coalesce(before != F.col("category_filled"), F.lit(False)).alias("is_category_change"),
    )


def identity_collapse(customers: DataFrame, cities: DataFrame) -> DataFrame:
    """One row per document: attributes of its latest record, its ids, and whether they disagree.

    ``cities`` is a seed of city keys; Spark broadcasts it within its size threshold.
    """
    typed = customers.select(
        "customer_id", "document_number", "country", clean_text(F.col("city")).alias("city"), normalize_key(F.col("city")).alias("city_key"),
        F.when(F.col("birth_year") > 1900, F.col("birth_year")).alias("birth_year"), parse_number(F.col("monthly_income")).alias("income"), "created_at",
    )
    typed = typed.withColumn("income", F.when(F.col("income") >= 0, F.col("income")))
    last = F.max_by(F.struct("customer_id", "country", "city", "city_key", "birth_year", "income"), F.struct("created_at", "customer_id"))
    people = typed.groupBy("document_number").agg(
        last.alias("l"), F.count("*").alias("n_ids"), F.countDistinct("country").alias("n_countries"), F.countDistinct("birth_year").alias("n_birth_years"),
        F.array_join(F.sort_array(F.collect_list("customer_id")), ",").alias("customer_ids"),
    )
    people = people.join(cities.withColumnRenamed("city_key", "_k"), F.col("l.city_key") == F.col("_k"), "left")
    return people.select(
        surrogate_key(F.col("document_number")).alias("person_sk"), "document_number", F.col("l.customer_id").alias("latest_customer_id"), F.col("l.country").alias("country"),
        F.coalesce("city_name", "l.city").alias("city"), F.col("l.birth_year").alias("birth_year"), F.col("l.income").alias("income"),
        "n_ids", "customer_ids", ((F.col("n_countries") > 1) | (F.col("n_birth_years") > 1)).alias("has_conflict"),
    )


def customer_bridge(customers: DataFrame, people: DataFrame) -> DataFrame:
    keys = people.select("document_number", "person_sk", "latest_customer_id")
    return customers.select("customer_id", "document_number").join(keys, "document_number").select(
        "customer_id", "person_sk", "document_number", (F.col("customer_id") == F.col("latest_customer_id")).alias("is_person_latest_id")
    )


def loan_fact(loans: DataFrame, installments: DataFrame, calendar: DataFrame, merchants: DataFrame, bridge: DataFrame) -> DataFrame:
    """Loans with plan totals, USD at disbursement, the merchant's version of that day and the person behind the customer."""
    plan = installments.groupBy("loan_id").agg(
        F.count("*").alias("n_installments"), F.sum("amount_due").cast("decimal(18,2)").alias("plan_total"), F.min("due_date").alias("first_due"), F.max("due_date").alias("last_due")
    )
    rows = fx_asof(loans.join(plan, "loan_id", "left"), calendar, "disbursed_date", "fx_rate")
    versions = merchants.select("merchant_id", "merchant_sk", "category", "valid_from", "valid_to_effective")
    rows = point_in_time(rows, versions, "merchant_id", F.col("disbursed_date"))
    people = bridge.select("customer_id", "person_sk")
    return rows.join(people, "customer_id", "left").select(
        "loan_id", "application_id", "customer_id", "person_sk", "merchant_id", "merchant_sk", "category", "currency", "principal",
        usd("principal", "fx_rate").alias("principal_usd"), "disbursed_date", F.trunc("disbursed_date", "month").alias("cohort_month"),
        "n_installments", "plan_total", "first_due", "last_due",
    )


def merchant_monthly(facts: DataFrame, applications: DataFrame, first_payment: DataFrame, snapshot: DataFrame, month_ends: DataFrame, merchants: DataFrame, p: EngineParams = PARAMS) -> DataFrame:
    """Dense merchant by month, from the first month with activity in which the merchant exists.

    Applications (also deleted ones), loans and GMV count in their month; FPD30 and PAR30 of the cohort as of the snapshot stand in the month of disbursement; balances and PAR30
    stock, and the category, at the month end. Each measure is aggregated to (merchant, month) before it meets the grid; amounts are exact sums.
    """
    app_month = F.trunc(business_date(F.col("created_at_utc"), p.business_tz), "month")
    dated = applications.withColumn("month", app_month)
    apps = dated.groupBy("merchant_id", "month").agg(F.count_if("is_valid").alias("applications"), F.count_if("is_approved").alias("approved"), F.count_if("is_deleted").alias("deleted"))
    due = lambda c: F.when(F.col("is_par30"), F.col(c)).otherwise(0)
    cohort = facts.select("loan_id", "merchant_id", "principal_usd", F.col("cohort_month").alias("month"))
    cohort = cohort.join(first_payment.select("loan_id", "is_fpd_eligible", "is_fpd30"), "loan_id", "left").join(snapshot.select("loan_id", "outstanding_usd", "is_par30"), "loan_id", "left")
    cohort = cohort.groupBy("merchant_id", "month").agg(
        F.count("*").alias("loans"), _exact(F.col("principal_usd")).alias("gmv_usd"), F.count_if("is_fpd_eligible").alias("fpd_eligible"), F.count_if("is_fpd30").alias("fpd30"),
        _exact(F.col("outstanding_usd")).alias("cohort_outstanding_usd"), _exact(due("outstanding_usd")).alias("cohort_par30_usd"),
    )
    stock = month_ends.groupBy("merchant_id", F.trunc("month_end", "month").alias("month")).agg(
        F.count_if(F.col("outstanding") > 0).alias("loans_with_balance"), F.count_if("is_par30").alias("loans_par30"),
        _exact(F.col("outstanding_usd")).alias("outstanding_usd"), _exact(due("outstanding_usd")).alias("par30_usd"),
    )
    ends = facts.agg(F.min("cohort_month").alias("a"), F.greatest(F.max("cohort_month"), F.trunc(F.lit(p.snapshot_date), "month")).alias("b"))
    ends = ends.crossJoin(dated.where("is_valid").agg(F.min("month").alias("c"))).select(F.least("a", "c").alias("a"), "b")
    months = ends.select(series(F.col("a"), F.col("b"), "month").alias("month"))
    grid = dense_grid(merchants.groupBy("merchant_id").agg(F.min("valid_from").alias("_since")), months).withColumn("month_end", F.last_day("month")).where("month_end >= _since").drop("_since")
    for measure in (apps, cohort, stock):
        grid = grid.join(measure, ["merchant_id", "month"], "left")
    versions = merchants.select("merchant_id", "category", "country", F.col("current_name").alias("merchant_name"), "valid_from", "valid_to_effective")
    grid = point_in_time(grid, versions, "merchant_id", F.col("month_end")).drop("valid_from", "valid_to_effective")
    at_start = merchants.select("merchant_id", F.col("category").alias("category_start"), "valid_from", "valid_to_effective")
    grid = point_in_time(grid, at_start, "merchant_id", F.col("month")).drop("valid_from", "valid_to_effective")
    n = {c: F.coalesce(c, F.lit(0)) for c in ("applications", "approved", "deleted", "loans", "fpd_eligible", "fpd30", "loans_with_balance", "loans_par30")}
    money = {c: F.coalesce(c, F.lit(0.0)) for c in ("gmv_usd", "outstanding_usd", "par30_usd", "cohort_outstanding_usd", "cohort_par30_usd")}
    grid = grid.withColumns(n | money)
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a).cast("double") / F.col(b).cast("double"), 6))
    return grid.select(
        "merchant_id", "month", "merchant_name", "country", "category", "category_start", "applications", "approved", "deleted", share("approved", "applications").alias("approval_rate"), "loans", "gmv_usd",
        "fpd_eligible", "fpd30", share("fpd30", "fpd_eligible").alias("fpd30_rate"), "loans_with_balance", "loans_par30", "outstanding_usd", "par30_usd", share("par30_usd", "outstanding_usd").alias("par30_rate"),
        "cohort_outstanding_usd", "cohort_par30_usd", share("cohort_par30_usd", "cohort_outstanding_usd").alias("par30_cohort_rate"),
        F.coalesce(F.col("category") != F.col("category_start"), F.lit(False)).alias("is_category_change"), (F.col("applications") + F.col("loans") + F.col("loans_with_balance") > 0).alias("is_active"),
    )
