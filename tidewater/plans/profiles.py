"""Profiles of the inputs and models, in statements that Spark and DuckDB both read.

A profile is parts; a part is a source and the metrics over it, taken in one aggregation, so each source is read once and summed up in every task.
Medians go through exact selection, as one group may hold most rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import quality as Q
from tidewater.operators import relational as R
from tidewater.plans.lending import Models, models
from tidewater.sources.oracle import statement
from tidewater.sources.shared import dealt_over, written

MADE: dict = {}


def bound(m: Models, text: str) -> DataFrame:
    """A statement over ``fx_`` views and ``d_`` models with these in place of their names."""
    used: dict[str, DataFrame] = {}

    def place(word: re.Match) -> str:
        used[word[0]] = getattr(m, word[0] if word[0].startswith("fx_") else word[0][2:])
        return "{" + word[0] + "}"

    return m.spark.sql(re.sub(r"\b(?:fx|d)_\w+\b", place, text), **used)


def _one(source: str, metrics: dict[str, str]) -> str:
    return "select " + ", ".join(f"cast({e} as double) as m{i}" for i, e in enumerate(metrics.values())) + f" from ({source}) s"


def profile(name: str, *parts: tuple[str, dict[str, str]]) -> None:
    """Register ``metric, value`` over all parts."""

    def build(m: Models) -> DataFrame:
        out = None
        for source, metrics in parts:
            rows = bound(m, _one(source, metrics)).selectExpr(f"stack({len(metrics)}, " + ", ".join(f"'{n}', m{i}" for i, n in enumerate(metrics)) + ") as (metric, value)")
            out = rows if out is None else out.unionByName(rows)
        return out

    sql = " union all ".join(
        f"select unnest([{', '.join(repr(n) for n in metrics)}]) as metric, unnest([{', '.join(f'm{i}' for i in range(len(metrics)))}]) as value from ({_one(source, metrics)}) t" for source, metrics in parts
    )
    MADE[name] = (build, sql)


def n(condition: str) -> str:
    return f"count(*) filter (where {condition})"


def usd(column: str, condition: str = "true") -> str:
    return f"sum(case when {condition} then cast({column} as decimal(18,4)) end)"


def percent(a: str, b: str) -> str:
    return f"round(100e0 * cast({a} as double) / cast({b} as double), 4)"


END, COHORT = "date '1998-12-31'", "date '1997-03-01'"

profile(
    "profile_cdc",
    ("select * from fx_cdc", {"rows": "count(*)"}),
    ("select distinct * from fx_cdc", {
        "events": "count(*)", "applications": "count(distinct application_id)", "inserts": n("cdc_op = 'I'"), "updates": n("cdc_op = 'U'"), "deletes": n("cdc_op = 'D'"), "other_ops": n("cdc_op is null or cdc_op not in ('I', 'U', 'D')"),
        "created": n("status = 'CREATED'"), "approved": n("status = 'APPROVED'"), "rejected": n("status = 'REJECTED'"), "other_status": n("status is null or status not in ('CREATED', 'APPROVED', 'REJECTED')"),
        "requested_not_positive": n("coalesce(requested_amount, 0) <= 0"), "no_customer_or_merchant": n("customer_id_raw is null or merchant_id is null"), "placeholder": n("customer_id_raw = 999999999"),
        "currencies": "count(distinct currency)",
    }),
    ("select application_id, max(case when cdc_op = 'D' then 1 else 0 end) as gone, count(distinct customer_id_raw) as customers, count(distinct merchant_id) as merchants, count(distinct currency) as currencies from fx_cdc group by application_id", {
        "applications_deleted": n("gone = 1"), "more_customers": n("customers > 1"), "more_merchants": n("merchants > 1"), "more_currencies": n("currencies > 1"),
    }),
    ("select application_id, event_at_utc, count(*) as k from (select distinct * from fx_cdc) e group by application_id, event_at_utc", {"same_instant": n("k > 1")}),
)
profile(
    "profile_integrity",
    ("select * from fx_loans", {"loans": "count(*)", "loan_ids": "count(distinct loan_id)", "statuses": "count(distinct status)", "currencies": "count(distinct currency)", "principal_not_positive": n("coalesce(principal, 0) <= 0")}),
    ("select * from d_validated", {"valid": n("is_valid_loan"), "no_application": n("invalid_reason = 'NO_APPLICATION'"), "deleted": n("invalid_reason = 'APPLICATION_DELETED'"), "not_approved": n("invalid_reason = 'APPLICATION_NOT_APPROVED'")}),
    ("""select l.loan_id, max(case when c.customer_id_raw = l.customer_id then 1 else 0 end) as customer, max(case when c.merchant_id = l.merchant_id then 1 else 0 end) as merchant,
  max(case when c.currency = l.currency then 1 else 0 end) as currency, max(case when abs(c.requested_amount - l.principal) < 0.01 then 1 else 0 end) as amount
from fx_loans l join fx_cdc c on c.application_id = l.application_id group by l.loan_id""", {
        "customer_never": n("customer = 0"), "merchant_never": n("merchant = 0"), "currency_never": n("currency = 0"), "amount_never": n("amount = 0"),
    }),
    ("select application_id, count(*) as k from fx_loans group by application_id", {"applications_with_more_loans": n("k > 1")}),
    ("select l.loan_id, count(i.loan_id) as k from fx_loans l left join fx_installments i on i.loan_id = l.loan_id group by l.loan_id", {"without_installments": n("k = 0"), "fewest_installments": "min(k)", "most_installments": "max(k)"}),
    ("select i.loan_id, i.amount_due, l.loan_id as known from fx_installments i left join fx_loans l on l.loan_id = i.loan_id", {"installments": "count(*)", "orphan_installments": n("known is null"), "due_not_positive": n("coalesce(amount_due, 0) <= 0")}),
)
profile(
    "profile_payments",
    ("select * from fx_payments_raw", {"rows": "count(*)"}),
    ("select distinct * from fx_payments_raw", {
        "distinct_rows": "count(*)", "payments": "count(distinct payment_id)", "legacy": n("source_system = 'legacy_v1'"), "core": n("source_system = 'core_v2'"), "reversed": n("status = 'REVERSED'"), "prefixed": n("loan_ref like 'LN-%'"),
        "refs": "count(distinct loan_ref)", "reversed_without_target": n("status = 'REVERSED' and reversed_payment_id is null"), "reversed_negative": n("status = 'REVERSED' and amount_raw < 0"),
        "settled_not_positive": n("status = 'SETTLED' and coalesce(amount_raw, 0) <= 0"), "methods": "count(distinct payment_method)",
    }),
    ("select payment_id, count(*) as k from (select distinct * from fx_payments_raw) e group by payment_id", {"ids_with_more_rows": n("k > 1")}),
    ("""select r.payment_id, r.amount_raw as own, t.amount_raw as theirs, t.payment_id as target, t.status, r.source_system as own_source, t.source_system as their_source
from fx_payments r left join fx_payments t on t.payment_id = r.reversed_payment_id where r.status = 'REVERSED'""", {
        "target_missing": n("target is null"), "target_reversed": n("status = 'REVERSED'"), "target_amount_differs": n("abs(own) <> theirs"), "target_of_other_source": n("own_source <> their_source"),
    }),
    ("select reversed_payment_id, count(*) as k from fx_payments where status = 'REVERSED' and reversed_payment_id is not null group by reversed_payment_id", {"targets_reversed_again": n("k > 1")}),
    ("select s.payment_id, l.loan_id from d_staged s left join fx_loans l on l.loan_id = s.loan_id", {"unknown_loan": n("loan_id is null")}),
)
profile(
    "profile_customers",
    ("select * from fx_customers", {
        "rows": "count(*)", "ids": "count(distinct customer_id)", "documents": "count(distinct document_number)", "redundant_ids": "count(*) - count(distinct document_number)", "untrimmed": n("city <> trim(city)"), "sentinel_year": n("birth_year <= 1900"),
        "negative_income": n("monthly_income = '-1'"), "null_income": n("monthly_income is null"), "least_year": "min(birth_year)", "greatest_year": "max(birth_year)", "cities": "count(distinct city)", "cities_normalized": "count(distinct lower(trim(city)))",
    }),
    ("select document_number, count(*) as k, count(distinct country) as countries, count(distinct birth_year) as years from fx_customers group by document_number", {
        "documents_with_more_ids": n("k > 1"), "in_more_countries": n("k > 1 and countries > 1"), "with_more_years": n("k > 1 and years > 1"),
    }),
    ("select k.customer_id_raw, c.customer_id from (select distinct customer_id_raw from fx_cdc) k left join fx_customers c on c.customer_id = k.customer_id_raw", {"missing_from_master": n("customer_id is null")}),
    ("select k.customer_id_raw, c.customer_id from fx_cdc k left join fx_customers c on c.customer_id = k.customer_id_raw", {"events_of_missing": n("customer_id is null")}),
)
profile(
    "profile_merchants",
    ("select * from fx_merchants", {"versions": "count(*)", "merchants": "count(distinct merchant_id)", "null_name": n("merchant_name is null"), "no_category": n("category is null"), "null_country": n("country is null")}),
    ("""select merchant_id, count(*) as k, count(distinct category) as categories, count(distinct country) as countries, count(distinct merchant_name) as names, count(distinct upper(trim(merchant_name))) as plain_names,
  min(case when category is not null then valid_from end) as categorised, min(case when category is null then valid_from end) as blank, max(case when category is null then valid_from end) as last_blank from fx_merchants group by merchant_id""", {
        "one_version": n("k = 1"), "two_versions": n("k = 2"), "more_versions": n("k > 2"), "category_changed": n("categories > 1"), "country_changed": n("countries > 1"), "name_case_only": n("names > plain_names"),
        "name_changed": n("plain_names > 1"), "blank_only_version": n("k = 1 and blank is not null"), "blank_after_category": n("last_blank > categorised"),
    }),
    ("select k.merchant_id, h.merchant_id as known from (select distinct merchant_id from fx_cdc) k left join (select distinct merchant_id from fx_merchants) h on h.merchant_id = k.merchant_id", {"missing_for_events": n("known is null")}),
    ("select k.merchant_id, h.merchant_id as known from (select distinct merchant_id from fx_loans) k left join (select distinct merchant_id from fx_merchants) h on h.merchant_id = k.merchant_id", {"missing_for_loans": n("known is null")}),
    ("select h.merchant_id, k.merchant_id as used from (select distinct merchant_id from fx_merchants) h left join (select distinct merchant_id from fx_cdc) k on h.merchant_id = k.merchant_id", {"never_used": n("used is null")}),
)
profile(
    "profile_cdc_resolution",
    ("select * from d_applications", {
        "applications": "count(*)", "deleted": n("is_deleted"), "valid": n("is_valid"), "approved": n("is_approved"), "rejected": n("is_valid and status = 'REJECTED'"), "undecided": n("is_valid and status = 'CREATED'"),
        "approval_rate": percent(n("is_approved"), n("is_valid")), "out_of_order": n("is_out_of_order"), "out_of_order_valid": n("is_out_of_order and is_valid"), "unresolved": n("has_unresolved_customer"),
        "unresolved_valid": n("is_valid and has_unresolved_customer"), "events": "sum(n_events)", "fewest_events": "min(n_events)", "mean_events": "round(avg(n_events), 6)", "most_events": "max(n_events)",
    }),
)
profile(
    "profile_scd2",
    ("select * from d_merchants", {
        "versions": "count(*)", "merchants": "count(distinct merchant_id)", "current": n("is_current"), "changes": n("is_category_change"), "name_only": n("version > 1 and not is_category_change"), "unknown": n("category = 'UNKNOWN'"),
        "carried": n("category_origin = 'CARRIED_FORWARD'"), "with_two_versions": n("is_current and n_versions = 2"), "closed": n("valid_to is not null"), "closed_over_a_year": n("valid_to > valid_from + 365"),
    }),
    ("""select a.application_id, v.category as then_category, c.category as now_category from d_applications a
join d_merchants v on v.merchant_id = a.merchant_id and cast(a.created_at_utc as date) between v.valid_from and v.valid_to_effective
join d_merchants c on c.merchant_id = a.merchant_id and c.is_current where a.is_valid""", {
        "matched": "count(*)", "category_since_changed": n("then_category <> now_category"), "share_changed": percent(n("then_category <> now_category"), "count(*)"),
    }),
)
profile(
    "profile_identity",
    ("select * from d_people", {
        "people": "count(*)", "ids": "sum(n_ids)", "redundant_ids": "sum(n_ids) - count(*)", "shared": n("n_ids > 1"), "most_ids": "max(n_ids)", "conflicts": n("has_conflict"), "no_year": n("birth_year is null"), "no_income": n("income is null"),
    }),
    ("select document_number, count(distinct country) as countries, count(distinct birth_year) as years, count(*) as k from fx_customers group by document_number", {
        "in_more_countries": n("countries > 1"), "with_more_years": n("years > 1"), "alternative_people": "sum(countries)", "alternative_redundant": "sum(k) - sum(countries)",
    }),
    ("select p.person_sk, c.city_name from d_people p left join d_cities c on c.city_name = p.city", {"city_unknown": n("city_name is null")}),
)
profile(
    "profile_loans",
    ("select * from d_validated", {"delivered": "count(*)", "excluded": n("not is_valid_loan")}),
    ("select * from d_facts", {
        "loans": "count(*)", "gmv_usd": usd("principal_usd"), "unrated": n("principal_usd is null"), "no_version": n("merchant_sk is null"), "with_version": "count(merchant_sk)", "unknown_category": n("category = 'UNKNOWN'"), "cop": n("currency = 'COP'"),
        "plan_rows": "sum(n_installments)", "cohort_loans": n(f"cohort_month = {COHORT}"), "cohort_gmv_usd": usd("principal_usd", f"cohort_month = {COHORT}"), "merchants": "count(distinct merchant_id)",
    }),
    ("select c.days_stale from d_facts f left join d_calendar c on c.currency = f.currency and c.rate_date = f.disbursed_date", {
        "carried_rate": n("days_stale > 0"), "carried_rate_share": percent(n("days_stale > 0"), "count(*)"), "most_days_stale": "max(days_stale)",
    }),
    ("""select gmv, row_number() over (order by gmv desc, merchant_id) as r, total from (select merchant_id, sum(cast(principal_usd as decimal(18,4))) as gmv from d_facts group by merchant_id order by gmv desc, merchant_id limit 20) g
cross join (select sum(cast(principal_usd as decimal(18,4))) as total from d_facts) t""", {
        "top_1_share": percent("sum(case when r <= 1 then gmv end)", "max(total)"), "top_5_share": percent("sum(case when r <= 5 then gmv end)", "max(total)"), "top_20_share": percent("sum(case when r <= 20 then gmv end)", "max(total)"),
    }),
)
profile(
    "profile_effective",
    ("select * from fx_payments_raw", {"delivered": "count(*)"}),
    ("select p.*, l.loan_id as valid_loan, l.disbursed_at_utc from d_netted p left join d_loans l on l.loan_id = p.loan_id", {
        "rows": "count(*)", "effective": n("payment_class = 'EFFECTIVE'"), "reversed_out": n("payment_class = 'REVERSED_OUT'"), "reversal_rows": n("payment_class = 'REVERSAL_ROW'"), "twice": n("n_reversal_rows > 1"),
        "effective_on_invalid": n("payment_class = 'EFFECTIVE' and valid_loan is null"), "before_disbursement": n("paid_at_utc < disbursed_at_utc"),
    }),
    ("select * from d_payments", {"applied": "count(*)", "received_usd": usd("amount_usd"), "after_snapshot": n(f"paid_date > {END}")}),
    ("select l.loan_id, max(l.plan_total) as due, count(p.payment_id) as k, coalesce(sum(p.amount), 0) as paid from d_facts l left join d_payments p on p.loan_id = l.loan_id group by l.loan_id", {
        "fewest_payments": "min(k)", "most_payments": "max(k)", "without_payment": n("k = 0"), "paid_in_full": n("paid >= due"), "overpaid": n("paid > due + 1"),
    }),
)
profile(
    "profile_fifo",
    ("select * from d_allocation", {"allocations": "count(*)", "payments_used": "count(distinct payment_id)"}),
    ("select payment_id, count(*) as k from d_allocation group by payment_id", {"payments_split": n("k > 1")}),
    ("select loan_id, installment_number, count(*) as k from d_allocation group by loan_id, installment_number", {"installments_of_more_payments": n("k > 1")}),
    ("select p.loan_id, p.paid, coalesce(a.laid, 0) as laid from (select loan_id, sum(amount) as paid from d_payments where amount > 0 group by loan_id) p left join (select loan_id, sum(allocated) as laid from d_allocation group by loan_id) a on a.loan_id = p.loan_id", {
        "loans_with_excess": n("paid - laid > 0.01"), "excess": "sum(paid - laid)",
    }),
    ("select * from d_status", {
        "installments": "count(*)", "settled": n("is_settled"), "partial": n("is_partial"), "unpaid": n("paid = 0"), "due": n("is_due"), "not_due": n("not is_due"), "overdue": n("is_overdue"), "early": n("settled_date < due_date"),
        "on_time": n("settled_date = due_date"), "late": n("settled_date > due_date"), "late_30": n("settled_date > due_date and settled_date <= due_date + 30"), "late_over_30": n("settled_date > due_date + 30"), "paid": "sum(paid)",
        "most_days_past_due": "max(days_past_due)", "paid_after_snapshot": n("paid_any > paid"),
    }),
    ("select f.*, s.settled_date, l.cohort_month from d_first_payment f join d_facts l on l.loan_id = f.loan_id join (select loan_id, settled_date from d_status where installment_number = 1) s on s.loan_id = f.loan_id", {
        "fpd_eligible": n("is_fpd_eligible"), "fpd30": n("is_fpd30"), "fpd30_rate": percent(n("is_fpd30"), n("is_fpd_eligible")), "cohort_eligible": n(f"is_fpd_eligible and cohort_month = {COHORT}"), "cohort_fpd30": n(f"is_fpd30 and cohort_month = {COHORT}"),
        "fpd30_unpaid": n("is_fpd30 and settled_date is null"), "fpd30_late": n("is_fpd30 and settled_date is not null"),
    }),
)
profile(
    "profile_snapshot",
    ("select * from d_snapshot", {
        "loans": "count(*)", "with_balance": n("outstanding_gross > 0"), "settled": n("loan_status = 'SETTLED'"), "delinquent": n("loan_status = 'DELINQUENT'"), "current": n("loan_status = 'CURRENT'"), "par30": n("is_par30"),
        "outstanding_usd": usd("outstanding_usd"), "par30_usd": usd("outstanding_usd", "is_par30"), "par30_rate": percent(usd("outstanding_usd", "is_par30"), usd("outstanding_usd")), "gross": "sum(outstanding_gross)", "net": "sum(outstanding_net)",
        "net_par30": "sum(case when is_par30 then outstanding_net end)", "outstanding_usd_disbursed": usd("outstanding_usd_disbursed"), "par30_rate_disbursed": percent(usd("outstanding_usd_disbursed", "is_par30"), usd("outstanding_usd_disbursed")),
        "overdue": "sum(overdue_gross)", "delinquent_never_paid": n("loan_status = 'DELINQUENT' and days_since_payment is null"), "most_days_since_payment": "max(case when loan_status = 'DELINQUENT' then days_since_payment end)", "most_dpd": "max(dpd)",
    }),
    ("select * from d_first_payment", {"fpd_eligible": n("is_fpd_eligible"), "fpd30": n("is_fpd30")}),
)
profile(
    "profile_merchant_month",
    ("select * from d_monthly", {
        "rows": "count(*)", "merchants": "count(distinct merchant_id)", "months": "count(distinct month)", "active": n("is_active"), "idle": n("not is_active"), "changes": n("is_category_change"), "unknown_category": n("category = 'UNKNOWN'"),
        "applications": "sum(applications)", "approved": "sum(approved)", "approval_rate": percent("sum(approved)", "sum(applications)"), "loans": "sum(loans)", "gmv_usd": usd("gmv_usd"), "cohort_loans": f"sum(case when month = {COHORT} then loans end)",
        "cohort_gmv_usd": usd("gmv_usd", f"month = {COHORT}"), "fpd30_rate": percent("sum(fpd30)", "sum(fpd_eligible)"), "cohort_fpd30_rate": percent(f"sum(case when month = {COHORT} then fpd30 end)", f"sum(case when month = {COHORT} then fpd_eligible end)"),
        "outstanding_usd": usd("outstanding_usd", "month = date '1998-12-01'"), "par30_rate": percent(usd("par30_usd", "month = date '1998-12-01'"), usd("outstanding_usd", "month = date '1998-12-01'")),
        "cohort_par30_rate": percent(usd("cohort_par30_usd"), usd("cohort_outstanding_usd")),
    }),
)

#: What one value is not enough for: profile, measure, then the statement of ``key, value``.
BREAKDOWNS = (
    ("loans", "gmv_usd_by_currency", f"select currency as key, {usd('principal_usd')} as value from d_facts group by currency"),
    ("effective", "received_by_currency", "select currency as key, sum(amount) as value from d_payments group by currency"),
    ("snapshot", "outstanding_usd_by_currency", f"select l.currency as key, {usd('s.outstanding_usd')} as value from d_snapshot s join d_loans l on l.loan_id = s.loan_id group by l.currency"),
    ("snapshot", "par30_rate_by_currency", f"select currency as key, {percent(usd('outstanding_usd', 'is_par30'), usd('outstanding_usd'))} as value from d_snapshot group by currency"),
    ("snapshot", "outstanding_usd_by_bucket", f"select dpd_bucket as key, {usd('outstanding_usd')} as value from d_snapshot group by dpd_bucket"),
    ("snapshot", "par30_rate_by_year", f"select cast(year(l.disbursed_date) as varchar(4)) as key, {percent(usd('s.outstanding_usd', 's.is_par30'), usd('s.outstanding_usd'))} as value from d_snapshot s join d_loans l on l.loan_id = s.loan_id group by year(l.disbursed_date)"),
    ("snapshot", "rate_used", f"select currency as key, units_per_usd as value from d_calendar where rate_date = {END}"),
    ("merchant_month", "par30_rate_by_month", f"select cast(month as varchar(10)) as key, {percent(usd('par30_usd'), usd('outstanding_usd'))} as value from d_monthly group by month having {usd('outstanding_usd')} > 0"),
    ("merchant_month", "fpd30_rate_by_month", f"select cast(month as varchar(10)) as key, {percent('sum(fpd30)', 'sum(fpd_eligible)')} as value from d_monthly group by month having sum(fpd_eligible) > 0"),
    ("merchant_month", "gmv_usd_by_country", f"select coalesce(country, '(null)') as key, {usd('gmv_usd')} as value from d_monthly group by country"),
    ("merchant_month", "outstanding_usd_top_5", f"select cast(merchant_id as varchar(20)) as key, {usd('outstanding_usd')} as value from d_snapshot group by merchant_id order by {usd('outstanding_usd')} desc, merchant_id limit 5"),
)
_BREAKDOWNS = " union all ".join(f"select '{p}' as profile, '{measure}' as measure, key, cast(value as double) as value from ({sql}) b" for p, measure, sql in BREAKDOWNS)
MADE["profile_breakdowns"] = (lambda m: bound(m, _BREAKDOWNS), _BREAKDOWNS)

#: Lists of categories with their counts: profile, measure, groups, source.
LISTS = (
    ("cdc", "currency", ["currency"], "select currency from fx_cdc"), ("integrity", "status", ["status"], "select status from fx_loans"),
    ("payments", "source_status", ["source_system", "status"], "select source_system, status from (select distinct * from fx_payments_raw) e"),
    ("payments", "source_shape", ["source_system", "shape"], "select source_system, regexp_replace(loan_ref, '[0-9]', '9') as shape from (select distinct * from fx_payments_raw) e"),
    ("payments", "method", ["payment_method"], "select payment_method from (select distinct * from fx_payments_raw) e"), ("customers", "country", ["country"], "select country from fx_customers"),
    ("merchants", "category", ["category"], "select category from fx_merchants where category is not null"), ("cdc_resolution", "valid_currency", ["currency"], "select currency from d_applications where is_valid"),
    ("scd2", "current_category", ["category"], "select category from d_merchants where is_current"), ("identity", "country", ["country"], "select country from d_people"),
    ("loans", "excluded", ["invalid_reason"], "select invalid_reason from d_validated where not is_valid_loan"), ("effective", "class", ["payment_class"], "select payment_class from d_netted"),
    ("effective", "source", ["source_system"], "select n.source_system from d_netted n join d_payments p on p.payment_id = n.payment_id"),
    ("snapshot", "status", ["loan_status"], "select loan_status from d_snapshot"), ("snapshot", "bucket", ["dpd_bucket"], "select dpd_bucket from d_snapshot"),
)


#: Payments without their copies, which several lists count: found once, over as many partitions as the input asks for.
_ONCE = "(select distinct * from fx_payments_raw) e"


def _lists(m: Models) -> DataFrame:
    with dealt_over(m.spark, m.parts):
        once = written(bound(m, f"select source_system, status, payment_method, regexp_replace(loan_ref, '[0-9]', '9') as shape from {_ONCE}"), "once")
    out = None
    for p, measure, groups, source in LISTS:
        row = Q.counted_list(once.select(*groups) if _ONCE in source else bound(m, source), groups).select(F.lit(p).alias("profile"), F.lit(measure).alias("measure"), "listed")
        out = row if out is None else out.unionByName(row)
    return out


def _list_sql(p: str, measure: str, groups: list[str], source: str) -> str:
    source = source.replace("'[0-9]', '9')", "'[0-9]', '9', 'g')")
    keys = ", ".join(groups)
    return f"select '{p}' as profile, '{measure}' as measure, string_agg({' || chr(47) || '.join(groups)} || '=' || k, ', ' order by {keys}) as listed from (select {keys}, count(*) as k from ({source}) s group by {keys}) c"


MADE["counted_lists"] = (_lists, " union all ".join(_list_sql(*x) for x in LISTS))

#: Medians by measure; the payment's size over its loan's usual installment, near 100 where a source counts in minor units, and others.
MEDIANS = (
    """select concat('size_', p.source_system, '_', l.currency) as measure, cast(p.amount_raw as double) / i.usual as value from (select *, cast(regexp_extract(loan_ref, '([0-9]+)$', 1) as bigint) as loan from fx_payments where status = 'SETTLED') p
join fx_loans l on l.loan_id = p.loan join (select loan_id, median(cast(amount_due as double)) as usual from fx_installments group by loan_id) i on i.loan_id = p.loan where i.usual > 0""",
    "select 'days_past_due_settled' as measure, cast(days_past_due as double) as value from d_status where is_settled",
    "select 'days_since_payment_delinquent' as measure, cast(days_since_payment as double) as value from d_snapshot where loan_status = 'DELINQUENT'",
    "select 'payments_per_loan' as measure, cast(count(p.payment_id) as double) as value from d_loans l left join d_payments p on p.loan_id = l.loan_id group by l.loan_id",
)
MADE["profile_medians"] = (
    lambda m: R.median(bound(m, " union all ".join(f"select measure, value from ({s}) x" for s in MEDIANS)), ["measure"], "value"),
    "select measure, median(value) as med from (" + " union all ".join(f"select measure, value from ({s}) x" for s in MEDIANS) + ") y where value is not null group by 1",
)

_RANGES = " union all ".join(
    f"select '{p}' as profile, '{c}' as measure, cast(min({e}) as varchar(30)) as low, cast(max({e}) as varchar(30)) as high from {t}" + (f" where {w}" if w else "")
    for p, c, e, t, w in (
        ("integrity", "due_date", "due_date", "fx_installments", ""), ("merchants", "valid_from", "valid_from", "fx_merchants", ""), ("cdc_resolution", "created", "cast(created_at_utc as date)", "d_applications", ""), ("loans", "disbursed", "disbursed_date", "d_loans", ""),
        ("effective", "legacy_paid", "cast(paid_at_utc as date)", "d_netted", "source_system = 'legacy_v1'"), ("effective", "core_paid", "cast(paid_at_utc as date)", "d_netted", "source_system = 'core_v2'"), ("merchant_month", "month", "month", "d_monthly", ""),
    )
)
MADE["profile_ranges"] = (lambda m: bound(m, _RANGES), _RANGES)

#: Rows of each extract on its way: extract, then (stage, model, condition).
FUNNEL = {
    "applications": (("raw", "fx_cdc_raw", ""), ("events", "fx_cdc", ""), ("applications", "d_applications", ""), ("valid", "d_applications", "is_valid"), ("approved", "d_applications", "is_approved")),
    "loans": (("raw", "fx_loans", ""), ("validated", "d_validated", ""), ("valid", "d_loans", ""), ("facts", "d_facts", "")),
    "installments": (("raw", "fx_installments", ""), ("on_valid_loans", "d_installments", ""), ("status", "d_status", "")),
    "payments": (("raw", "fx_payments_raw", ""), ("staged", "d_staged", ""), ("netted", "d_netted", ""), ("effective", "d_netted", "payment_class = 'EFFECTIVE'"), ("applied", "d_payments", "")),
    "customers": (("raw", "fx_customers", ""), ("bridge", "d_bridge", ""), ("people", "d_people", "")),
    "merchants": (("raw", "fx_merchants", ""), ("versions", "d_merchants", ""), ("current", "d_merchants", "is_current")),
    "rates": (("raw", "fx_rates", ""), ("calendar", "d_calendar", ""), ("published", "d_calendar", "is_published")),
}
_COUNTS = " union all ".join(
    f"select '{extract}' as extract, {i} as seq, '{stage}' as stage, count(*) as n from {model}" + (f" where {condition}" if condition else "")
    for extract, stages in FUNNEL.items() for i, (stage, model, condition) in enumerate(stages, 1)
)
_FUNNEL = f"select extract, seq, stage, n, n - lag(n) over (partition by extract order by seq) as delta from ({_COUNTS}) c"
MADE["row_count_funnel"] = (lambda m: bound(m, _FUNNEL), _FUNNEL)

#: Repeated rows and keys of every extract.
KEYS = {"fx_cdc": "event_pk", "fx_loans": "loan_id", "fx_installments": "loan_id, installment_number", "fx_payments_raw": "payment_id", "fx_customers": "document_number", "fx_merchants": "merchant_id", "fx_rates": "rate_date, currency"}
_DUPLICATES = " union all ".join(
    f"select '{t[3:]}' as extract, a.total, b.distinct_rows, a.total - b.distinct_rows as repeats, c.duplicate_keys from (select count(*) as total from {t}) a cross join (select count(*) as distinct_rows from (select distinct * from {t}) d) b"
    f" cross join (select count(*) as duplicate_keys from (select {k} from {t} group by {k} having count(*) > 1) g) c"
    for t, k in KEYS.items()
)
MADE["profile_duplicates"] = (lambda m: bound(m, _DUPLICATES), _DUPLICATES)

#: Shapes of the text columns that hold times or references.
_SHAPED = {"fx_cdc_raw": "event_at_utc", "fx_payments_raw": "loan_ref", "fx_customers": "monthly_income"}
_SHAPES = " union all ".join(f"select '{t[3:]}' as extract, '{c}' as column_name, regexp_replace({c}, '[0-9]', '9'@) as shape, count(*) as n, min({c}) as example from {t} group by regexp_replace({c}, '[0-9]', '9'@)" for t, c in _SHAPED.items())
MADE["profile_timestamp_shapes"] = (lambda m: bound(m, _SHAPES.replace("@", "")), _SHAPES.replace("@", ", 'g'"))

MADE["twin_differences"] = (
    lambda m: Q.twin_differences(m.fx_payments_raw, ["payment_id"]).select("payment_id", "n", F.array_join("differing", ",").alias("differing")),
    "select payment_id, count(*) as n, concat_ws(',', " + ", ".join(
        f"case when count(distinct coalesce(cast({c} as varchar), '(null)')) > 1 then '{c}' end" for c in ("loan_ref", "paid_at_utc", "amount_raw", "source_system", "status", "reversed_payment_id", "payment_method")
    ) + ") as differing from fx_payments_raw group by 1 having count(distinct (loan_ref, paid_at_utc, amount_raw, source_system, status, coalesce(reversed_payment_id, -1), payment_method)) > 1",
)

QUERIES = {name: (lambda spark, sf_dir, build=build: build(models(spark, sf_dir))) for name, (build, _) in MADE.items()}
ORACLES = {name: statement(sql) for name, (_, sql) in MADE.items()}
