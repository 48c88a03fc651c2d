"""The lending queries over the derived views, each with its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.scalar import business_date, dpd_bucket
from tidewater.operators import lending as L
from tidewater.operators import relational as R
from tidewater.plans.params import PARAMS
from tidewater.sources.fixtures import TABLES, view
from tidewater.sources.oracle import NAMED, statement
from tidewater.sources.shared import dealt, dealt_over, drop_path, exists, new_path, shared_dir, written, written_in_buckets

# Spark side -------------------------------------------------------------------------------------------------------


#: Models that several others read: each is computed once and written as a table, so its sources are read once.
WRITTEN = ("applications", "calendar")
#: Those that meet by loan: tables in buckets of it, so that what is built on them needs no other shuffle by loan.
BY_LOAN = ("fx_loans", "fx_installments", "loans", "payments", "allocation", "status", "facts")
#: Given tables that the lending models grow with, and how many bytes of them a partition may stand for: a task of the widest model then holds about 350 MB.
GROWING = ("customer", "supplier", "orders", "lineitem", "events")
PART_BYTES = 8_000_000


class Models:
    """The models of one input folder, each built once: tables where others share them, else lazy plans.

    They are dealt over ``parts`` partitions, or over the session's shuffle partitions if these are more.
    """

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made, self._paths = spark, sf_dir, {}, {}
        self.parts = -(-sum(size for _, _, size in _stamps(spark, sf_dir, GROWING)) // PART_BYTES)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            made = BUILD[name](self) if name in BUILD else view(self.spark, self.sf_dir, name, lambda other: getattr(self, other))
            if name in (*WRITTEN, *BY_LOAN):
                self._paths[name] = new_path(self.spark, name)
                with dealt_over(self.spark, self.parts):
                    made = written_in_buckets(made, name, "loan_id", self._paths[name]) if name in BY_LOAN else written(made, name, self._paths[name])
            self._made[name] = made
        return self._made[name]

    def _whole(self) -> bool:
        """Whether all tables that were written are still there."""
        return all(exists(self.spark, p) for p in self._paths.values())

    def _drop(self) -> None:
        for path in self._paths.values():
            drop_path(self.spark, path)


_BUILT: dict[tuple, Models] = {}


def _stamps(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> tuple:
    """Path, time and size of every file of the given tables."""
    out = []
    for name in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files = fs.listFiles(path, True) if fs.exists(path) else None
        while files and files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getModificationTime(), f.getLen()))
    return tuple(sorted(out))


def models(spark: SparkSession, sf_dir: str) -> Models:
    """The models of a folder, materialised once a session: queries read the same tables until a given table changes or theirs are gone.

    Tables of inputs that have changed are deleted.
    """
    key = (spark.sparkContext.applicationId, shared_dir(spark), sf_dir, _stamps(spark, sf_dir))
    if key in _BUILT and not _BUILT[key]._whole():
        _BUILT.pop(key)._drop()
    if key not in _BUILT:
        for old in [k for k in _BUILT if k[0] != key[0] or k[2] == sf_dir]:  # ended sessions, changed inputs
            gone = _BUILT.pop(old)
            if old[0] == key[0]:
                gone._drop()
        _BUILT[key] = Models(spark, sf_dir)
    return _BUILT[key]


def _cities(m: Models) -> DataFrame:
    name = F.col("n_name")
    return m.nation.select(F.regexp_replace(F.upper(name), "[^A-Z0-9]", "").alias("city_key"), F.concat(F.lit("City "), F.initcap(name)).alias("city_name"))


BUILD: dict[str, Callable[[Models], DataFrame]] = {
    "applications": lambda m: L.cdc_latest_state(m.fx_cdc),
    "validated": lambda m: L.loan_validity(m.fx_loans, m.applications),
    "loans": lambda m: m.validated.where("is_valid_loan").drop("invalid_reason", "is_valid_loan"),
    "installments": lambda m: m.fx_installments.join(m.loans.select("loan_id"), "loan_id", "left_semi"),
    "staged": lambda m: dealt(L.staged_payments(m.fx_payments), m.parts, "payment_id"),
    "netted": lambda m: L.reversal_netting(m.staged),
    "calendar": lambda m: L.fx_daily_calendar(m.fx_rates),
    "payments": lambda m: L.effective_payments(m.netted, m.loans, m.calendar),
    "allocation": lambda m: L.fifo_allocation(m.payments, m.installments),
    "status": lambda m: L.installment_status(m.allocation, m.installments),
    "first_payment": lambda m: L.fpd30(m.status),
    "snapshot": lambda m: L.delinquency_snapshot(m.status, m.payments, m.loans, m.calendar),
    "series": lambda m: L.month_end_series(m.status, m.loans, m.calendar),
    "merchants": lambda m: L.scd2_from_history(m.fx_merchants),
    "cities": _cities,
    "people": lambda m: L.identity_collapse(m.fx_customers, m.cities),
    "bridge": lambda m: L.customer_bridge(m.fx_customers, m.people),
    "facts": lambda m: L.loan_fact(m.loans, m.installments, m.calendar, m.merchants, m.bridge),
    "monthly": lambda m: L.merchant_monthly(m.facts, m.applications, m.first_payment, m.snapshot, m.series, m.merchants),
}

# DuckDB side ------------------------------------------------------------------------------------------------------

NAMED |= {
    "d_rank": """select *, case cdc_op when 'I' then 1 when 'U' then 2 when 'D' then 3 end as r, customer_id_raw <> 999999999 as is_real,
  case when customer_id_raw <> 999999999 then customer_id_raw end as real_id from fx_cdc""",
    "d_order": """select *, row_number() over (partition by application_id order by event_at_utc desc, ingested_at_utc desc, r desc, is_real desc, event_pk desc) as ev,
  row_number() over (partition by application_id order by ingested_at_utc desc, event_at_utc desc, r desc, is_real desc, event_pk desc) as ing from d_rank""",
    "d_applications": """select application_id, max(real_id) as customer_id, max(case when ev = 1 then merchant_id end) as merchant_id, max(case when ev = 1 then status end) as status,
  max(case when ev = 1 then requested_amount end) as requested_amount, max(case when ev = 1 then currency end) as currency, min(event_at_utc) as created_at_utc,
  max(case when cdc_op <> 'D' and status in ('APPROVED', 'REJECTED') then event_at_utc end) as decided_at_utc, bool_or(cdc_op = 'D') as is_deleted, count(*) as n_events,
  not bool_or(cdc_op = 'D') as is_valid, not bool_or(cdc_op = 'D') and max(case when ev = 1 then status end) = 'APPROVED' as is_approved,
  max(case when ev = 1 then status end) <> max(case when ing = 1 then status end) as is_out_of_order, max(real_id) is null as has_unresolved_customer
from d_order group by application_id""",
    "d_validated": """select l.*, case when a.application_id is null then 'NO_APPLICATION' when a.is_deleted then 'APPLICATION_DELETED' when not a.is_approved then 'APPLICATION_NOT_APPROVED' end as invalid_reason,
  a.application_id is not null and not a.is_deleted and a.is_approved as is_valid_loan
from fx_loans l left join d_applications a using (application_id)""",
    "d_loans": "select * exclude (invalid_reason, is_valid_loan) from d_validated where is_valid_loan",
    "d_installments": "select * from fx_installments where loan_id in (select loan_id from d_loans)",
    "d_staged": """select payment_id, cast(regexp_extract(loan_ref, '([0-9]+)$', 1) as bigint) as loan_id, paid_at_utc,
  cast(case when source_system = 'legacy_v1' then amount_raw * 0.01 else amount_raw end as decimal(18,2)) as amount, source_system, status, reversed_payment_id from fx_payments""",
    "d_voids": """select reversed_payment_id as payment_id, count(*) as n, min(paid_at_utc) as first_reversed_at_utc, sum(amount) as reversed_total from d_staged
  where status = 'REVERSED' and reversed_payment_id is not null group by 1""",
    "d_netted": """select s.*, coalesce(v.n, 0) as n_reversal_rows, v.first_reversed_at_utc, v.reversed_total,
  case when s.status = 'REVERSED' then 'REVERSAL_ROW' when v.n is not null then 'REVERSED_OUT' else 'EFFECTIVE' end as payment_class
from d_staged s left join d_voids v using (payment_id)""",
    "d_days": """select cast(unnest(generate_series(a, b, interval 1 day)) as date) as rate_date from (
  select min(rate_date)::timestamp as a, greatest(max(rate_date), date '1998-12-31')::timestamp as b from fx_rates) e""",
    "d_calendar": """select currency, rate_date, last_value(r.units_per_usd ignore nulls) over w as units_per_usd, last_value(r.rate_date ignore nulls) over w as source_rate_date,
  r.rate_date is not null as is_published, date_diff('day', last_value(r.rate_date ignore nulls) over w, d.rate_date) as days_stale
from (select distinct currency from fx_rates) c cross join d_days d left join fx_rates r using (currency, rate_date)
window w as (partition by currency order by d.rate_date rows between unbounded preceding and current row)""",
    "d_paid": """select n.*, l.currency, cast((n.paid_at_utc - interval 5 hour) as date) as paid_date from d_netted n join d_loans l using (loan_id) where payment_class = 'EFFECTIVE'""",
    "d_payments": """select p.payment_id, p.loan_id, p.currency, p.paid_at_utc, p.paid_date, p.amount, floor(p.amount::double / c.units_per_usd::double * 10000 + 0.5000001::double) / 10000 as amount_usd,
  row_number() over w as payment_seq, sum(p.amount) over w as cumulative_paid
from d_paid p left join d_calendar c on c.currency = p.currency and c.rate_date = p.paid_date
window w as (partition by p.loan_id order by p.paid_at_utc, p.payment_id rows between unbounded preceding and current row)""",
    "d_money": """select *, sum(amount) over (partition by loan_id order by paid_at_utc, payment_id rows between unbounded preceding and current row) as m_end from d_payments where amount > 0""",
    "d_debt": """select *, sum(amount_due) over (partition by loan_id order by due_date, installment_number rows between unbounded preceding and current row) as b_end from d_installments where amount_due > 0""",
    "d_allocation": """select m.loan_id, m.payment_id, b.installment_number, m.paid_at_utc, m.paid_date,
  cast(least(m_end, b_end) - greatest(m_end - amount, b_end - amount_due) as decimal(18,2)) as allocated, m_end >= b_end as completes
from d_money m join d_debt b on m.loan_id = b.loan_id and m_end - amount < b_end and m_end > b_end - amount_due""",
    "d_sums": """select loan_id, installment_number, sum(allocated) filter (where paid_date <= date '1998-12-31') as paid, sum(allocated) as paid_any,
  min(paid_date) filter (where completes) as settled_date_any from d_allocation group by 1, 2""",
    "d_cut": """select i.loan_id, i.installment_number, i.due_date, i.amount_due, cast(coalesce(s.paid, 0) as decimal(18,2)) as paid, cast(coalesce(s.paid_any, 0) as decimal(18,2)) as paid_any, s.settled_date_any,
  case when s.settled_date_any <= date '1998-12-31' then s.settled_date_any end as settled_date from d_installments i left join d_sums s using (loan_id, installment_number)""",
    "d_status": """select *, amount_due - paid as remaining, settled_date is not null as is_settled, settled_date is null and paid > 0 as is_partial, due_date <= date '1998-12-31' as is_due,
  settled_date is null and due_date < date '1998-12-31' as is_overdue, greatest(date_diff('day', due_date, coalesce(settled_date, date '1998-12-31')), 0) as days_past_due from d_cut""",
    "d_first_payment": """select loan_id, due_date, days_past_due, due_date <= date '1998-12-31' - 30 as is_fpd_eligible, due_date <= date '1998-12-31' - 30 and days_past_due > 30 as is_fpd30
from d_status where installment_number = 1""",
    "d_perloan": """select loan_id, count(*) as n_installments, count(*) filter (where is_settled) as n_settled, count(*) filter (where is_overdue) as n_overdue,
  cast(coalesce(sum(amount_due) filter (where not is_settled), 0) as decimal(18,2)) as outstanding_gross, cast(coalesce(sum(remaining) filter (where not is_settled), 0) as decimal(18,2)) as outstanding_net,
  cast(coalesce(sum(amount_due) filter (where is_overdue), 0) as decimal(18,2)) as overdue_gross, min(due_date) filter (where is_overdue) as oldest_overdue from d_status group by 1""",
    "d_lastpaid": "select loan_id, max(paid_date) as last_paid from d_payments where paid_date <= date '1998-12-31' group by 1",
    "d_snapshot": """select l.loan_id, l.merchant_id, l.currency, n_installments, n_settled, n_overdue, outstanding_gross, outstanding_net, overdue_gross, oldest_overdue,
  coalesce(date_diff('day', oldest_overdue, date '1998-12-31'), 0) as dpd,
  case when oldest_overdue is null then '0' when date '1998-12-31' - oldest_overdue <= 30 then '1-30' when date '1998-12-31' - oldest_overdue <= 60 then '31-60' when date '1998-12-31' - oldest_overdue <= 90 then '61-90' else '90+' end as dpd_bucket,
  coalesce(date '1998-12-31' - oldest_overdue, 0) > 30 as is_par30,
  case when n_settled = n_installments then 'SETTLED' when n_overdue > 0 then 'DELINQUENT' else 'CURRENT' end as loan_status,
  floor(outstanding_gross::double / s.units_per_usd::double * 10000 + 0.5000001::double) / 10000 as outstanding_usd, floor(outstanding_gross::double / c.units_per_usd::double * 10000 + 0.5000001::double) / 10000 as outstanding_usd_disbursed,
  date '1998-12-31' - last_paid as days_since_payment
from d_loans l join d_perloan p using (loan_id) left join d_lastpaid using (loan_id)
  left join d_calendar s on s.currency = l.currency and s.rate_date = date '1998-12-31' left join d_calendar c on c.currency = l.currency and c.rate_date = l.disbursed_date""",
    "d_months": """select loan_id, currency, merchant_id, last_day(cast(unnest(generate_series(date_trunc('month', disbursed_date)::timestamp, timestamp '1998-12-01', interval 1 month)) as date)) as month_end from d_loans""",
    "d_atend": """select m.loan_id, m.currency, m.merchant_id, m.month_end, cast(coalesce(sum(amount_due) filter (where settled_date_any is null or settled_date_any > month_end), 0) as decimal(18,2)) as outstanding,
  min(due_date) filter (where (settled_date_any is null or settled_date_any > month_end) and due_date < month_end) as oldest
from d_months m join d_status s using (loan_id) group by 1, 2, 3, 4""",
    "d_series": """select loan_id, merchant_id, month_end, outstanding, coalesce(month_end - oldest, 0) as dpd, coalesce(month_end - oldest, 0) > 30 as is_par30,
  floor(outstanding::double / units_per_usd::double * 10000 + 0.5000001::double) / 10000 as outstanding_usd
from d_atend a left join d_calendar c on c.currency = a.currency and c.rate_date = a.month_end""",
    "d_versions": """select *, lead(valid_from) over w - 1 as valid_to, row_number() over w as version, count(*) over (partition by merchant_id) as n_versions,
  last_value(category ignore nulls) over (partition by merchant_id order by valid_from rows between unbounded preceding and current row) as carried,
  last_value(merchant_name) over (partition by merchant_id order by valid_from rows between unbounded preceding and unbounded following) as current_name
from fx_merchants window w as (partition by merchant_id order by valid_from)""",
    "d_merchants": """select md5(concat(merchant_id, '-', valid_from)) as merchant_sk, merchant_id, merchant_name, current_name, country, valid_from, valid_to, coalesce(valid_to, date '9999-12-31') as valid_to_effective,
  valid_to is null as is_current, version, n_versions, coalesce(carried, 'UNKNOWN') as category,
  case when category is not null then 'OBSERVED' when carried is not null then 'CARRIED_FORWARD' else 'UNKNOWN' end as category_origin,
  lag(coalesce(carried, 'UNKNOWN')) over w as previous_category, coalesce(lag(coalesce(carried, 'UNKNOWN')) over w <> coalesce(carried, 'UNKNOWN'), false) as is_category_change
from d_versions window w as (partition by merchant_id order by valid_from)""",
    "d_typed": """select customer_id, document_number, country, nullif(trim(regexp_replace(city, '\\s+', ' ', 'g')), '') as city, nullif(regexp_replace(upper(strip_accents(city)), '[^A-Z0-9]', '', 'g'), '') as city_key,
  case when birth_year > 1900 then birth_year end as birth_year, case when try_cast(trim(replace(monthly_income, ',', '')) as decimal(18,2)) >= 0 then try_cast(trim(replace(monthly_income, ',', '')) as decimal(18,2)) end as income, created_at
from fx_customers""",
    "d_cities": "select regexp_replace(upper(n_name), '[^A-Z0-9]', '', 'g') as city_key, concat('City ', upper(n_name[1]), lower(substr(n_name, 2))) as city_name from nation",
    "d_latest": "select * from d_typed qualify row_number() over (partition by document_number order by created_at desc, customer_id desc) = 1",
    "d_ids": """select document_number, count(*) as n_ids, count(distinct country) as nc, count(distinct birth_year) as nb, string_agg(customer_id::varchar, ',' order by customer_id) as customer_ids from d_typed group by 1""",
    "d_people": """select md5(l.document_number) as person_sk, l.document_number, l.customer_id as latest_customer_id, l.country, coalesce(c.city_name, l.city) as city, l.birth_year, l.income, n_ids, customer_ids, nc > 1 or nb > 1 as has_conflict
from d_latest l join d_ids using (document_number) left join d_cities c using (city_key)""",
    "d_bridge": "select c.customer_id, p.person_sk, p.document_number, c.customer_id = p.latest_customer_id as is_person_latest_id from fx_customers c join d_people p using (document_number)",
    "d_plan": "select loan_id, count(*) as n_installments, sum(amount_due) as plan_total, min(due_date) as first_due, max(due_date) as last_due from d_installments group by 1",
    "d_facts": """select l.loan_id, l.application_id, l.customer_id, b.person_sk, l.merchant_id, v.merchant_sk, v.category, l.currency, l.principal, floor(l.principal::double / c.units_per_usd::double * 10000 + 0.5000001::double) / 10000 as principal_usd,
  l.disbursed_date, cast(date_trunc('month', l.disbursed_date) as date) as cohort_month, n_installments, plan_total, first_due, last_due
from d_loans l left join d_plan using (loan_id) left join d_calendar c on c.currency = l.currency and c.rate_date = l.disbursed_date
  left join d_merchants v on v.merchant_id = l.merchant_id and l.disbursed_date between v.valid_from and v.valid_to_effective left join d_bridge b on b.customer_id = l.customer_id""",
    "d_grid": """select merchant_id, month from (select merchant_id, min(valid_from) as since from d_merchants group by 1) x cross join (
  select cast(unnest(generate_series(least(a, c), b, interval 1 month)) as date) as month from (
    select min(cohort_month)::timestamp as a, greatest(max(cohort_month), date '1998-12-01')::timestamp as b from d_facts) e,
    (select date_trunc('month', min(created_at_utc) filter (where is_valid) - interval 5 hour) as c from d_applications) f) y where last_day(month) >= since""",
    "d_mapps": """select merchant_id, cast(date_trunc('month', created_at_utc - interval 5 hour) as date) as month, count(*) filter (where is_valid) as applications, count(*) filter (where is_approved) as approved,
  count(*) filter (where is_deleted) as deleted from d_applications group by 1, 2""",
    "d_mcohort": """select f.merchant_id, cohort_month as month, count(*) as loans, sum(principal_usd::decimal(18,4))::double as gmv_usd, count(*) filter (where is_fpd_eligible) as fpd_eligible, count(*) filter (where is_fpd30) as fpd30,
  sum(outstanding_usd::decimal(18,4))::double as cohort_outstanding_usd, sum((case when is_par30 then outstanding_usd else 0 end)::decimal(18,4))::double as cohort_par30_usd
from d_facts f left join d_first_payment using (loan_id) left join (select loan_id, outstanding_usd, is_par30 from d_snapshot) s using (loan_id) group by 1, 2""",
    "d_mstock": """select merchant_id, cast(date_trunc('month', month_end) as date) as month, count(*) filter (where outstanding > 0) as loans_with_balance, count(*) filter (where is_par30) as loans_par30,
  sum(outstanding_usd::decimal(18,4))::double as outstanding_usd, sum((case when is_par30 then outstanding_usd else 0 end)::decimal(18,4))::double as par30_usd from d_series group by 1, 2""",
    "d_monthly": """select g.merchant_id, g.month, v.current_name as merchant_name, v.country, v.category, u.category as category_start, coalesce(applications, 0) as applications, coalesce(approved, 0) as approved, coalesce(deleted, 0) as deleted,
  case when applications > 0 then round(approved::double / applications, 6) end as approval_rate,
  coalesce(loans, 0) as loans, coalesce(gmv_usd, 0) as gmv_usd, coalesce(fpd_eligible, 0) as fpd_eligible, coalesce(fpd30, 0) as fpd30, case when fpd_eligible > 0 then round(fpd30::double / fpd_eligible, 6) end as fpd30_rate,
  coalesce(loans_with_balance, 0) as loans_with_balance, coalesce(loans_par30, 0) as loans_par30,
  coalesce(outstanding_usd, 0) as outstanding_usd, coalesce(par30_usd, 0) as par30_usd, case when outstanding_usd > 0 then round(par30_usd / outstanding_usd, 6) end as par30_rate,
  coalesce(cohort_outstanding_usd, 0) as cohort_outstanding_usd, coalesce(cohort_par30_usd, 0) as cohort_par30_usd, case when cohort_outstanding_usd > 0 then round(cohort_par30_usd / cohort_outstanding_usd, 6) end as par30_cohort_rate,
  coalesce(v.category <> u.category, false) as is_category_change, coalesce(applications, 0) + coalesce(loans, 0) + coalesce(loans_with_balance, 0) > 0 as is_active
from d_grid g left join d_mapps using (merchant_id, month) left join d_mcohort using (merchant_id, month) left join d_mstock using (merchant_id, month)
  left join d_merchants v on v.merchant_id = g.merchant_id and last_day(g.month) between v.valid_from and v.valid_to_effective
  left join d_merchants u on u.merchant_id = g.merchant_id and g.month between u.valid_from and u.valid_to_effective""",
}

MADE: dict[str, tuple[Callable[[Models], DataFrame], str]] = {}


def key(name: str, sql: str):
    """Register a query under ``name`` with its DuckDB statement over the named expressions."""

    def put(build: Callable[[Models], DataFrame]) -> Callable[[Models], DataFrame]:
        MADE[name] = (build, sql)
        return build

    return put


for _name, _model in (
    ("cdc_latest_state", "applications"), ("loan_validity", "validated"), ("reversal_netting", "netted"), ("fx_daily_calendar", "calendar"),
    ("effective_payments", "payments"), ("fifo_allocation", "allocation"), ("installment_status_asof", "status"), ("fpd30_flags", "first_payment"),
    ("delinquency_snapshot", "snapshot"), ("month_end_series", "series"), ("scd2_from_history", "merchants"), ("identity_collapse", "people"),
    ("loan_fact", "facts"), ("merchant_monthly", "monthly"),
):
    key(_name, f"select * from d_{_model}")(lambda m, _model=_model: getattr(m, _model))

key("cdc_soft_delete", "select application_id, is_deleted from d_applications where is_deleted")(lambda m: m.applications.where("is_deleted").select("application_id", "is_deleted"))
key("cdc_out_of_order", "select application_id, status from d_applications where is_out_of_order")(lambda m: m.applications.where("is_out_of_order").select("application_id", "status"))
key("placeholder_resolution", "select application_id, customer_id, has_unresolved_customer from d_applications")(lambda m: m.applications.select("application_id", "customer_id", "has_unresolved_customer"))


@key("scd2_point_in_time_join", "select loan_id, l.merchant_id, disbursed_date, version, category from d_loans l left join d_merchants v on v.merchant_id = l.merchant_id and disbursed_date between valid_from and valid_to_effective")
def _(m: Models) -> DataFrame:
    versions = m.merchants.select("merchant_id", "version", "category", "valid_from", "valid_to_effective")
    return R.point_in_time(m.loans, versions, "merchant_id", F.col("disbursed_date")).select("loan_id", "merchant_id", "disbursed_date", "version", "category")


@key("fx_asof_join", "select loan_id, l.currency, disbursed_date, units_per_usd as rate from d_loans l left join d_calendar c on c.currency = l.currency and c.rate_date = disbursed_date")
def _(m: Models) -> DataFrame:
    return L.fx_asof(m.loans.select("loan_id", "currency", "disbursed_date"), m.calendar, "disbursed_date", "rate").select("loan_id", "currency", "disbursed_date", "rate")


@key("interval_overlap_join", "select m.loan_id, payment_id, installment_number from d_money m join d_debt b on m.loan_id = b.loan_id and m_end - amount < b_end and m_end > b_end - amount_due")
def _(m: Models) -> DataFrame:
    return m.allocation.select("loan_id", "payment_id", "installment_number")


@key("month_spine_join", "select loan_id, month_end from d_months")
def _(m: Models) -> DataFrame:
    first, last = F.trunc("disbursed_date", "month"), F.trunc(F.lit(PARAMS.snapshot_date), "month")
    return m.loans.select("loan_id", R.series(first, last, "month").alias("month")).select("loan_id", F.last_day("month").alias("month_end"))


@key("dense_grid", "select currency, rate_date from (select distinct currency from fx_rates) c cross join d_days d")
def _(m: Models) -> DataFrame:
    return m.calendar.select("currency", "rate_date")


@key("date_series_explode", "select rate_date from d_days")
def _(m: Models) -> DataFrame:
    ends = m.fx_rates.agg(F.min("rate_date").alias("a"), F.greatest(F.max("rate_date"), F.lit(PARAMS.snapshot_date)).alias("b"))
    return ends.select(R.series(F.col("a"), F.col("b"), "day").alias("rate_date"))


@key("self_overlap_check", "select a.merchant_id, a.merchant_sk as sk_a, b.merchant_sk as sk_b, a.valid_from as from_a, a.valid_to_effective as to_a, b.valid_from as from_b, b.valid_to_effective as to_b from d_wide a join d_wide b on a.merchant_id = b.merchant_id and a.merchant_sk < b.merchant_sk and a.valid_from <= b.valid_to_effective and b.valid_from <= a.valid_to_effective")
def _(m: Models) -> DataFrame:
    wide = m.merchants.withColumn("valid_to_effective", F.when(F.col("is_current"), F.col("valid_to_effective")).otherwise(F.date_add("valid_to_effective", 1)))
    return R.overlapping_versions(wide, "merchant_id", "merchant_sk")


NAMED["d_wide"] = "select merchant_id, merchant_sk, valid_from, case when is_current then valid_to_effective else cast(valid_to_effective + 1 as date) end as valid_to_effective from d_merchants"


@key("full_outer_reconcile", """select coalesce(a.loan_id, b.loan_id) as loan_id, a.amount as amount_a, b.amount as amount_b,
  case when b.loan_id is null then 'only_a' when a.loan_id is null then 'only_b' else 'differs' end as side
from (select loan_id, sum(amount) as amount from d_payments group by 1) a full join (select loan_id, sum(allocated) as amount from d_allocation group by 1) b on a.loan_id = b.loan_id
where a.loan_id is null or b.loan_id is null or abs(a.amount - b.amount) > 0.005""")
def _(m: Models) -> DataFrame:
    paid = m.payments.groupBy("loan_id").agg(F.sum("amount").alias("amount"))
    laid = m.allocation.groupBy("loan_id").agg(F.sum("allocated").alias("amount"))
    return R.reconcile(paid, laid, ["loan_id"], ["amount"])


@key("filtered_aggregates", """select currency, count(*) as loans, count(*) filter (where is_par30) as par30, sum(outstanding_gross) filter (where is_par30) as par30_gross, bool_or(loan_status = 'SETTLED') as any_settled,
  max(dpd) filter (where loan_status = 'DELINQUENT') as worst from d_snapshot group by 1""")
def _(m: Models) -> DataFrame:
    return m.snapshot.groupBy("currency").agg(
        F.count("*").alias("loans"), F.count_if("is_par30").alias("par30"), F.sum(F.when(F.col("is_par30"), F.col("outstanding_gross"))).alias("par30_gross"),
        F.bool_or(F.col("loan_status") == "SETTLED").alias("any_settled"), F.max(F.when(F.col("loan_status") == "DELINQUENT", F.col("dpd"))).alias("worst"),
    )


@key("ordered_list_agg", "select document_number, string_agg(customer_id::varchar, ',' order by customer_id) as ids from fx_customers group by 1")
def _(m: Models) -> DataFrame:
    return m.fx_customers.groupBy("document_number").agg(F.array_join(F.sort_array(F.collect_list("customer_id")), ",").alias("ids"))


@key("rollup_totals", "select case when grouping(currency) = 1 then 'TOTAL' else currency end as currency, count(*) as loans, sum(principal) as principal from d_loans group by rollup(currency)")
def _(m: Models) -> DataFrame:
    return R.rollup_totals(m.loans, "currency", [F.count("*").alias("loans"), F.sum("principal").alias("principal")])


@key("group_median", "select source_system, median(amount_raw::double) as med, median(amount_raw::double) / (select median(amount_raw::double) from fx_payments where source_system = 'core_v2' and status = 'SETTLED') as ratio from fx_payments where status = 'SETTLED' group by 1")
def _(m: Models) -> DataFrame:
    settled = m.fx_payments.where("status = 'SETTLED'").withColumn("a", F.col("amount_raw").cast("double"))
    medians = R.median(settled, ["source_system"], "a")
    base = medians.where("source_system = 'core_v2'").select(F.col("med").alias("b"))
    return medians.join(base, how="left").select("source_system", "med", (F.col("med") / F.col("b")).alias("ratio"))


@key("latency_percentiles", """select event_type, count(*) as n, max(value) filter (where r = greatest(1, ceil(0.5 * c))) as p50, max(value) filter (where r = greatest(1, ceil(0.95 * c))) as p95, max(value) as max
from (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as c from events where value is not null) x group by 1""")
def _(m: Models) -> DataFrame:
    return R.nearest_rank(m.events, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "max": 1.0})


@key("latest_per_key", "select * from fx_cdc qualify row_number() over (partition by application_id order by event_at_utc desc, ingested_at_utc desc, cdc_op desc, event_pk desc) = 1")
def _(m: Models) -> DataFrame:
    return R.latest_per_key(m.fx_cdc, ["application_id"], [F.desc("event_at_utc"), F.desc("ingested_at_utc"), F.desc("cdc_op"), F.desc("event_pk")])


@key("forward_fill", "select currency, rate_date, units_per_usd, days_stale from d_calendar where not is_published")
def _(m: Models) -> DataFrame:
    return m.calendar.where("not is_published").select("currency", "rate_date", "units_per_usd", "days_stale")


@key("running_sum_rows", "select payment_id, payment_seq, cumulative_paid from d_payments")
def _(m: Models) -> DataFrame:
    return m.payments.select("payment_id", "payment_seq", "cumulative_paid")


_BY_MERCHANT = "(select merchant_id, sum(principal) as gmv from d_loans group by 1)"


@key("cumulative_share", f"""select merchant_id, gmv, row_number() over (order by gmv desc, merchant_id) as rank, sum(gmv) over (order by gmv desc) as running,
  round((sum(gmv) over (order by gmv desc))::double / (sum(gmv) over ())::double, 6) as share from {_BY_MERCHANT} x""")
def _(m: Models) -> DataFrame:
    return R.cumulative_share(m.loans.groupBy("merchant_id").agg(F.sum("principal").alias("gmv")), ["merchant_id"], "gmv", "merchant_id")


@key("top_k_by_measure", f"select merchant_id, gmv from {_BY_MERCHANT} x order by gmv desc, merchant_id limit 5")
def _(m: Models) -> DataFrame:
    return R.top_k(m.loans.groupBy("merchant_id").agg(F.sum("principal").alias("gmv")), "gmv", 5, "merchant_id")


@key("union_all_segments", """select segment, count(*) as loans, sum(principal) as principal from (
  select 'portfolio' as segment, principal from d_loans union all select 'cop', principal from d_loans where currency = 'COP' union all select 'large', principal from d_loans where principal >= 200000) x group by 1""")
def _(m: Models) -> DataFrame:
    named = {"portfolio": F.lit(True), "cop": F.col("currency") == "COP", "large": F.col("principal") >= 200000}
    return R.segments(m.loans, named, [F.count("*").alias("loans"), F.sum("principal").alias("principal")])


# Answers ----------------------------------------------------------------------------------------------------------


@key("answer_applications", "select count(*) as applications, count(*) filter (where is_valid) as valid, count(*) filter (where is_approved) as approved, round(100.0::double * count(*) filter (where is_approved) / count(*) filter (where is_valid), 4) as approval_rate from d_applications")
def _(m: Models) -> DataFrame:
    a = m.applications.agg(F.count("*").alias("applications"), F.count_if("is_valid").alias("valid"), F.count_if("is_approved").alias("approved"))
    return a.withColumn("approval_rate", F.round(F.lit(100.0) * F.col("approved") / F.col("valid"), 4))


@key("answer_gmv_rollup", """select case when grouping(currency) = 1 then 'TOTAL' else currency end as currency, count(*) as loans, round(sum(principal_usd), 2) as gmv_usd,
  round(sum(principal_usd) / (select sum(principal_usd) from d_facts), 6) as share from d_facts group by rollup(currency)""")
def _(m: Models) -> DataFrame:
    rows = R.rollup_totals(m.facts, "currency", [F.count("*").alias("loans"), F.sum("principal_usd").alias("g")])
    return rows.crossJoin(m.facts.agg(F.sum("principal_usd").alias("t"))).select("currency", "loans", F.round("g", 2).alias("gmv_usd"), F.round(F.col("g") / F.col("t"), 6).alias("share"))


@key("answer_cohort", """select 'fact' as source, count(*) as loans, round(sum(principal_usd), 2) as gmv_usd from d_facts where cohort_month = date '1997-03-01'
union all select 'gold', cast(sum(loans) as bigint), round(sum(gmv_usd), 2) from d_monthly where month = date '1997-03-01'
union all select 'utc_month', count(*), round(sum(principal_usd), 2) from d_facts f join d_loans l using (loan_id) where date_trunc('month', l.disbursed_at_utc) = timestamp '1997-03-01'""")
def _(m: Models) -> DataFrame:
    month = F.lit("1997-03-01").cast("date")
    fact = m.facts.where(F.col("cohort_month") == month).agg(F.count("*").alias("loans"), F.round(F.sum("principal_usd"), 2).alias("gmv_usd"))
    gold = m.monthly.where(F.col("month") == month).agg(F.sum("loans").alias("loans"), F.round(F.sum("gmv_usd"), 2).alias("gmv_usd"))
    at_utc = m.facts.join(m.loans.select("loan_id", "disbursed_at_utc"), "loan_id").where(F.trunc(F.col("disbursed_at_utc").cast("date"), "month") == month)
    at_utc = at_utc.agg(F.count("*").alias("loans"), F.round(F.sum("principal_usd"), 2).alias("gmv_usd"))
    tag = lambda df, name: df.select(F.lit(name).alias("source"), "loans", "gmv_usd")
    return tag(fact, "fact").unionByName(tag(gold, "gold")).unionByName(tag(at_utc, "utc_month"))


@key("answer_fpd30", """select scope, count(*) filter (where is_fpd_eligible) as eligible, count(*) filter (where is_fpd30) as fpd30, count(*) filter (where is_fpd30 and settled_date is null) as unpaid,
  count(*) filter (where is_fpd30 and settled_date is not null) as paid_late, round(100.0::double * count(*) filter (where is_fpd30) / count(*) filter (where is_fpd_eligible), 4) as rate
from (select unnest(case when cohort_month = date '1997-03-01' then ['global', 'cohort'] else ['global'] end) as scope, f.*, s.settled_date
  from d_first_payment f join d_facts using (loan_id) join (select loan_id, settled_date from d_status where installment_number = 1) s using (loan_id)) x group by 1""")
def _(m: Models) -> DataFrame:
    first = m.first_payment.join(m.facts.select("loan_id", "cohort_month"), "loan_id").join(m.status.where("installment_number = 1").select("loan_id", "settled_date"), "loan_id")
    bad = F.col("is_fpd30")
    rows = R.segments(first, {"global": F.lit(True), "cohort": F.col("cohort_month") == F.lit("1997-03-01").cast("date")}, [
        F.count_if("is_fpd_eligible").alias("eligible"), F.count_if(bad).alias("fpd30"), F.count_if(bad & F.col("settled_date").isNull()).alias("unpaid"),
        F.count_if(bad & F.col("settled_date").isNotNull()).alias("paid_late"),
    ])
    return rows.withColumnRenamed("segment", "scope").withColumn("rate", F.round(F.lit(100.0) * F.col("fpd30") / F.col("eligible"), 4))


@key("answer_par30", """select case when grouping(dpd_bucket) = 1 then 'TOTAL' else dpd_bucket end as bucket, count(*) as loans, round(sum(outstanding_usd), 2) as outstanding_usd,
  round(100 * sum(outstanding_usd) / (select sum(outstanding_usd) from d_snapshot), 4) as share, round(100 * sum(case when is_par30 then outstanding_usd else 0 end) / (select sum(outstanding_usd) from d_snapshot), 4) as par30 from d_snapshot group by rollup(dpd_bucket)""")
def _(m: Models) -> DataFrame:
    sums = [F.count("*").alias("loans"), F.sum("outstanding_usd").alias("o"), F.sum(F.when(F.col("is_par30"), F.col("outstanding_usd")).otherwise(0)).alias("p")]
    rows = R.rollup_totals(m.snapshot, "dpd_bucket", sums).crossJoin(m.snapshot.agg(F.sum("outstanding_usd").alias("t")))
    return rows.select(F.col("dpd_bucket").alias("bucket"), "loans", F.round("o", 2).alias("outstanding_usd"), F.round(100 * F.col("o") / F.col("t"), 4).alias("share"), F.round(100 * F.col("p") / F.col("t"), 4).alias("par30"))


NAMED["d_permerchant"] = """select merchant_id, max(merchant_name) as merchant_name, max(country) as country, sum(applications) as applications, sum(approved) as approved, sum(loans) as loans, sum(gmv_usd::decimal(38,4)) as gmv,
  sum(fpd_eligible) as eligible, sum(fpd30) as fpd30, sum(outstanding_usd::decimal(38,4)) filter (where month = date '1998-12-01') as outstanding, sum(par30_usd::decimal(38,4)) filter (where month = date '1998-12-01') as par30 from d_monthly group by 1"""


def _per_merchant(m: Models) -> DataFrame:
    """Sums over the months of each merchant, stock at the snapshot month."""
    month = F.trunc(F.lit(PARAMS.snapshot_date), "month")
    at_end = lambda c: F.sum(F.when(F.col("month") == month, F.col(c).cast("decimal(24,4)")))
    return m.monthly.groupBy("merchant_id").agg(
        F.max("merchant_name").alias("merchant_name"), F.max("country").alias("country"), F.sum("applications").alias("applications"), F.sum("approved").alias("approved"), F.sum("loans").alias("loans"),
        F.sum(F.col("gmv_usd").cast("decimal(24,4)")).alias("gmv"), F.sum("fpd_eligible").alias("eligible"), F.sum("fpd30").alias("fpd30"), at_end("outstanding_usd").alias("outstanding"), at_end("par30_usd").alias("par30"),
    )


def _percent(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.round(F.lit(100.0) * F.col(a).cast("double") / F.col(b).cast("double"), 4))


@key("answer_top_merchants", """select row_number() over (order by gmv desc, p.merchant_id) as rank, p.merchant_id, p.merchant_name, p.country, d.category, d.n_versions, p.loans::bigint as loans, round(gmv::double, 2) as gmv_usd,
  round(100.0::double * gmv::double / (select sum(gmv) from d_permerchant)::double, 4) as share, case when applications > 0 then round(100.0::double * approved::double / applications::double, 4) end as approval_rate,
  case when eligible > 0 then round(100.0::double * fpd30::double / eligible::double, 4) end as fpd30_rate, round(outstanding::double, 2) as outstanding_usd, case when outstanding > 0 then round(100.0::double * par30::double / outstanding::double, 4) end as par30_rate
from d_permerchant p join d_merchants d on d.merchant_id = p.merchant_id and d.is_current order by gmv desc, p.merchant_id limit 5""")
def _(m: Models) -> DataFrame:
    per = _per_merchant(m)
    current = m.merchants.where("is_current").select("merchant_id", "category", "n_versions")
    top = R.top_k(per, "gmv", 5, "merchant_id").crossJoin(per.agg(F.sum("gmv").alias("total"))).join(current, "merchant_id")
    rank = F.row_number().over(Window.orderBy(F.desc("gmv"), "merchant_id"))  # five rows
    return top.select(
        rank.alias("rank"), "merchant_id", "merchant_name", "country", "category", "n_versions", "loans", F.round(F.col("gmv").cast("double"), 2).alias("gmv_usd"), _percent("gmv", "total").alias("share"),
        _percent("approved", "applications").alias("approval_rate"), _percent("fpd30", "eligible").alias("fpd30_rate"), F.round(F.col("outstanding").cast("double"), 2).alias("outstanding_usd"), _percent("par30", "outstanding").alias("par30_rate"),
    )


NAMED["d_ranked"] = "select *, row_number() over (order by gmv desc, merchant_id) as rank, (sum(gmv) over (order by gmv desc))::double / (sum(gmv) over ())::double as share from d_permerchant"


@key("answer_concentration", """select segment, count(*) as merchants, round(sum(gmv)::double, 2) as gmv_usd, round(100.0::double * sum(gmv)::double / (select sum(gmv) from d_permerchant)::double, 4) as gmv_share,
  case when sum(eligible) > 0 then round(100.0::double * sum(fpd30)::double / sum(eligible)::double, 4) end as fpd30_rate, round(sum(outstanding)::double, 2) as outstanding_usd,
  case when sum(outstanding) > 0 then round(100.0::double * sum(par30)::double / sum(outstanding)::double, 4) end as par30_rate,
  (select min(rank) from d_ranked where share >= 0.5) as reach_50, (select min(rank) from d_ranked where share >= 0.8) as reach_80
from (select unnest(list_filter(['portfolio', case when rank = 1 then 'top' when rank <= 5 then '2-5' when rank <= 20 then '6-20' else 'rest' end, case when rank > 1 then 'without_top' end, concat('country ', country)], lambda x: x is not null)) as segment, r.* from d_ranked r) x group by 1""")
def _(m: Models) -> DataFrame:
    ranked = written(R.cumulative_share(_per_merchant(m), ["merchant_id"], "gmv", "merchant_id"), "ranked")
    r = F.col("rank")
    named = {"portfolio": F.lit(True), "top": r == 1, "2-5": r.between(2, 5), "6-20": r.between(6, 20), "rest": r > 20, "without_top": r > 1}
    sums = [F.count("*").alias("merchants"), *[F.sum(c).alias(c) for c in ("gmv", "eligible", "fpd30", "outstanding", "par30")]]
    rows = R.segments(ranked, named, sums).unionByName(ranked.withColumn("segment", F.concat(F.lit("country "), F.coalesce("country", F.lit("")))).groupBy("segment").agg(*sums))
    reach = lambda share, name: F.min(F.when(F.col("share") >= share, r)).alias(name)
    rows = rows.crossJoin(ranked.agg(F.sum("gmv").alias("total"), reach(0.5, "reach_50"), reach(0.8, "reach_80")))
    return rows.select(
        "segment", "merchants", F.round(F.col("gmv").cast("double"), 2).alias("gmv_usd"), _percent("gmv", "total").alias("gmv_share"), _percent("fpd30", "eligible").alias("fpd30_rate"),
        F.round(F.col("outstanding").cast("double"), 2).alias("outstanding_usd"), _percent("par30", "outstanding").alias("par30_rate"), "reach_50", "reach_80",
    )


@key("answer_identity", """select (select count(*) from fx_customers) as ids, count(*) as people, (select count(*) from fx_customers) - count(*) as redundant_ids, count(*) filter (where has_conflict) as conflicts, count(*) filter (where n_ids > 1) as people_with_more_ids,
  count(*) filter (where n_countries > 1) as people_in_more_countries, (select count(distinct concat(document_number, '|', country)) from fx_customers) as alternative_people,
  (select count(*) - count(distinct concat(document_number, '|', country)) from fx_customers) as alternative_redundant_ids
from d_people left join (select document_number, nc as n_countries from d_ids) i using (document_number)""")
def _(m: Models) -> DataFrame:
    """People by document number; the alternative rule tells them apart by document and country."""
    people = m.people.agg(F.count("*").alias("people"), F.sum("n_ids").alias("ids"), F.count_if("has_conflict").alias("conflicts"), F.count_if(F.col("n_ids") > 1).alias("people_with_more_ids"))
    pairs = m.fx_customers.groupBy("document_number", "country").agg(F.count("*").alias("n")).groupBy("document_number").agg(F.count("*").alias("countries"))
    other = pairs.agg(F.count_if(F.col("countries") > 1).alias("people_in_more_countries"), F.sum("countries").alias("alternative_people"))
    return people.crossJoin(other).select(
        "ids", "people", (F.col("ids") - F.col("people")).alias("redundant_ids"), "conflicts", "people_with_more_ids", "people_in_more_countries", "alternative_people",
        (F.col("ids") - F.col("alternative_people")).alias("alternative_redundant_ids"),
    )


# Scalar functions over the views ----------------------------------------------------------------------------------


@key("business_date", "select payment_id, cast(paid_at_utc - interval 5 hour as date) as day from fx_payments")
def _(m: Models) -> DataFrame:
    return m.fx_payments.select("payment_id", business_date(F.col("paid_at_utc").cast("timestamp_ntz"), PARAMS.business_tz).alias("day"))


@key("dpd_bucket", "select loan_id, installment_number, case when days_past_due <= 0 then '0' when days_past_due <= 30 then '1-30' when days_past_due <= 60 then '31-60' when days_past_due <= 90 then '61-90' else '90+' end as bucket from d_status")
def _(m: Models) -> DataFrame:
    return m.status.select("loan_id", "installment_number", dpd_bucket(F.col("days_past_due")).alias("bucket"))


QUERIES = {n: (lambda spark, sf_dir, build=build: build(models(spark, sf_dir))) for n, (build, _) in MADE.items()}
ORACLES = {n: statement(sql) for n, (_, sql) in MADE.items()}
