"""Data quality and profiling queries over the lending models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scalar import business_date, parse_utc_ts, value_shape
from tidewater.operators import quality as Q
from tidewater.operators import relational as R
from tidewater.plans.lending import MADE as _LENDING
from tidewater.plans.lending import Models, models
from tidewater.plans.params import PARAMS
from tidewater.sources.oracle import NAMED, statement
from tidewater.sources.shared import written

MADE: dict = {}


def key(name: str, sql: str):
    def put(build):
        MADE[name] = (build, sql)
        return build

    return put


# Checks -----------------------------------------------------------------------------------------------------------

key("dq_not_null", "select merchant_id, valid_from from fx_merchants where category is null")(lambda m: Q.not_null(m.fx_merchants, "category").select("merchant_id", "valid_from"))
key("dq_unique", "select document_number, count(*) as n from fx_customers group by 1 having count(*) > 1")(lambda m: Q.not_unique(m.fx_customers, ["document_number"]))
key("dq_unique_combination", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1")(lambda m: Q.not_unique(m.lineitem, ["l_orderkey", "l_linenumber"]))
key("dq_accepted_values", "select payment_id, source_system from fx_payments where source_system not in ('core_v2')")(lambda m: Q.not_accepted(m.fx_payments, "source_system", ["core_v2"]).select("payment_id", "source_system"))
key("dq_relationships", "select loan_id, application_id from fx_loans where application_id not in (select application_id from d_applications)")(lambda m: Q.orphans(m.fx_loans, "application_id", m.applications, "application_id").select("loan_id", "application_id"))
key("dq_accepted_range", "select loan_id, principal from fx_loans where principal < 2000 or principal > 400000")(lambda m: Q.out_of_range(m.fx_loans, "principal", 2000, 400000).select("loan_id", "principal"))
key("dq_expression", "select loan_id, dpd from d_snapshot where not (dpd <= 30 or n_overdue > 1)")(lambda m: Q.not_true(m.snapshot, (F.col("dpd") <= 30) | (F.col("n_overdue") > 1)).select("loan_id", "dpd"))
key("dq_alloc_le_installment", "select loan_id, installment_number from (select loan_id, installment_number, sum(allocated) as s from d_allocation group by 1, 2) a join d_installments using (loan_id, installment_number) where s > amount_due + 0.005")(lambda m: Q.allocation_excess(m.allocation, m.installments, ["loan_id", "installment_number"], "amount_due").select("loan_id", "installment_number"))
key("dq_alloc_le_payment", """select payment_id from (select payment_id, allocated, cast(null as decimal(18,2)) as amount from d_allocation union all select payment_id, null, amount from d_payments) x
group by payment_id having sum(allocated) > max(amount) + 0.005""")(lambda m: Q.allocation_excess(m.allocation, m.payments, ["payment_id"], "amount", m.parts).select("payment_id"))
key("dq_bridge_coverage", "select customer_id, 'b' as missing_in from fx_loans where customer_id not in (select customer_id from d_bridge) group by 1 union all select customer_id, 'a' from d_bridge where customer_id not in (select customer_id from fx_loans)")(lambda m: Q.not_covered(m.fx_loans, m.bridge, "customer_id"))
key("dq_deleted_no_loans", "select loan_id from d_validated where invalid_reason = 'APPLICATION_DELETED'")(lambda m: m.validated.where("invalid_reason = 'APPLICATION_DELETED'").select("loan_id"))
key("dq_scd2_no_overlap", "select a.merchant_id from d_merchants a join d_merchants b on a.merchant_id = b.merchant_id and a.merchant_sk < b.merchant_sk and a.valid_from <= b.valid_to_effective and b.valid_from <= a.valid_to_effective")(lambda m: R.overlapping_versions(m.merchants, "merchant_id", "merchant_sk").select("merchant_id"))
key("dq_scd2_one_current", "select merchant_id, count(*) filter (where is_current) as n from d_merchants group by 1 having count(*) filter (where is_current) <> 1")(lambda m: m.merchants.groupBy("merchant_id").agg(F.count_if("is_current").alias("n")).where("n <> 1"))


@key("dq_pit_exactly_one", "select application_id, count(merchant_sk) as n from d_applications a left join d_merchants v on v.merchant_id = a.merchant_id and created_at_utc::date between valid_from and valid_to_effective group by 1 having count(merchant_sk) <> 1")
def _(m: Models) -> DataFrame:
    events = m.applications.select("application_id", "merchant_id", F.col("created_at_utc").cast("date").alias("day"))
    versions = m.merchants.select("merchant_id", "merchant_sk", "valid_from", "valid_to_effective")
    return R.point_in_time(events, versions, "merchant_id", F.col("day")).groupBy("application_id").agg(F.count("merchant_sk").alias("n")).where("n <> 1")


key("dq_fifo_no_skip", "select loan_id, installment_number from (select *, max(paid_any) over (partition by loan_id order by installment_number rows between 1 following and unbounded following) as later from d_status) x where settled_date_any is null and later > 0")(lambda m: Q.skipped_installments(m.status))
key("dq_calendar_complete", "select currency, count(*) as days, date_diff('day', min(rate_date), max(rate_date)) + 1 as span from d_calendar where is_published group by 1 having count(*) <> date_diff('day', min(rate_date), max(rate_date)) + 1")(
    lambda m: m.calendar.where("is_published").groupBy("currency").agg(F.count("*").alias("days"), (F.datediff(F.max("rate_date"), F.min("rate_date")) + 1).alias("span")).where("days <> span")
)
key("dq_paid_reconcile", """select a.loan_id, paid, planned, laid from (select loan_id, sum(amount) as paid from d_payments where amount > 0 group by 1) a join (select loan_id, sum(amount_due) as planned from d_installments group by 1) b using (loan_id)
left join (select loan_id, sum(allocated) as laid from d_allocation group by 1) c using (loan_id) where abs(coalesce(laid, 0) - least(paid, planned)) > 0.01""")(lambda m: Q.paid_mismatch(m.payments, m.installments, m.allocation))


@key("dq_loan_matches_application", """select l.loan_id, l.merchant_id as loan_merchant, a.merchant_id as application_merchant, l.currency as loan_currency, a.currency as application_currency from fx_loans l join d_applications a using (application_id)
where l.merchant_id <> a.merchant_id or l.customer_id <> a.customer_id or l.currency <> a.currency""")
def _(m: Models) -> DataFrame:
    a = m.applications.select("application_id", F.col("merchant_id").alias("application_merchant"), F.col("customer_id").alias("application_customer"), F.col("currency").alias("application_currency"))
    rows = m.fx_loans.join(a, "application_id").where("merchant_id <> application_merchant or customer_id <> application_customer or currency <> application_currency")
    return rows.select("loan_id", F.col("merchant_id").alias("loan_merchant"), "application_merchant", F.col("currency").alias("loan_currency"), "application_currency")


@key("dq_series_matches_snapshot", """select coalesce(a.loan_id, b.loan_id) as loan_id, case when b.loan_id is null then 'only_a' when a.loan_id is null then 'only_b' else 'differs' end as side
from (select loan_id, outstanding, dpd from d_series where month_end = date '1998-12-31') a full join (select loan_id, outstanding_gross as outstanding, dpd from d_snapshot) b using (loan_id)
where a.loan_id is null or b.loan_id is null or abs(a.outstanding - b.outstanding) > 0.005 or a.dpd <> b.dpd""")
def _(m: Models) -> DataFrame:
    a = m.series.where(F.col("month_end") == F.lit(PARAMS.snapshot_date)).select("loan_id", "outstanding", "dpd")
    b = m.snapshot.select("loan_id", F.col("outstanding_gross").alias("outstanding"), "dpd")
    return R.reconcile(a, b, ["loan_id"], ["outstanding", "dpd"]).select("loan_id", "side")


_RECONCILED = {
    "applications": ("sum(applications)", "(select count(*) from d_applications where is_valid)"),
    "approved": ("sum(approved)", "(select count(*) from d_applications where is_approved)"),
    "loans": ("sum(loans)", "(select count(*) from d_facts)"),
    "gmv_usd": ("sum(gmv_usd::decimal(38,4))", "(select sum(principal_usd::decimal(18,4)) from d_facts)"),
    "fpd_eligible": ("sum(fpd_eligible)", "(select count(*) from d_first_payment where is_fpd_eligible)"),
    "fpd30": ("sum(fpd30)", "(select count(*) from d_first_payment where is_fpd30)"),
    "outstanding_usd": ("sum(outstanding_usd::decimal(38,4)) filter (where month = date '1998-12-01')", "(select sum(outstanding_usd::decimal(18,4)) from d_snapshot)"),
    "par30_usd": ("sum(par30_usd::decimal(38,4)) filter (where month = date '1998-12-01')", "(select sum(outstanding_usd::decimal(18,4)) from d_snapshot where is_par30)"),
}


@key("dq_agg_reconcile", " union all ".join(f"select '{n}' as measure, (select {gold} from d_monthly)::double as gold, coalesce({fact}, 0)::double as fact" for n, (gold, fact) in _RECONCILED.items()))
def _(m: Models) -> DataFrame:
    """Eight totals of the monthly mart beside those of the facts; exact sums, so a cent of difference is one."""
    month = F.trunc(F.lit(PARAMS.snapshot_date), "month")
    exact = lambda c: F.sum(F.col(c).cast("decimal(24,4)"))
    at_end = lambda c: F.sum(F.when(F.col("month") == month, F.col(c).cast("decimal(24,4)")))
    gold = m.monthly.agg(
        F.sum("applications").alias("applications"), F.sum("approved").alias("approved"), F.sum("loans").alias("loans"), exact("gmv_usd").alias("gmv_usd"), F.sum("fpd_eligible").alias("fpd_eligible"), F.sum("fpd30").alias("fpd30"),
        at_end("outstanding_usd").alias("outstanding_usd"), at_end("par30_usd").alias("par30_usd"),
    )
    fact = m.applications.agg(F.count_if("is_valid").alias("applications"), F.count_if("is_approved").alias("approved"))
    fact = fact.crossJoin(m.facts.agg(F.count("*").alias("loans"), F.sum(F.col("principal_usd").cast("decimal(18,4)")).alias("gmv_usd")))
    fact = fact.crossJoin(m.first_payment.agg(F.count_if("is_fpd_eligible").alias("fpd_eligible"), F.count_if("is_fpd30").alias("fpd30")))
    owed = F.col("outstanding_usd").cast("decimal(18,4)")
    fact = fact.crossJoin(m.snapshot.agg(F.sum(owed).alias("outstanding_usd"), F.sum(F.when(F.col("is_par30"), owed)).alias("par30_usd")))
    long = lambda df, name: df.selectExpr(f"stack({len(_RECONCILED)}, " + ", ".join(f"'{n}', cast({n} as double)" for n in _RECONCILED) + f") as (measure, {name})")
    return long(gold, "gold").join(long(fact, "fact"), "measure").withColumn("fact", F.coalesce("fact", F.lit(0.0)))


key("dq_no_reversed_in_fact", "select payment_id from d_payments where payment_id in (select reversed_payment_id from d_staged where reversed_payment_id is not null) or amount < 0")(
    lambda m: m.payments.join(m.staged.where("reversed_payment_id is not null").select(F.col("reversed_payment_id").alias("payment_id")), "payment_id", "left_semi").select("payment_id").unionByName(m.payments.where("amount < 0").select("payment_id"))
)
key("dq_payment_counts", "select count(*) filter (where payment_class = 'EFFECTIVE') as effective, count(*) filter (where status = 'SETTLED') as settled, count(distinct reversed_payment_id) as voided from d_netted")(
    lambda m: m.netted.agg(F.count_if(F.col("payment_class") == "EFFECTIVE").alias("effective"), F.count_if(F.col("status") == "SETTLED").alias("settled"), F.countDistinct("reversed_payment_id").alias("voided"))
)
key("dq_source_cutover", "select payment_id, source_system from fx_payments where (source_system = 'legacy_v1' and cast(paid_at_utc - interval 5 hour as date) >= date '1998-07-01') or (source_system = 'core_v2' and paid_at_utc < timestamp '1998-07-01')")(
    lambda m: m.fx_payments.where(
        ((F.col("source_system") == "legacy_v1") & (business_date(F.col("paid_at_utc").cast("timestamp_ntz"), PARAMS.business_tz) >= F.lit(PARAMS.cutover_date)))
        | ((F.col("source_system") == "core_v2") & (F.col("paid_at_utc") < F.lit(PARAMS.cutover_date).cast("timestamp_ntz")))
    ).select("payment_id", "source_system")
)
key("dq_person_counts", "select (select count(*) from fx_customers) as ids, (select sum(n_ids) from d_people) as per_person, (select count(*) from d_bridge) as bridge_rows")(
    lambda m: m.fx_customers.agg(F.count("*").alias("ids")).crossJoin(m.people.agg(F.sum("n_ids").alias("per_person"))).crossJoin(m.bridge.agg(F.count("*").alias("bridge_rows")))
)
key("dq_snapshot_coverage", "select loan_id, 'b' as missing_in from d_loans where loan_id not in (select loan_id from d_snapshot) union all select loan_id, 'a' from d_snapshot where loan_id not in (select loan_id from d_loans)")(lambda m: Q.not_covered(m.loans, m.snapshot, "loan_id"))


@key("dq_snapshot_recompute", "select s.loan_id from d_snapshot s join (select loan_id, sum(remaining) filter (where not is_settled) as r, max(days_past_due) filter (where is_overdue) as d from d_status group by 1) t using (loan_id) where abs(coalesce(r, 0) - outstanding_net) > 0.01 or coalesce(d, 0) <> dpd")
def _(m: Models) -> DataFrame:
    again = m.status.groupBy("loan_id").agg(F.sum(F.when(~F.col("is_settled"), F.col("remaining"))).alias("r"), F.max(F.when(F.col("is_overdue"), F.col("days_past_due"))).alias("d"))
    return m.snapshot.join(again, "loan_id").where("abs(coalesce(r, 0) - outstanding_net) > 0.01 or coalesce(d, 0) <> dpd").select("loan_id")


#: Every check: the model it is about, dimension, severity, and for checks that report counts the rows that fail.
CHECKS = {
    "dq_not_null": ("merchants", "completeness", "warn", None),
    "dq_unique": ("customers", "uniqueness", "warn", None),
    "dq_unique_combination": ("installments", "uniqueness", "error", None),
    "dq_accepted_values": ("payments", "validity", "warn", None),
    "dq_relationships": ("loans", "integrity", "error", None),
    "dq_accepted_range": ("loans", "validity", "warn", None),
    "dq_expression": ("snapshot", "consistency", "warn", None),
    "dq_alloc_le_installment": ("allocation", "accuracy", "error", None),
    "dq_alloc_le_payment": ("allocation", "accuracy", "error", None),
    "dq_bridge_coverage": ("customers", "integrity", "error", None),
    "dq_deleted_no_loans": ("loans", "integrity", "warn", None),
    "dq_scd2_no_overlap": ("merchants", "consistency", "error", None),
    "dq_scd2_one_current": ("merchants", "consistency", "error", None),
    "dq_pit_exactly_one": ("applications", "integrity", "error", None),
    "dq_fifo_no_skip": ("installments", "accuracy", "error", None),
    "dq_calendar_complete": ("calendar", "completeness", "warn", None),
    "dq_paid_reconcile": ("payments", "accuracy", "error", None),
    "dq_loan_matches_application": ("loans", "consistency", "warn", None),
    "dq_series_matches_snapshot": ("series", "consistency", "error", None),
    "dq_agg_reconcile": ("monthly", "accuracy", "error", "abs(gold - fact) > 0.01"),
    "dq_no_reversed_in_fact": ("payments", "validity", "error", None),
    "dq_payment_counts": ("payments", "consistency", "warn", "effective <> settled - voided"),
    "dq_source_cutover": ("payments", "timeliness", "warn", None),
    "dq_person_counts": ("customers", "consistency", "error", "ids <> per_person or ids <> bridge_rows"),
    "dq_snapshot_coverage": ("snapshot", "completeness", "error", None),
    "dq_snapshot_recompute": ("snapshot", "accuracy", "error", None),
}


def _failing(m: Models, name: str) -> DataFrame:
    rows, condition = MADE[name][0](m), CHECKS[name][3]
    return rows.where(condition) if condition else rows


def _failing_sql(name: str) -> str:
    condition = CHECKS[name][3]
    return f"({MADE[name][1]}) f" + (f" where {condition}" if condition else "")


def _checks(m: Models) -> DataFrame:
    return Q.outcome([(name, *about[:3], _failing(m, name)) for name, about in CHECKS.items()])


NAMED["d_checks"] = """select *, case when failures = 0 then 'pass' when severity = 'warn' then 'warn' else 'error' end as status from (
  """ + "\n  union all ".join(f"select '{name}' as \"check\", '{model}' as model, '{dimension}' as dimension, '{severity}' as severity, (select count(*) from {_failing_sql(name)}) as failures" for name, (model, dimension, severity, _) in CHECKS.items()) + ") c"
#: Sums of money with four decimals that a check gives as doubles.
_MONEY = {"dq_agg_reconcile": "replace (gold::decimal(28,4) as gold, fact::decimal(28,4) as fact)"}


def _whole_sql(name: str) -> str:
    """Whole failing rows: the text of every column, in order."""
    values = f"select coalesce(cast(columns(*) as varchar), '(null)') from (select * {_MONEY.get(name, '')} from {_failing_sql(name)}) w"
    return f"select '{name}' as \"check\", concat_ws('|', *columns(*)) as failing from ({values}) v"


def _whole(columns: list[tuple[str, str]]):
    return lambda row: F.concat_ws("|", *[F.coalesce((row[c].cast("decimal(28,4)") if kind == "double" else row[c]).cast("string"), F.lit("(null)")) for c, kind in columns])


@key("dq_audit_rows", 'select "check", model, dimension, severity, failures, status, failing from d_checks left join (' + "\nunion all ".join(map(_whole_sql, CHECKS)) + ') r using ("check")')
def _(m: Models) -> DataFrame:
    """Every check stores its whole failing rows in the audit sink; read back from there, each row beside the outcome of its check, and checks that pass without a row."""
    sink, failing = Q.AuditSink(m.spark), {name: (about[2], _failing(m, name)) for name, about in CHECKS.items()}
    sink.write("all", failing)
    about = m.spark.createDataFrame([(name, *about[:2]) for name, about in CHECKS.items()], "check string, model string, dimension string")
    outcomes = sink.checks("all").join(about, "check").select("check", "model", "dimension", "severity", "failures", "status")
    outcomes = F.broadcast(written(outcomes, "outcomes"))  # one row a check
    text = F
    for name, (_, df) in failing.items():  # one scan of all; each row is parsed once, by the schema of its check
        text = text.when(F.col("check") == name, F.transform(F.array(sink.parsed(df.schema)), _whole(df.dtypes))[0])
    found = sink.read("all").select("check", text.alias("failing")).join(outcomes, "check")
    return found.unionByName(outcomes.where("failures = 0").withColumn("failing", F.lit(None).cast("string")))


#: All models that checks may be about.
MODELS = ("allocation", "applications", "calendar", "customers", "facts", "installments", "loans", "merchants", "monthly", "payments", "people", "series", "snapshot", "status")
key("dq_matrix", "select model, " + ", ".join(f"count(*) filter (where dimension = '{d}') as {d}" for d in Q.DIMENSIONS) + """, count("check") as checks, count(*) filter (where status = 'warn') as warnings, count(*) filter (where status = 'error') as errors,
  count(distinct dimension) as covered, case when count(*) filter (where status = 'error') > 0 then 'error' when count(*) filter (where status = 'warn') > 0 then 'warn' when count("check") > 0 then 'pass' else 'none' end as status
from (select unnest([""" + ", ".join(f"'{m}'" for m in MODELS) + "]) as model) m left join d_checks using (model) group by 1")(lambda m: Q.matrix(_checks(m), MODELS))


@key("dq_failing_rows", "\nunion all ".join(f"select '{name}' as \"check\", '{CHECKS[name][2]}' as severity, cast(k as varchar) as failing from (select * from {_failing_sql(name)}) g(k)" for name in CHECKS))
def _(m: Models) -> DataFrame:
    """The rows that fail, by the first column of their check."""
    out = None
    for name, (_, _, severity, _) in CHECKS.items():
        failing = _failing(m, name)
        rows = failing.select(F.lit(name).alias("check"), F.lit(severity).alias("severity"), F.col(failing.columns[0]).cast("string").alias("failing"))
        out = rows if out is None else out.unionByName(rows)
    return out


class Seeded:
    """The models with faults put into some: what the checks that find nothing in sound models are tried on."""

    def __init__(self, m: Models) -> None:
        self._m = m

    def __getattr__(self, name: str) -> DataFrame:
        model = getattr(self._m, name)
        return SEEDS[name][0](model) if name in SEEDS else model


def _where(condition: str, **values: str):
    return lambda df: df.withColumns({c: F.when(F.expr(condition), F.expr(v).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


#: Faults by model, for both sides: too much allocated, customers out of the bridge, versions that overlap or are all current, first installments open again, amounts below zero, wrong days.
SEEDS = {
    "allocation": (_where("loan_id % 40 = 3", allocated="allocated * 3"), "select * replace (case when loan_id % 40 = 3 then allocated * 3 else allocated end as allocated) from d_allocation"),
    "bridge": (lambda df: df.where("customer_id % 30 <> 2"), "select * from d_bridge where customer_id % 30 <> 2"),
    "merchants": (
        _where("merchant_id % 8 = 0", valid_to_effective="date'2020-01-01'", is_current="true"),
        "select * replace (case when merchant_id % 8 = 0 then date '2020-01-01' else valid_to_effective end as valid_to_effective, merchant_id % 8 = 0 or is_current as is_current) from d_merchants",
    ),
    "status": (_where("loan_id % 9 = 1 and installment_number = 1", settled_date_any="null"), "select * replace (case when loan_id % 9 = 1 and installment_number = 1 then null else settled_date_any end as settled_date_any) from d_status"),
    "payments": (_where("payment_id % 97 = 0", amount="-amount"), "select * replace (case when payment_id % 97 = 0 then -amount else amount end as amount) from d_payments"),
    "snapshot": (_where("loan_id % 21 = 0", dpd="dpd + 1"), "select * replace (case when loan_id % 21 = 0 then dpd + 1 else dpd end as dpd) from d_snapshot"),
}
NAMED |= {f"s_{name}": sql for name, (_, sql) in SEEDS.items()}
SEEDED_CHECKS = (
    "dq_alloc_le_installment", "dq_alloc_le_payment", "dq_bridge_coverage", "dq_scd2_no_overlap", "dq_scd2_one_current", "dq_fifo_no_skip", "dq_paid_reconcile",
    "dq_no_reversed_in_fact", "dq_snapshot_recompute",
)


def _seeded_sql(name: str) -> str:
    sql = re.sub(r"\bd_(\w+)", lambda w: f"s_{w[1]}" if w[1] in SEEDS else w[0], MADE[name][1])
    return f"select '{name}' as \"check\", cast(k as varchar) as failing from (select * from ({sql}) f) g(k)"


@key("dq_seeded_violations", "\nunion all ".join(map(_seeded_sql, SEEDED_CHECKS)))
def _(m: Models) -> DataFrame:
    """Rows that the checks find in models with seeded faults, by the first column of the check."""
    out = None
    for name in SEEDED_CHECKS:
        failing = MADE[name][0](Seeded(m))
        rows = failing.select(F.lit(name).alias("check"), F.col(failing.columns[0]).cast("string").alias("failing"))
        out = rows if out is None else out.unionByName(rows)
    return out


STORED = ("dq_fifo_no_skip", "dq_scd2_one_current", "dq_accepted_range", "dq_source_cutover", "dq_calendar_complete")


def _stored_sql(run: str, name: str, seeded: bool) -> str:
    sql = re.sub(r"\bd_(\w+)", lambda w: f"s_{w[1]}" if seeded and w[1] in SEEDS else w[0], MADE[name][1])
    return f"select '{run}' as run, '{name}' as \"check\", '{CHECKS[name][2]}' as severity, cast(k as varchar) as failing from (select * from ({sql}) f) g(k)"


@key("dq_stored_rows", "\nunion all ".join(_stored_sql(run, name, seeded) for run, seeded in (("first", False), ("second", True)) for name in STORED))
def _(m: Models) -> DataFrame:
    """Whole failing rows of two runs in the audit sink, read back: the first run was seeded and then run again on sound models, the second is seeded."""
    sink = Q.AuditSink(m.spark)
    failing = lambda of: {name: (CHECKS[name][2], MADE[name][0](of)) for name in STORED}
    sink.write("first", failing(Seeded(m)))
    sink.write("second", failing(Seeded(m)))
    sink.write("first", failing(m))
    first_column = F.regexp_extract("row", '^\\{"[^"]*":"?([^",}]*)', 1)
    return sink.read().select("run", "check", "severity", first_column.alias("failing"))


@key("crosscheck_independent", """select loan_id, installment_number, cast(round(paid_any * 100) as bigint) as paid_cents, cast(round(paid_any * 100) as bigint) as greedy_cents, true as same
from d_status where amount_due > 0""")
def _(m: Models) -> DataFrame:
    """The set-based allocation beside one made payment by payment; a side without the row counts as not the same."""
    ours = m.status.where("amount_due > 0").select("loan_id", "installment_number", F.round(F.col("paid_any") * 100).cast("bigint").alias("paid_cents"))
    greedy = Q.greedy_fifo(m.payments, m.installments).withColumnRenamed("paid_cents", "greedy_cents")
    both = ours.join(greedy, ["loan_id", "installment_number"], "full")
    return both.withColumn("same", F.coalesce(F.col("paid_cents") == F.col("greedy_cents"), F.lit(False)))


# Profiles: long tables (metric, value), one aggregation of each input ----------------------------------------------


def profile(df: DataFrame, **metrics: Column) -> DataFrame:
    """``metric, value`` of aggregates over one pass of ``df``."""
    one = df.agg(*[c.cast("double").alias(n) for n, c in metrics.items()])
    return one.selectExpr(f"stack({len(metrics)}, " + ", ".join(f"'{n}', `{n}`" for n in metrics) + ") as (metric, value)")


def metrics_sql(source: str, **metrics: str) -> str:
    return " union all ".join(f"select '{n}' as metric, cast({sql} as double) as value from {source}" for n, sql in metrics.items())


def long(name: str, source, sql_source: str, **both: tuple[str, str]) -> None:
    """A profile key whose metrics are given for both sides."""
    key(name, metrics_sql(sql_source, **{n: s for n, (_, s) in both.items()}))(lambda m: profile(source(m), **{n: F.expr(c) for n, (c, _) in both.items()}))


C, _if = F.col, F.count_if
_w = lambda cond: f"count(*) filter (where {cond})"
both = lambda cond: (f"count_if({cond})", _w(cond))

key("value_shape", "select regexp_replace(loan_ref, '[0-9]', '9', 'g') as shape, count(*) as n from fx_payments group by 1")(lambda m: m.fx_payments.groupBy(value_shape(C("loan_ref")).alias("shape")).agg(F.count("*").alias("n")))


long("profile_calendar_gaps", lambda m: m.calendar, "d_calendar", days=("count(*)", "count(*)"), published=both("is_published"), missing=both("not is_published"), weekend_missing=("count_if(not is_published and dayofweek(rate_date) in (1, 7))", "count(*) filter (where not is_published and dayofweek(rate_date) in (0, 6))"), stalest=("max(days_stale)", "max(days_stale)"))


@key("profile_ts_parse", """select 'rows' as metric, count(*)::double as value from fx_cdc_raw union all select 'parsed', count(*) from d_parsed where ts is not null
union all select 'day_shifts', count(*) from d_parsed where ts::date <> (ts - interval 5 hour)::date union all select 'distinct_events', count(*) from (select distinct application_id, customer_id, status, cdc_op, ts from d_parsed) x""")
def _(m: Models) -> DataFrame:
    parsed = m.fx_cdc_raw.withColumn("ts", parse_utc_ts(C("event_at_utc")))
    counts = profile(parsed, rows=F.count("*"), parsed=F.count("ts"), day_shifts=_if(C("ts").cast("date") != business_date(C("ts"), PARAMS.business_tz)))
    return counts.unionByName(profile(parsed.select("application_id", "customer_id", "status", "cdc_op", "ts").distinct(), distinct_events=F.count("*")))


NAMED["d_parsed"] = r"""select *, case when regexp_full_match(event_at_utc, '[0-9]{13}') then make_timestamp(try_cast(event_at_utc as bigint) * 1000)
  else try_cast(replace(replace(event_at_utc, 'T', ' '), 'Z', '') as timestamp) end as ts from fx_cdc_raw"""
key("parse_utc_ts", "select event_at_utc, ts from d_parsed")(lambda m: m.fx_cdc_raw.select("event_at_utc", parse_utc_ts(C("event_at_utc")).alias("ts")))


@key("typed_distinct", "select distinct application_id::bigint as application_id, customer_id::bigint as customer_id, status, cdc_op, ts from d_parsed")
def _(m: Models) -> DataFrame:
    return R.typed_distinct(m.fx_cdc_raw, application_id=C("application_id").cast("bigint"), customer_id=C("customer_id").cast("bigint"), status=C("status"), cdc_op=C("cdc_op"), ts=parse_utc_ts(C("event_at_utc")))


QUERIES = {n: (lambda spark, sf_dir, build=build: build(models(spark, sf_dir))) for n, (build, _) in MADE.items()}
ORACLES = {n: statement(sql) for n, (_, sql) in MADE.items()}
assert not set(MADE) & set(_LENDING)
