"""Evaluation, sampling and streaming queries, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import evaluate as E
from tidewater.plans.lending import Models, models
from tidewater.plans.messages import MADE as _MESSAGES  # noqa: F401  its named expressions are used below
from tidewater.sources.oracle import NAMED, statement
from tidewater.streaming import streams

MADE: dict = {}


def key(name: str, sql: str):
    def put(build):
        MADE[name] = (build, sql)
        return build

    return put


NAMED["d_metrics"] = """select label, coalesce(support, 0) as support, coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits from
  (select gold_reason as label, count(*) as support, count(*) filter (where gold_reason = pred_reason) as hits from fx_predictions group by 1) g full join (select pred_reason as label, count(*) as predicted from fx_predictions group by 1) p using (label)"""
NAMED["d_scores"] = """select *, case when predicted > 0 then round(hits::double / predicted, 6) else 0 end as precision, case when support > 0 then round(hits::double / support, 6) else 0 end as recall,
  case when support + predicted > 0 then round(2.0::double * hits / (support + predicted), 6) else 0 end as f1 from d_metrics"""
key("reason_metrics", "select * from d_scores")(lambda m: E.reason_metrics(m.fx_predictions))
key("reason_summary", """select count(*) as n, round(avg((gold_reason = pred_reason)::int), 6) as exact, round(avg((gold_reason = pred_reason or coalesce(pred_reason = gold_secondary, false))::int), 6) as lenient,
  (select round(avg(f1), 6) from d_scores where support > 0) as macro_f1 from fx_predictions""")(lambda m: E.reason_summary(m.fx_predictions))
key("confusion_matrix", "select gold_reason, pred_reason, count(*) as n from fx_predictions where gold_reason <> pred_reason group by 1, 2")(lambda m: E.confusion(m.fx_predictions))
key("priority_metrics", """select count(*) as n, round(avg((d = 0)::int), 6) as exact, round(avg((abs(d) <= 1)::int), 6) as within_one, round(avg(abs(d)), 6) as mean_distance, count(*) filter (where d < 0) as more_urgent, count(*) filter (where d > 0) as less_urgent
from (select pred_priority - gold_priority as d from fx_predictions) x""")(lambda m: E.priority_metrics(m.fx_predictions))
key("action_metrics", """select count(*) as n, count(*) filter (where gold_action = pred_action) as exact, count(*) filter (where gold_action = 'route_to_human' and pred_action like 'auto%') as unsafe,
  count(*) filter (where gold_action like 'auto%' and pred_action = 'route_to_human') as conservative, count(*) filter (where gold_action <> pred_action and gold_action like 'auto%' and pred_action like 'auto%') as auto_mixed from fx_predictions""")(lambda m: E.action_metrics(m.fx_predictions))
key("disagreement_list", "select id from fx_predictions where gold_reason <> pred_reason or gold_priority <> pred_priority or gold_action <> pred_action")(lambda m: E.disagreements(m.fx_predictions).select("id"))


def _runs(m: Models) -> tuple[DataFrame, DataFrame]:
    p = m.fx_predictions
    a = p.select("id", F.col("pred_reason").alias("label"), (F.col("gold_priority") / 5).alias("confidence"))
    return a, p.where("pred_priority <> 3").select("id", F.col("gold_reason").alias("label"), (F.col("pred_priority") / 5).alias("confidence"))


key("run_comparison", "select count(*) as n, round(avg((pred_reason = gold_reason)::int), 6) as same, round(avg(abs(gold_priority / 5.0::double - pred_priority / 5.0::double)), 6) as mean_change from fx_predictions where pred_priority <> 3")(lambda m: E.run_comparison(*_runs(m)))
key("rater_agreement", "select count(*) as n, count(*) filter (where gold_action = pred_action) as agreed from fx_predictions where gold_priority <> 2")(
    lambda m: E.rater_agreement(m.fx_predictions.select("id", F.col("gold_action").alias("verdict")), m.fx_predictions.where("gold_priority <> 2").select("id", F.col("pred_action").alias("verdict")))
)
key("expectation_checks", """select id, 'reason' as "check", gold_reason as expected, pred_reason as actual, gold_reason = pred_reason as ok from fx_predictions union all select id, 'priority', gold_priority::varchar, pred_priority::varchar, gold_priority = pred_priority from fx_predictions
union all select id, 'secondary', gold_secondary, pred_reason, gold_secondary = pred_reason from fx_predictions where gold_secondary is not null""")(
    lambda m: E.expectation_checks(m.fx_predictions, {"reason": ("gold_reason", "pred_reason"), "priority": ("gold_priority", "pred_priority"), "secondary": ("gold_secondary", "pred_reason")})
)
NAMED["d_classes"] = "select gold_reason, count(*) as size, greatest(least(2, count(*))::double, count(*) * 60.0::double / (select count(*) from fx_predictions)) as want from fx_predictions group by 1"
NAMED["d_quota"] = """select gold_reason, least(size, low + case when row_number() over (order by want - low desc, gold_reason) <= (select 60 - sum(least(size, floor(want))) from d_classes) then 1 else 0 end) as quota from (select *, least(size, floor(want)) as low from d_classes) x"""
key("stratified_sample", "select id, gold_reason from (select id, p.gold_reason, quota, row_number() over (partition by p.gold_reason order by substr(md5(id), 1, 13), id) as r from fx_predictions p join d_quota q on q.gold_reason = p.gold_reason) x where r <= quota")(lambda m: E.stratified_sample(m.fx_predictions, "gold_reason", 60))
_HARD = "gold_secondary is not null and gold_reason <> pred_reason"
NAMED["d_draws"] = f"select id, gold_reason as label, substr(md5(id), 1, 13) as draw, {_HARD} as hard from fx_predictions"
NAMED["d_hard"] = "select id, label from d_draws where hard order by draw, id limit 90"
NAMED["d_pools"] = """select c.label, c.size, coalesce(h.have, 0) as have, c.size - coalesce(h.have, 0) as pool, least(c.size - coalesce(h.have, 0), greatest(0, 2 - coalesce(h.have, 0))) as low
from (select label, count(*) as size from d_draws group by 1) c left join (select label, count(*) as have from d_hard group by 1) h using (label)"""
NAMED["d_filled"] = """select label, count(*) as more from (select label, want - j as deficit, row_number() over (order by want - j desc, label desc) as r from (
  select label, size::double / (select sum(size) from d_pools)::double * 90 - have - low as want, unnest(generate_series(1, least(pool - low, 90))) as j from d_pools where pool > low) u) v
where r <= 90 - (select sum(have + low) from d_pools) group by 1"""
key("hard_first_sample", """select id, label, tier from (select *, row_number() over (order by case tier when 'hard' then 0 when 'least' then 1 else 2 end, label, id) as place from (
  select id, label, 'hard' as tier from d_hard union all
  select d.id, d.label, case when r <= low then 'least' else 'fill' end from (select *, row_number() over (partition by label order by draw, id) as r from d_draws where id not in (select id from d_hard)) d
    join d_pools p on p.label = d.label left join d_filled f on f.label = d.label where r <= low + coalesce(more, 0)) x) y where place <= 90""")(
    lambda m: E.hard_first_sample(m.fx_predictions, "gold_reason", F.expr(_HARD), 90)
)
key("capped_sample", "select id, gold_reason from (select id, gold_reason, row_number() over (partition by gold_reason order by id) as r from fx_predictions) x where r <= 10 order by id limit 30")(lambda m: E.capped_sample(m.fx_predictions.select("id", "gold_reason"), "gold_reason", 30, 10))


@key("stream_message_annotate", "select f.id, t.code as rule, e.amount, requests_human, fraud_or_security from d_flags f join d_tier0 t using (id) join d_extracted e using (id)")
def _(m: Models) -> DataFrame:
    stream = streams.as_stream(m.spark, m.fx_messages.select("id", "text"))
    return streams.run(streams.annotate(stream).select("id", "rule", "amount", "requests_human", "fraud_or_security"), "annotated")


@key("stream_exact_dedup", "select substr(sha1(whole), 1, 16) as hash, 1 as n from d_tokens group by 1")
def _(m: Models) -> DataFrame:
    messages = m.fx_messages.select("id", "text", F.col("received_at_utc").cast("timestamp").alias("received_at"))
    span = messages.agg(F.max("received_at").cast("long") - F.min("received_at").cast("long")).first()[0] or 0
    horizon = f"{span + 86_400} seconds"  # files come in any order of time, so no row may be late and no text forgotten
    kept = streams.run(streams.first_copies(streams.as_stream(m.spark, messages), horizon).select("id", "hash"), "firsts")
    return kept.groupBy("hash").agg(F.count("*").cast("int").alias("n"))


@key("stream_cdc_upsert", "select application_id, status, customer_id, is_deleted, is_out_of_order, n_events from d_applications")
def _(m: Models) -> DataFrame:
    upsert = streams.Upsert(m.spark)
    streams.drain(streams.as_stream(m.spark, m.fx_cdc), upsert)
    return upsert.state().select("application_id", "status", "customer_id", "is_deleted", "is_out_of_order", "n_events")


@key("incremental_fifo", "select loan_id, payment_id, installment_number, allocated from d_allocation")
def _(m: Models) -> DataFrame:
    """Payments as a stream of four batches in random order; a loan's payments come in several. Buckets, and files a batch, grow with the input."""
    laid, per_batch = streams.FifoStream(m.spark, m.installments, buckets=max(8, m.parts)), -(-m.parts // 4)
    streams.drain(streams.as_stream(m.spark, m.payments.select("loan_id", "payment_id", "paid_at_utc", "paid_date", "amount"), 4 * per_batch, per_batch), laid)
    return laid.allocation().select("loan_id", "payment_id", "installment_number", "allocated")


QUERIES = {n: (lambda spark, sf_dir, build=build: build(models(spark, sf_dir))) for n, (build, _) in MADE.items()}
ORACLES = {n: statement(sql) for n, (_, sql) in MADE.items()}
