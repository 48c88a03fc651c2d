"""Message queries over the derived views, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions import patterns as P
from tidewater.functions import scalar as S
from tidewater.operators import evaluate as E
from tidewater.operators import messages as M
from tidewater.plans.lending import Models, models
from tidewater.sources.oracle import NAMED, statement
from tidewater.sources.shared import new_path

MADE: dict = {}


def key(name: str, sql: str | None):
    def put(build):
        MADE[name] = (build, sql)
        return build

    return put


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q('(?i)' + pattern)})"


def _list(words) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


_TOKENS = "regexp_extract_all(strip_accents(lower(text)), '[a-z0-9]+')"

# Scalar functions and sources -------------------------------------------------------------------------------------

key("clean_text", r"select customer_id, nullif(trim(regexp_replace(city, '\s+', ' ', 'g')), '') as city from fx_customers")(lambda m: m.fx_customers.select("customer_id", S.clean_text(F.col("city")).alias("city")))
key("normalize_key", "select customer_id, nullif(regexp_replace(upper(strip_accents(city)), '[^A-Z0-9]', '', 'g'), '') as city_key from fx_customers")(lambda m: m.fx_customers.select("customer_id", S.normalize_key(F.col("city")).alias("city_key")))
key("parse_number", "select customer_id, try_cast(trim(replace(monthly_income, ',', '')) as decimal(18,2)) as income from fx_customers")(lambda m: m.fx_customers.select("customer_id", S.parse_number(F.col("monthly_income")).alias("income")))
key("loan_ref_extract", "select payment_id, cast(regexp_extract(loan_ref, '([0-9]+)$', 1) as bigint) as loan_id from fx_payments")(lambda m: m.fx_payments.select("payment_id", S.trailing_id(F.col("loan_ref")).alias("loan_id")))
key("minor_unit_scale", "select payment_id, amount from d_staged")(lambda m: m.fx_payments.select("payment_id", S.scale_minor_units(F.col("amount_raw"), F.col("source_system")).alias("amount")))
key("sentinel_to_null", "select event_pk, case when customer_id_raw <> 999999999 then customer_id_raw end as customer_id, customer_id_raw = 999999999 as is_placeholder from fx_cdc")(
    lambda m: m.fx_cdc.select("event_pk", F.nullif("customer_id_raw", F.lit(999999999).cast("bigint")).alias("customer_id"), (F.col("customer_id_raw") == 999999999).alias("is_placeholder"))
)
key("surrogate_key", "select merchant_id, md5(concat(merchant_id, '-', coalesce(category, '_null_'), '-', valid_from)) as sk from fx_merchants")(
    lambda m: m.fx_merchants.select("merchant_id", S.surrogate_key(F.col("merchant_id"), F.col("category"), F.col("valid_from")).alias("sk"))
)
key("message_time", """select id, received_at_utc as naive_bogota, cast(received_at_utc + interval 5 hour as timestamp) as utc_from_local, received_at_utc as utc_from_zoned from fx_messages""")(
    lambda m: m.fx_messages.withColumn("w", F.date_format(F.col("received_at_utc").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss")).select(
        "id", F.col("received_at_utc").cast("timestamp_ntz").alias("naive_bogota"), S.message_time(F.col("w")).alias("utc_from_local"), S.message_time(F.concat("w", F.lit("Z"))).alias("utc_from_zoned")
    )
)
key("message_text_norm", r"select id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) as text from fx_messages")(lambda m: m.fx_messages.select("id", S.message_text(F.col("text")).alias("text")))
key("canonical_tokens", f"select id, array_to_string({_TOKENS}, ' ') as tokens from fx_messages")(lambda m: m.fx_messages.select("id", F.array_join(S.canonical_tokens(F.col("text")), " ").alias("tokens")))
key("content_hash", f"select id, substr(sha1(array_to_string({_TOKENS}, ' ')), 1, 16) as hash from fx_messages")(lambda m: m.fx_messages.select("id", S.content_hash(S.canonical_tokens(F.col("text"))).alias("hash")))


@key("raw_text_scan", "select c_custkey::varchar as c_custkey, c_name, c_nationkey::varchar as c_nationkey, c_mktsegment from customer")
def _(m: Models) -> DataFrame:
    """A CSV extract with a header, written from a table and read with every column text."""
    path = new_path(m.spark, "extract")
    m.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.option("header", True).csv(path)
    return m.spark.read.schema("c_custkey string, c_name string, c_nationkey string, c_mktsegment string").option("header", True).csv(path)


#: Raw relations and what identifies a row of each.
RAW = {
    "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "lineitem": ("l_orderkey", "l_linenumber"), "events": ("event_id",),
}


@key("bronze_lineage", " union all ".join(
    f"select '{t}' as relation, " + " || '-' || ".join(f"cast({c} as varchar)" for c in ids) + f" as row_id, '{t}.parquet' as source_file, true as stamped from {t}" for t, ids in RAW.items()
))
def _(m: Models) -> DataFrame:
    """Every row of the raw relations with the file it came from; ``stamped`` holds the time of the build against that of the file."""
    rows = None
    for name, ids in RAW.items():
        raw = m.spark.read.parquet(f"{m.sf_dir}/{name}.parquet").select(
            F.lit(name).alias("relation"), F.concat_ws("-", *[F.col(c).cast("string") for c in ids]).alias("row_id"),
            F.col("_metadata.file_name").alias("source_file"), (F.current_timestamp() >= F.col("_metadata.file_modification_time")).alias("stamped"),
        )
        rows = raw if rows is None else rows.unionByName(raw)
    return rows


@key("nested_response_usage", "select id, reason as label, input_tokens, output_tokens, round(input_tokens * 3.0::double / 1e6 + output_tokens * 15.0::double / 1e6, 8) as cost from fx_labels")
def _(m: Models) -> DataFrame:
    """Stored nested JSON responses, written from a table and read back: usage, its cost, and a label inside a text field."""
    usage = F.struct("input_tokens", "output_tokens")
    content = F.array(F.struct(F.to_json(F.struct(F.col("reason").alias("primary_reason"))).alias("text")))
    path = new_path(m.spark, "responses")
    m.fx_labels.select(F.col("id").alias("item_id"), F.struct(usage.alias("usage"), content.alias("content")).alias("response")).write.json(path)
    schema = "item_id string, response struct<usage:struct<input_tokens:long,output_tokens:long>,content:array<struct<text:string>>>"
    label = F.from_json(F.col("response.content")[0]["text"], "primary_reason string")["primary_reason"]
    rows = m.spark.read.schema(schema).json(path).select(F.col("item_id").alias("id"), label.alias("label"), "response.usage.input_tokens", "response.usage.output_tokens")
    return rows.withColumn("cost", F.round(F.col("input_tokens") * 3.0 / 1e6 + F.col("output_tokens") * 15.0 / 1e6, 8))


_KNOWN = f"({', '.join(_q(r[0]) for r in P.REASONS)})"


@key("gold_labels", f"""select id, label, from_pre_label, label in {_KNOWN} as known, case when label not in {_KNOWN} then label end as rejected from (
  select id, coalesce(case when h % 11 = 0 then 'sin_categoria' when h % 3 = 1 then second_reason end, reason) as label, (case when h % 11 = 0 then 'sin_categoria' when h % 3 = 1 then second_reason end) is null as from_pre_label from fx_labels) x""")
def _(m: Models) -> DataFrame:
    """Labels by hand as CSV whose files start with a byte order mark, written from a table and read back; a blank cell takes the label set before, one outside the policy is rejected."""
    path = new_path(m.spark, "gold")
    given = F.when(F.col("h") % 11 == 0, "sin_categoria").when(F.col("h") % 3 == 1, F.col("second_reason")).otherwise(F.when(F.col("h") % 3 == 2, F.lit("  ")))
    m.fx_labels.select(F.col("id").alias("\ufeffid"), F.col("reason").alias("pre_label"), given.alias("gold")).write.csv(path, header=True, ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    read = m.spark.read.schema("id string, pre_label string, gold string").csv(path, header=True)
    gold = F.nullif(F.trim("gold"), F.lit(""))
    rows = read.select("id", F.coalesce(gold, "pre_label").alias("label"), gold.isNull().alias("from_pre_label"))
    known = F.col("label").isin(*[r[0] for r in P.REASONS])
    return rows.withColumns({"known": known, "rejected": F.when(~known, F.col("label"))})


@key("message_lines_scan", """select id, channel, text, cast(null as varchar) as corrupt from fx_messages
union all select null, null, null, concat('{"id": "', id, '", "channel') from fx_messages where length(text) % 5 = 0""")
def _(m: Models) -> DataFrame:
    """Messages as JSON lines with blank and broken lines between them, written from a table and read back: blank ones are skipped, broken ones come as they stand."""
    path = new_path(m.spark, "lines")
    odd = F.length("text") % 5 == 0
    lines = F.array(F.to_json(F.struct("id", "channel", "text")), F.when(F.length("text") % 3 == 0, F.lit("")), F.when(F.length("text") % 3 == 1, F.lit("   ")), F.when(odd, F.concat(F.lit('{"id": "'), "id", F.lit('", "channel'))))
    m.fx_messages.select(F.explode(F.array_compact(lines)).alias("value")).write.text(path)
    return m.spark.read.schema("id string, channel string, text string, corrupt string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="corrupt")


@key("result_records", """select id, action, priority, queue, reply_source, codes, len(gaps) as n_gaps, input_tokens from d_gapped""")
def _(m: Models) -> DataFrame:
    """Results as nested JSON lines, one record a message, written and read back."""
    path = new_path(m.spark, "results")
    rows = M.gap_routed(M.route(_final(m)))
    decision = F.struct("action", "priority", "queue", "codes", "gaps")
    rows.select("id", decision.alias("decision"), F.struct(F.col("reply_source").alias("source")).alias("draft_reply"), F.struct("input_tokens", "output_tokens").alias("processing")).write.json(path)
    schema = "id string, decision struct<action:string,priority:int,queue:string,codes:array<string>,gaps:array<string>>, draft_reply struct<source:string>, processing struct<input_tokens:long,output_tokens:long>"
    read = m.spark.read.schema(schema).json(path, mode="FAILFAST")
    return read.select("id", "decision.action", "decision.priority", "decision.queue", F.col("draft_reply.source").alias("reply_source"), F.array_join("decision.codes", ",").alias("codes"), F.size("decision.gaps").alias("n_gaps"), "processing.input_tokens")


@key("section_split", r"""select doc, concat(doc, '.', place) as section_id, trim(regexp_extract(part, '^([^\n]*)', 1)) as heading, trim(regexp_replace(part, '^[^\n]*\n?', '')) as body
from (select doc_id as doc, generate_subscripts(parts, 1) - 1 as place, unnest(parts) as part from (
  select doc_id, string_split_regex(concat('intro', chr(10), '## ', regexp_replace(text, '\n([A-Ma-m])', chr(10) || '## \1', 'g')), '\n##[ \t]+')[2:] as parts from documents) x) y""")
def _(m: Models) -> DataFrame:
    """Whole texts with every line that starts with a letter up to m as a heading; the lines after it are its body."""
    headed = F.regexp_replace("text", r"\n([A-Ma-m])", "\n## $1")
    return M.section_split(m.documents.select("doc_id", F.concat(F.lit("intro\n## "), headed).alias("text")), "doc_id", "text")


# Duplicates -------------------------------------------------------------------------------------------------------

NAMED["d_tokens"] = f"select id, text, received_at_utc, list_sort(list_distinct({_TOKENS})) as tokens, array_to_string({_TOKENS}, ' ') as whole from fx_messages"
NAMED["d_sets"] = "select tokens, min(id) as rep from d_tokens where len(tokens) > 0 group by 1"
NAMED["d_pairs"] = """select a.rep as a, b.rep as b, round(len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(a.tokens || b.tokens)), 6) as jaccard
from d_sets a join d_sets b on a.rep < b.rep where len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(a.tokens || b.tokens)) >= 0.6"""
key("exact_duplicates", """select id, case when f <> id then f end as duplicate_of from (
  select id, case when whole <> '' then first_value(id) over (partition by whole order by received_at_utc, id) else id end as f from d_tokens) x""")(lambda m: M.exact_duplicates(m.fx_messages))
key("near_duplicate_pairs", "select * from d_pairs")(lambda m: M.near_duplicate_pairs(m.fx_messages))


@key("near_duplicate_groups", """select id, dense_rank() over (order by head_at, head_id) as group_id from (
  select id, min_by(received_at_utc, (received_at_utc, id)) over w as head_at, min_by(id, (received_at_utc, id)) over w as head_id, count(*) over w as n from (
    select t.id, t.received_at_utc, coalesce(c.component, s.rep) as component from d_tokens t join d_sets s on s.tokens = t.tokens left join d_components c on c.node = s.rep) x
  window w as (partition by component)) y where n > 1""")
def _(m: Models) -> DataFrame:
    return M.near_duplicate_groups(m.fx_messages)


NAMED["d_edges"] = "select a, b from d_pairs union all select b, a from d_pairs"
NAMED["d_components"] = """select node, min(reached) as component from (
  with recursive walk(node, reached) as (select a, a from d_edges union select w.node, e.b from walk w join d_edges e on e.a = w.reached) select * from walk) x group by 1"""

# Rules and entities -----------------------------------------------------------------------------------------------

NAMED["d_rules"] = f"""select *, {_TOKENS} as t, len({_TOKENS}) as n, list_filter({_TOKENS}, lambda x: not regexp_full_match(x, '[0-9]+')) as words from fx_messages"""
NAMED["d_tier0"] = f"""select id, case when length(trim(text)) < 3 or n = 0 then 'T0_EMPTY_OR_PUNCTUATION' when {_has('text', P.TEST_WORDS)} and n <= 6 then 'T0_TEST_MESSAGE'
  when n <= 6 and (len(words) = 0 or len(list_filter(words, lambda x: not regexp_matches(x, '[aeiou]') or regexp_matches(x, '[bcdfghjklmnpqrstvwxyz]{{4,}}'))) * 2 >= len(words)) then 'T0_GIBBERISH'
  when n <= 4 and len(list_filter(t, lambda x: x not in ({', '.join(map(_q, P.GREETING))}))) = 0 then 'T0_GREETING_ONLY'
  when ((n <= 9 and len(list_filter(t, lambda x: x not in ({', '.join(map(_q, P.THANKS + P.GREETING))}))) = 0 and list_contains(t, 'gracias'))
    or (n <= 4 and len(list_filter(t, lambda x: x not in ({', '.join(map(_q, P.THANKS))}))) = 0)) and not {_has('text', P.PRAISE)} then 'T0_CLOSING_THANKS' end as code from d_rules"""
key("tier0_rules", "select * from d_tier0")(lambda m: m.fx_messages.select("id", M.tier0(F.col("text")).alias("code")))
NAMED["d_flags"] = "select *, " + ", ".join(f"{_has('text', p)} as {n}" for n, p in P.FLAGS.items()) + " from fx_messages"
key("flag_detectors", "select id, " + ", ".join(P.FLAGS) + " from d_flags")(lambda m: m.fx_messages.select("id", *[c.alias(n) for n, c in M.flags(F.col("text")).items()]))


def _x(pattern: str, group: int) -> str:
    return f"nullif(regexp_extract(text, {_q('(?i)' + pattern)}, {group}), '')"


_AMOUNT = P.AMOUNT.replace(r"(?!\s*(?:de|del)\b)", "")  # DuckDB has no lookahead; no bare number of the view stands before "de"
NAMED["d_entities"] = f"""select id, text, {_x(P.CREDIT, 1)} as credit_number, {_x(P.DOCUMENT, 1)} as document_number, regexp_extract_all(text, {_q('(?i)' + _AMOUNT)}) as amounts,
  coalesce({', '.join(_x(p, 1) for p in P.PAYMENT_DATES)}) as payment_date, {_x(P.REFERENCE, 1)} as reference, regexp_extract_all(text, {_q('(?i)' + P.METHOD)}) as methods, regexp_extract_all(text, {_q('(?i)' + P.MASKED)}) as masked_values,
  nullif(regexp_extract(text, {_q(P.AGENT)}, 1), '') as agent from fx_messages"""
NAMED["d_extracted"] = f"""select id, text, credit_number, document_number, list_filter(amounts, lambda a: regexp_replace(a, '[^0-9]', '', 'g') <> coalesce(credit_number, '') and regexp_replace(a, '[^0-9]', '', 'g') <> coalesce(document_number, ''))[1] as amount, payment_date,
  case when reference is distinct from credit_number then reference end as transaction_reference, methods[1] as payment_method, case when lower(agent) not in ({', '.join(map(_q, P.NOT_AGENTS))}) then agent end as named_agent from d_entities"""
key("entity_extract", "select id, credit_number, document_number, amount, payment_date, transaction_reference, payment_method, named_agent from d_extracted")(lambda m: M.entities(m.fx_messages).select("id", *M.ENTITIES))
key("entity_verbatim_check", "select id, case when contains(lower(text), lower(predicted_payment_method)) then predicted_payment_method end as payment_method from fx_labels")(
    lambda m: M.verbatim(M.entities(m.fx_labels).withColumn("payment_method", F.col("predicted_payment_method"))).select("id", "payment_method")
)
key("entity_merge", "select l.id, coalesce(e.payment_method, case when contains(lower(l.text), lower(predicted_payment_method)) then predicted_payment_method end) as payment_method, e.amount from fx_labels l join d_extracted e using (id)")(
    lambda m: M.merge_entities(M.entities(m.fx_labels)).select("id", "payment_method", "amount")
)
key("pii_scan", f"select id, document_number is not null or regexp_matches(text, {_q(P.CARD)}) as pii from d_extracted")(lambda m: M.entities(m.fx_messages).select("id", M.pii_present(F.col("text"), F.col("document_number")).alias("pii")))
NAMED["d_topics"] = "select id, case " + " ".join(f"when {_has('text', p)} then {_q(n)}" for n, p in P.TOPICS) + " else '(no keyword match)' end as topic from fx_messages"
key("keyword_bucketing", "select topic, count(*) as n, min(id) as example from d_topics group by 1")(lambda m: m.fx_messages.select("id", M.topic(F.col("text")).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("example")))
_CAPITALS = r"length(regexp_replace(text, '[^\p{Lu}]', ''@)) > 0.5 * greatest(length(regexp_replace(text, '[^\p{L}]', ''@)), 1)"
NAMED["d_lengths"] = "select unnest([channel, '(all)']) as channel, length(text) as w, " + _CAPITALS.replace("@", ", 'g'") + " as shouted from fx_messages"
key("message_profile", """select channel, count(*) as n, min(w) as shortest, max(w) filter (where r = floor(c / 2.0::double) + 1) as median, max(w) filter (where r = floor(c * 0.9::double) + 1) as p90, max(w) as longest, round(count(*) filter (where shouted)::double / count(*), 6) as capitals
from (select *, row_number() over (partition by channel order by w) as r, count(*) over (partition by channel) as c from d_lengths) x group by 1""")(
    lambda m: M.length_profile(m.fx_messages).join(
        m.fx_messages.select(F.explode(F.array("channel", F.lit("(all)"))).alias("channel"), F.expr(_CAPITALS.replace("@", "").replace("\\", "\\\\")).alias("s")).groupBy("channel").agg(F.round(F.avg(F.col("s").cast("int")), 6).alias("capitals")), "channel"
    )
)

key("signal_counts", " union all ".join(
    f"select {_q(n)} as signal, count(*) as n, min(id) as example from fx_messages where {test}"
    for n, test in [*((n, _has("text", p.replace(r"(?! ?\d)", r"(?:$|[^\d ]| $| \D)"))) for n, p in P.SIGNALS.items()), ("capitals", r"length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 0.5 * greatest(length(regexp_replace(text, '[^\p{L}]', '', 'g')), 1)")]
))(lambda m: M.signal_counts(m.fx_messages))
_SENDER = "case when sender like '+%' then 'phone' when sender like 'cliente|_%' escape '|' then 'client_id' else 'email' end"
key("message_shapes", f"""select 'channel' as measure, channel as value, count(*) as n from fx_messages group by 2
union all select 'timestamp', regexp_replace(cast(received_at_utc as varchar), '[0-9]', '9', 'g'), count(*) from fx_messages group by 2 union all select 'sender', {_SENDER}, count(*) from fx_messages group by 2""")(
    lambda m: m.fx_messages.select(F.inline(F.array(
        F.struct(F.lit("channel").alias("measure"), F.col("channel").alias("value")), F.struct(F.lit("sender").alias("measure"), F.expr(_SENDER).alias("value")),
        F.struct(F.lit("timestamp").alias("measure"), F.regexp_replace(F.col("received_at_utc").cast("string"), "[0-9]", "9").alias("value")),
    ))).groupBy("measure", "value").agg(F.count("*").alias("n"))
)
key("busiest_day", "select cast(received_at_utc as date) as day, count(*) as n from fx_messages group by 1 order by n desc, day limit 1")(
    lambda m: m.fx_messages.groupBy(F.to_date("received_at_utc").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)
)

# Predictions, routing, replies ------------------------------------------------------------------------------------


def _final(m: Models) -> DataFrame:
    second = F.array_compact(F.array("second_reason"))
    return M.finalize(m.fx_labels.withColumn("secondary", second))


NAMED["d_final"] = f"""select *, moved or in_second as to_flag, case when moved then second_reason else reason end as final_reason,
  case when moved or second_reason is null or second_reason = reason or in_second then null else second_reason end as final_second,
  requests_human or reason = 'hablar_con_humano' or in_second as human, fraud_or_security or (case when moved then second_reason else reason end) = 'fraude_seguridad' as fraud
from (select l.*, {', '.join('f.' + n for n in P.FLAGS)}, coalesce(l.reason = 'hablar_con_humano' and l.second_reason <> l.reason, false) as moved,
  coalesce(l.reason <> 'hablar_con_humano' and l.second_reason = 'hablar_con_humano', false) as in_second from fx_labels l join d_flags f using (id)) x"""
key("prediction_finalize", """select id, final_reason, final_second as second, human as requests_human, fraud as fraud_or_security,
  case when final_reason = 'fuera_de_alcance' then coalesce(out_of_scope_kind, 'unrelated') end as final_kind from d_final""")(
    lambda m: _final(m).select("id", "final_reason", F.get("final_secondary", F.lit(0)).alias("second"), "requests_human", "fraud_or_security", "final_kind")
)
key("duplicate_label_reuse", """select l.id, coalesce(o.reason, l.reason) as reason from fx_labels l left join (
  select id, first_value(id) over (partition by whole order by received_at_utc, id) as f, whole from d_tokens) d using (id) left join fx_labels o on o.id = d.f and d.whole <> ''""")(
    lambda m: M.reuse_labels(m.fx_labels, M.exact_duplicates(m.fx_messages), ["reason"]).select("id", "reason")
)
NAMED["d_policy"] = "select * from (values " + ", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])}, {_q(r[3])}, {r[4]}, {_q(r[5])})" for r in P.REASONS) + ") p(final_reason, coverage, default_action, default_queue, base_priority, source)"
NAMED["d_over"] = """select f.*, p.* exclude (final_reason), coalesce(q.base_priority, 4) as second_priority, case when p.default_queue <> 'none' then p.default_queue else 'cx_general' end as general,
  case when prompt_injection_suspected then 'OVR_INJECTION' when fraud then 'OVR_FRAUD' when human then 'OVR_HUMAN' when legal_threat or collections_harassment then 'OVR_LEGAL'
    when f.final_reason = 'privacidad_habeas_data' or final_second = 'privacidad_habeas_data' then 'OVR_HABEAS' when confidence < 0.6 then 'OVR_LOW_CONFIDENCE' when p.coverage = 'none' and p.source = 'none' then 'OVR_NO_POLICY'
    when f.final_reason = 'fuera_de_alcance' and coalesce(out_of_scope_kind, 'unrelated') = 'other_business_inquiry' then 'OVR_OOS_SALES' end as override
from d_final f join d_policy p on p.final_reason = f.final_reason left join d_policy q on q.final_reason = f.final_second"""
NAMED["d_acted"] = """select *, case when override in ('OVR_FRAUD', 'OVR_LEGAL', 'OVR_HABEAS') then 'auto_reply_and_route' when override is not null then 'route_to_human' else default_action end as act,
  case override when 'OVR_INJECTION' then 'cx_general' when 'OVR_FRAUD' then 'fraude' when 'OVR_LEGAL' then 'pqr_legal' when 'OVR_HABEAS' then 'datos_privacidad' when 'OVR_OOS_SALES' then 'comercial' when 'OVR_HUMAN' then general when 'OVR_LOW_CONFIDENCE' then general when 'OVR_NO_POLICY' then general else default_queue end as q,
  least(base_priority, second_priority, case override when 'OVR_FRAUD' then 0 when 'OVR_LEGAL' then 1 when 'OVR_INJECTION' then 2 when 'OVR_HUMAN' then 2 when 'OVR_HABEAS' then 2 when null then 4 else case when override is null then 4 else 3 end end) as p0,
  coalesce(override, '') in ('OVR_INJECTION', 'OVR_HUMAN', 'OVR_LOW_CONFIDENCE', 'OVR_NO_POLICY', 'OVR_OOS_SALES') as no_draft from d_over"""
NAMED["d_sourced"] = """select *, case when override = 'OVR_FRAUD' then 'security_ack' when source = 'template' and act like 'auto%' and not no_draft then case final_reason when 'saludo_incompleto' then 'greeting_prompt' when 'felicitacion_feedback' then 'feedback_thanks' else 'unrelated' end end as template,
  greatest(0, case when vulnerable_customer then least(greatest(p0 - 1, 0), 1) else p0 end - imminent_deadline::int - repeat_contact::int) as priority from d_acted"""
NAMED["d_routed"] = """select *, case when lost then 'route_to_human' else act end as action,
  case when (lost or act = 'route_to_human') then case when q = 'none' then general else q end when act in ('close_no_reply', 'auto_reply') then 'none' else q end as queue,
  case when template is not null then 'template' when drafted then 'llm' else 'none' end as reply_source, [1, 4, 24, 48, null][priority + 1] as sla_hours
from (select *, act like 'auto%' and not no_draft and template is null and source = 'llm' and coverage in ('full', 'partial') as drafted,
  act like 'auto%' and template is null and not (not no_draft and source = 'llm' and coverage in ('full', 'partial')) as lost from d_sourced) x"""
key("route_decision", "select id, final_reason, override, action, queue from d_routed")(lambda m: M.route(_final(m)).select("id", "final_reason", "override", "action", "queue"))
key("priority_calc", "select id, priority, sla_hours from d_routed")(lambda m: M.route(_final(m)).select("id", "priority", "sla_hours"))
key("reply_source_resolution", "select id, template, reply_source from d_routed")(lambda m: M.route(_final(m)).select("id", "template", "reply_source"))
NAMED["d_gaps"] = "select id, final_reason, list_filter([" + ", ".join(f"case when final_reason = {_q(r)} and {_has('text', p)} then {_q(g)} end" for r, p, g in P.GAPS) + "], lambda x: x is not null) as gaps from d_final"
NAMED["d_gapped"] = """select id, final_reason, coverage, reply_source, confidence, priority, input_tokens, output_tokens, cached_tokens, gaps, case when up then 'auto_reply_and_route' else action end as action, case when up and queue = 'none' then general else queue end as queue,
  concat_ws(',', override, case when lost then 'NO_REPLY_SOURCE' end, case when len(gaps) > 0 then 'KNOWN_GAP' end, case when up then 'GAP_ROUTED' end) as codes
from (select r.* exclude (act), g.gaps, len(g.gaps) > 0 and r.action = 'auto_reply' and r.reply_source <> 'none' as up from d_routed r join d_gaps g using (id)) x"""
key("known_gap_detection", "select id, array_to_string(gaps, ';') as gaps, action, queue, codes from d_gapped")(
    lambda m: M.gap_routed(M.route(_final(m))).select("id", F.array_join("gaps", ";").alias("gaps"), "action", "queue", F.array_join("codes", ",").alias("codes"))
)
_LISTED = lambda of: "case {0} " + " ".join(f"when {_q(k)} then [{', '.join(map(_q, v))}]" for k, v in of.items()) + " else [] end"
NAMED["d_sections"] = f"select id, {_LISTED(P.SECTIONS).format('final_reason')} || {_LISTED(P.SECTIONS).format('final_second')} || {_LISTED(P.EXTRA_SECTIONS).format('override')} as l from d_over"
key("allowed_sections", "select id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') as allowed from d_sections")(
    lambda m: M.allowed_sections(M.route(_final(m))).select("id", F.array_join("allowed", ";").alias("allowed"))
)
_PRICES = {"input_tokens": 3.0, "output_tokens": 15.0, "cached_tokens": 0.3}
_GROUPED = """select id, group_id from (select id, dense_rank() over (order by head_at, head_id) as group_id from (
  select id, min_by(received_at_utc, (received_at_utc, id)) over w as head_at, min_by(id, (received_at_utc, id)) over w as head_id, count(*) over w as n from (
    select t.id, t.received_at_utc, coalesce(c.component, s.rep) as component from d_tokens t join d_sets s on s.tokens = t.tokens left join d_components c on c.node = s.rep) x
  window w as (partition by component)) y where n > 1) z"""
NAMED["d_totals"] = f"""select count(*)::double as messages, count(*) filter (where reply_source <> 'none') as replies_ready, count(*) filter (where reply_source <> 'none' and action like 'auto%') as auto_answerable, count(*) filter (where action in ('auto_reply_and_route', 'route_to_human')) as cases_opened,
  count(*) filter (where reply_source = 'llm') as drafts, count(*) filter (where len(gaps) > 0 and coverage = 'none') as gaps_no_policy, count(*) filter (where len(gaps) > 0 and coverage <> 'none') as gaps_partly_covered,
  count(*) filter (where confidence < 0.6) as low_confidence, count(*) filter (where final_reason is null) as unclassified, sum(input_tokens) as input_tokens, sum(output_tokens) as output_tokens, sum(cached_tokens) as cached_tokens,
  round(sum(input_tokens * 3.0::double / 1e6 + output_tokens * 15.0::double / 1e6 + cached_tokens * 0.3::double / 1e6), 6) as cost_usd,
  round(count(*) filter (where reply_source <> 'none' and action like 'auto%')::double / count(*)::double, 4) as auto_answerable_share,
  (select count(*) from (select case when whole <> '' then first_value(id) over (partition by whole order by received_at_utc, id) else id end as f, id from d_tokens) q where f <> id) as exact_duplicates,
  (select count(*) from (select group_id from ({_GROUPED}) g group by 1) h) as near_groups, (select count(*) from ({_GROUPED}) g) as near_messages, (select coalesce(max(k), 0) from (select count(*) as k from ({_GROUPED}) g group by group_id) h) as largest_group
from d_gapped"""
_MEASURES = ("messages", "replies_ready", "auto_answerable", "cases_opened", "drafts", "gaps_no_policy", "gaps_partly_covered", "low_confidence", "unclassified", "input_tokens", "output_tokens", "cached_tokens", "cost_usd", "auto_answerable_share", "exact_duplicates", "near_groups", "near_messages", "largest_group")
key("batch_totals", " union all ".join(f"select '{n}' as measure, {n}::double as value from d_totals" for n in _MEASURES))(
    lambda m: M.batch_totals(M.gap_routed(M.route(_final(m))), M.exact_duplicates(m.fx_messages), M.near_duplicate_sizes(m.fx_messages), _PRICES)
)
key("queue_priority_matrix", "select queue, " + ", ".join(f"count(*) filter (where priority = {p}) as p{p}" for p in range(5)) + ", count(*) as cases from d_gapped where action in ('auto_reply_and_route', 'route_to_human') and queue <> 'none' group by 1")(
    lambda m: M.queue_matrix(M.gap_routed(M.route(_final(m))))
)
key("gap_details", """select final_reason, coverage, count(*) as n, count(distinct gap) as kinds, string_agg(distinct gap, '; ' order by gap) as texts from (select final_reason, coverage, unnest(gaps) as gap from d_gapped) x group by 1, 2""")(
    lambda m: M.gap_routed(M.route(_final(m))).select("final_reason", "coverage", F.explode("gaps").alias("gap")).groupBy("final_reason", "coverage").agg(
        F.count("*").alias("n"), F.countDistinct("gap").alias("kinds"), F.array_join(F.array_sort(F.collect_set("gap")), "; ").alias("texts")  # texts of the policy's few known gaps
    )
)


def _checked(m: Models) -> DataFrame:
    replies = m.fx_replies.select("id", "reply", "message", F.array_compact(F.array("cited")).alias("citations"), F.array("allowed").alias("allowed"), "document_number", "uncovered", "can_answer")
    return M.reply_checks(replies, m.fx_sections)


_DIGITS = r"list_transform(regexp_extract_all({0}, '\d[\d.,]*'), lambda x: regexp_replace(x, '[^0-9]', '', 'g'))"
_WORDED = "list_transform(regexp_extract_all({0}, " + _q("(?i)" + P.WORD_NUMBER).replace("{", "{{").replace("}", "}}") + ", 1), lambda x: case lower(x) " + " ".join(f"when '{w}' then '{n}'" for w, n in (P.NUMBER_WORDS | P.ORDINALS).items()) + " end)"
_NUM = f"({_DIGITS} || {_WORDED})"
NAMED["d_checked"] = f"""select r.id, (cited = allowed) is true and s.section_id is not null as citations_ok,
  len(list_filter({_NUM.format('reply')}, lambda x: not list_contains({_DIGITS.format("coalesce(body, '')")} || {_NUM.format('message')}, x))) = 0 as numbers_ok,
  not ({' or '.join(f"contains(array_to_string(regexp_extract_all(strip_accents(lower(reply)), '[a-z0-9]+'), ' '), {_q(p)})" for p in P.FORBIDDEN)}) as forbidden_phrases_ok,
  not coalesce(contains(regexp_replace(reply, '[^0-9]', '', 'g'), document_number), false) and not regexp_matches(reply, {_q(P.CARD)}) as no_document_echo_ok,
  len(list_filter(string_split_regex(reply, '\\s+'), lambda x: x <> '')) between 8 and 160 as length_ok,
  len(list_filter(regexp_extract_all(strip_accents(lower(reply)), '[a-z0-9]+'), lambda x: x in ({', '.join(map(_q, P.SPANISH))}))) >= 3 and not {_has('reply', P.ENGLISH)} as language_ok,
  not regexp_matches(reply, {_q(P.PLACEHOLDER)}) as no_placeholders_ok, not contains(reply, '@') or contains(coalesce(body, ''), 'x@y.co') as contact_details_ok
from fx_replies r left join fx_sections s on s.section_id = r.cited"""
key("reply_policy_checks", "select * from d_checked")(lambda m: _checked(m).select("id", *[f"{c}_ok" for c in M.CHECKS]))
_FAILED = "list_filter([" + ", ".join(f"case when not {c}_ok then 'VERIFIER_{c.upper()}' end" for c in M.CHECKS) + "], lambda x: x is not null)"
key("reply_outcome", f"""select id, array_to_string(case when not can_answer then ['DRAFT_NOT_ANSWERABLE'] when len(failed) = 0 then list_filter(['DRAFT_VERIFIED', case when uncovered is not null then 'GAP_ROUTED' end], lambda x: x is not null) else failed end, ',') as codes,
  case when not can_answer or len(failed) > 0 then 'route_to_human' when uncovered is not null then 'auto_reply_and_route' else 'auto_reply' end as final_action,
  case when not can_answer then coalesce(uncovered, 'The allowed sections do not answer the request.') when len(failed) = 0 then uncovered end as policy_gap
from (select c.id, {_FAILED} as failed, can_answer, uncovered from d_checked c join fx_replies r using (id)) x""")(
    lambda m: M.reply_outcome(_checked(m)).select("id", F.array_join("reply_codes", ",").alias("codes"), "final_action", "policy_gap")
)
#: What is expected of messages, from a number made of each; the same text on both sides.
_EXPECTED = {
    "e_flag": "case h % 5 when 0 then 'requests_human' when 1 then 'fraud_or_security' when 2 then 'vulnerable_customer' end", "e_reason": "case when h % 3 = 0 then reason end", "e_action": "case h % 4 when 0 then 'route_to_human' when 1 then 'auto_reply' end",
    "e_priority": "case when h % 3 = 1 then h % 5 end", "e_queue": "case h % 7 when 0 then 'cx_general' when 1 then 'none' end", "e_no_reply": "case when h % 8 = 0 then true end", "e_reply_source": "case when h % 9 < 3 then 'llm' end",
    "e_language": "case when h % 4 = 2 then 'es' end", "e_reply_language_es": "case when h % 2 = 0 then true end", "e_document_number_none": "case when h % 12 < 4 then true end", "e_masked_kept": "case when h % 13 < 3 then '1.0xx.xxx.xxx' end",
    "e_llm_calls": "case when h % 14 < 5 then 1 + h % 2 end", "e_verifier_passed_if_reply": "case when h % 3 = 2 then true end",
}
_LANGUAGE = "case when lower(text) like '% der %' then 'de' when lower(text) like '% les %' then 'fr' when lower(text) like '% el %' or lower(text) like '%hola%' then 'es' else 'en' end"
_PASSED = " and ".join(f"{c}_ok" for c in M.CHECKS)
NAMED["d_outcomes"] = f"""select r.id, r.final_reason, r.priority, r.reply_source, g.action, g.queue, case when r.reply_source <> 'none' then f.reply end as reply, {_LANGUAGE.replace('text', 'r.text')} as language, e.document_number, regexp_extract_all(r.text, {_q('(?i)' + P.MASKED)}) as masked_values,
  case when r.reply_source = 'llm' then 2 else 1 end as calls, c.language_ok, {_PASSED} as verified, r.human as requests_human, r.fraud as fraud_or_security, r.vulnerable_customer, {', '.join(f"{sql.replace('h %', 'r.h %').replace('reason end', 'r.reason end')} as {n}" for n, sql in _EXPECTED.items())},
  case when r.h % 11 < 4 then ['te devolvemos', 'cuota 1'] else [] end as needles
from d_routed r join d_gapped g using (id) join fx_replies f using (id) join d_checked c using (id) join d_extracted e using (id)"""
_EQUAL = (("reason", "e_reason", "final_reason"), ("action", "e_action", "action"), ("priority", "e_priority", "priority"), ("queue", "e_queue", "queue"), ("reply source", "e_reply_source", "reply_source"), ("language", "e_language", "language"), ("llm calls ==", "e_llm_calls", "calls"))
_HELD = (
    ("no reply sent", "e_no_reply", "reply is null"), ("reply in Spanish", "e_reply_language_es and reply is not null", "language_ok"), ("document number not extracted", "e_document_number_none", "document_number is null"),
    ("masked value kept masked", "e_masked_kept is not null", "(list_contains(masked_values, e_masked_kept) and not contains(coalesce(reply, ''), e_masked_kept)) or reply is null"), ("verifier passed", "e_verifier_passed_if_reply and reply is not null", "verified"),
)
key("fixture_checks", "select id, \"check\", coalesce(ok, false) as ok from (" + " union all ".join([
    "select id, concat('flag ', e_flag) as \"check\", case e_flag when 'requests_human' then requests_human when 'fraud_or_security' then fraud_or_security else vulnerable_customer end as ok from d_outcomes where e_flag is not null",
    *(f"select id, concat('{n} ', {e}), {e} = {a} from d_outcomes where {e} is not null" for n, e, a in _EQUAL), *(f"select id, '{n}', {ok} from d_outcomes where {e}" for n, e, ok in _HELD),
    "select id, concat('reply does not contain ', needle), not contains(lower(coalesce(reply, '')), lower(needle)) from (select *, unnest(needles) as needle from d_outcomes) n",
]) + ") x")(lambda m: E.fixture_checks(_outcomes(m), list(P.FLAGS)))


def _outcomes(m: Models) -> DataFrame:
    """What became of each message, with what was expected of it."""
    routed = M.route(_final(m))
    gapped = M.gap_routed(routed).select("id", "action", "queue")
    replies = m.fx_replies.select("id", F.col("reply").alias("_reply"))
    verified = F.lit(True)
    for c in M.CHECKS:
        verified = verified & F.col(f"{c}_ok")
    checked = _checked(m).select("id", "language_ok", verified.alias("verified"))
    found = M.entities(m.fx_messages).select("id", "document_number", "masked_values")
    rows = routed.drop("action", "queue").join(gapped, "id").join(replies, "id").join(checked, "id").join(found, "id")
    rows = rows.withColumns({"reply": F.when(F.col("reply_source") != "none", F.col("_reply")), "language": F.expr(_LANGUAGE), "calls": F.when(F.col("reply_source") == "llm", 2).otherwise(1), "e_reply_must_not_contain": F.expr("case when h % 11 < 4 then array('te devolvemos', 'cuota 1') end")})
    return rows.withColumns({n: F.expr(sql) for n, sql in _EXPECTED.items()})


key("batch_summary", " union all ".join(
    f"select '{s}' as section, cast({k} as varchar) as key, count(*) as n from d_routed group by 2" for s, k in (("channel", "channel"), ("reason", "final_reason"), ("priority", "'P' || priority"), ("action", "action"), ("queue", "queue"), ("reply_source", "reply_source"))
) + "".join(f" union all select 'flag', '{f}', count(*) from d_routed where {dict(requests_human='human', fraud_or_security='fraud').get(f, f)} having count(*) > 0" for f in P.FLAGS) + " union all select 'quality', 'low_confidence', count(*) from d_routed where confidence < 0.6")(lambda m: M.batch_summary(M.route(_final(m))))
key("reason_breakdown", """select final_reason, count(*) as n, round(count(*)::double / (select count(*) from d_routed), 6) as share, count(*) filter (where reply_source <> 'none') as ready, count(*) filter (where queue <> 'none') as cases, round(avg(confidence), 6) as confidence, min(confidence) as least_confidence
from d_routed group by 1""")(lambda m: M.reason_breakdown(M.route(_final(m))))
key("usage_rollup", """select reason as label, count(*) as calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, sum(cached_tokens)::bigint as cached_tokens, round(sum(c), 8) as cost, round(avg(c), 10) as mean_cost,
  round(sum(cached_tokens)::double / (sum(cached_tokens) + sum(input_tokens))::double, 6) as cached_share from (select *, input_tokens * 3.0::double / 1e6 + output_tokens * 15.0::double / 1e6 + cached_tokens * 0.3::double / 1e6 as c from fx_labels) x group by 1""")(
    lambda m: M.usage_rollup(m.fx_labels.withColumnRenamed("reason", "label"), {"input_tokens": 3.0, "output_tokens": 15.0, "cached_tokens": 0.3})
)

QUERIES = {n: (lambda spark, sf_dir, build=build: build(models(spark, sf_dir))) for n, (build, _) in MADE.items()}
ORACLES = {n: statement(sql) for n, (_, sql) in MADE.items() if sql}
