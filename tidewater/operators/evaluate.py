"""Evaluation of predictions against gold labels, and label-aware samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.relational import nearest_rank
from tidewater.sources.shared import written

AUTO = ("auto_reply", "auto_reply_and_route")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))


def reason_metrics(df: DataFrame) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall, F1; a class without predictions or support scores zero.

    One pass gives each row to its gold and its predicted class.
    """
    sides = F.explode(F.array(F.struct(F.col("gold_reason").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col("pred_reason").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p"))))
    hit = (F.col("gold_reason") == F.col("pred_reason")).cast("int")
    per = df.select(sides.alias("x"), hit.alias("h")).groupBy("x.label").agg(F.sum("x.g").alias("support"), F.sum("x.p").alias("predicted"), F.sum(F.col("h") * F.col("x.g")).alias("hits"))
    per = per.withColumns({"precision": _ratio(F.col("hits"), F.col("predicted")), "recall": _ratio(F.col("hits"), F.col("support"))})
    return per.withColumn("f1", F.when(F.col("support") + F.col("predicted") > 0, F.round(2 * F.col("hits") / (F.col("support") + F.col("predicted")), 6)).otherwise(F.lit(0.0)))


def reason_summary(df: DataFrame) -> DataFrame:
    """Exact rate, lenient rate (a prediction among the gold secondary reasons counts) and macro F1 over gold classes."""
    exact = F.col("gold_reason") == F.col("pred_reason")
    lenient = exact | F.coalesce(F.col("pred_reason") == F.col("gold_secondary"), F.lit(False))
    rates = df.agg(F.count("*").alias("n"), F.round(F.avg(exact.cast("int")), 6).alias("exact"), F.round(F.avg(lenient.cast("int")), 6).alias("lenient"))
    macro = reason_metrics(df).where("support > 0").agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return rates.crossJoin(macro)


def confusion(df: DataFrame) -> DataFrame:
    return df.where("gold_reason <> pred_reason").groupBy("gold_reason", "pred_reason").agg(F.count("*").alias("n"))


def priority_metrics(df: DataFrame) -> DataFrame:
    d = F.col("pred_priority") - F.col("gold_priority")
    return df.agg(
        F.count("*").alias("n"), F.round(F.avg((d == 0).cast("int")), 6).alias("exact"), F.round(F.avg((F.abs(d) <= 1).cast("int")), 6).alias("within_one"),
        F.round(F.avg(F.abs(d)), 6).alias("mean_distance"), F.count_if(d < 0).alias("more_urgent"), F.count_if(d > 0).alias("less_urgent"),
    )


def action_metrics(df: DataFrame) -> DataFrame:
    """Unsafe: answered by machine where a person was wanted; conservative: the other way; mixed: only the routing differs."""
    gold, pred = F.col("gold_action"), F.col("pred_action")
    return df.agg(
        F.count("*").alias("n"), F.count_if(gold == pred).alias("exact"), F.count_if((gold == "route_to_human") & pred.isin(*AUTO)).alias("unsafe"),
        F.count_if(gold.isin(*AUTO) & (pred == "route_to_human")).alias("conservative"), F.count_if((gold != pred) & gold.isin(*AUTO) & pred.isin(*AUTO)).alias("auto_mixed"),
    )


def disagreements(df: DataFrame) -> DataFrame:
    return df.where("gold_reason <> pred_reason or gold_priority <> pred_priority or gold_action <> pred_action")


def run_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two runs over the same ids: share of equal labels and mean change of confidence."""
    both = a.select("id", F.col("label").alias("la"), F.col("confidence").alias("ca")).join(b.select("id", F.col("label").alias("lb"), F.col("confidence").alias("cb")), "id")
    return both.agg(F.count("*").alias("n"), F.round(F.avg((F.col("la") == F.col("lb")).cast("int")), 6).alias("same"), F.round(F.avg(F.abs(F.col("ca") - F.col("cb"))), 6).alias("mean_change"))


def rater_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.col("verdict").alias("va")).join(b.select("id", F.col("verdict").alias("vb")), "id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("va") == F.col("vb")).alias("agreed"))


def expectation_checks(df: DataFrame, expected: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each id and check: ``expected`` names (expected column, actual column); a null expectation is no check."""
    rows = F.explode(F.array_compact(F.array(*[
        F.when(F.col(e).isNotNull(), F.struct(F.lit(n).alias("check"), F.col(e).cast("string").alias("expected"), F.col(a).cast("string").alias("actual"))) for n, (e, a) in expected.items()
    ])))
    return df.select("id", rows.alias("c")).select("id", "c.*").withColumn("ok", F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)))


def fixture_checks(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """``id, check, ok`` for every expectation of a message: fourteen kinds, each in a column ``e_...`` that is null where nothing is expected.

    What came out stands beside: ``final_reason, action, priority, queue, reply_source, reply`` (null if none is sent), ``language, document_number, masked_values, calls, language_ok,
    verified`` and one boolean for each flag. Checks of a reply that must hold for any reply are made only if there is one. A null outcome is not what was expected.
    """
    flag = F.coalesce(*[F.when(F.col("e_flag") == f, F.col(f)) for f in flags])
    reply, sent = F.coalesce("reply", F.lit("")), F.col("reply").isNotNull()
    text = lambda c: F.col(c).cast("string")
    equal = lambda name, expected, actual: F.when(F.col(expected).isNotNull(), F.struct(F.concat(F.lit(name + " "), text(expected)).alias("check"), (F.col(expected) == F.col(actual)).alias("ok")))
    holds = lambda name, expected, ok, only=None: F.when(F.coalesce(F.col(expected), F.lit(False)) & (F.lit(True) if only is None else only), F.struct(F.lit(name).alias("check"), ok.alias("ok")))
    masked = F.array_contains("masked_values", F.col("e_masked_kept")) & ~F.contains(reply, F.col("e_masked_kept")) | ~sent
    single = F.array_compact(F.array(
        F.when(F.col("e_flag").isNotNull(), F.struct(F.concat(F.lit("flag "), F.col("e_flag")).alias("check"), flag.alias("ok"))),
        equal("reason", "e_reason", "final_reason"), equal("action", "e_action", "action"), equal("priority", "e_priority", "priority"), equal("queue", "e_queue", "queue"),
        holds("no reply sent", "e_no_reply", ~sent), equal("reply source", "e_reply_source", "reply_source"), equal("language", "e_language", "language"),
        holds("reply in Spanish", "e_reply_language_es", F.col("language_ok"), sent), holds("document number not extracted", "e_document_number_none", F.col("document_number").isNull()),
        F.when(F.col("e_masked_kept").isNotNull(), F.struct(F.lit("masked value kept masked").alias("check"), masked.alias("ok"))),
        equal("llm calls ==", "e_llm_calls", "calls"), holds("verifier passed", "e_verifier_passed_if_reply", F.col("verified"), sent),
    ))
    needles = F.transform(
        F.coalesce("e_reply_must_not_contain", F.array().cast("array<string>")),
        lambda x: F.struct(F.concat(F.lit("reply does not contain "), x).alias("check"), (~F.contains(F.lower(reply), F.lower(x))).alias("ok")),
    )
    return df.select("id", F.inline(F.concat(single, needles))).withColumn("ok", F.coalesce("ok", F.lit(False)))


def stratified_sample(df: DataFrame, label: str, n: int, least: int = 2) -> DataFrame:
    """``n`` rows: ``least`` of each class, the rest in proportion, largest remainder first; rows by hash of the id.

    Quotas come from the table of classes, and none is above ``n``. The first ``n`` of a class by hash are a limit that Spark
    applies in every task before the shuffle, so a class of any size sends few rows, and each quota is filled exactly.
    """
    classes = df.groupBy(label).agg(F.count("*").alias("size")).crossJoin(df.agg(F.count("*").alias("total")))
    base = F.least(F.lit(least), F.col("size"))
    classes = classes.withColumn("want", F.greatest(base.cast("double"), F.col("size") * n / F.col("total")))
    classes = classes.withColumn("low", F.least(F.col("size"), F.floor("want")))
    left = classes.agg((F.lit(n) - F.sum("low")).alias("left"))
    order = Window.orderBy(F.desc(F.col("want") - F.col("low")), label)
    quota = classes.crossJoin(left).withColumn("quota", F.least(F.col("size"), F.col("low") + F.when(F.row_number().over(order) <= F.col("left"), 1).otherwise(0)))
    quota = quota.select(F.col(label).alias("_label"), "quota")
    draw = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 13), 16, 10).cast("long").cast("double") / float(1 << 52)
    first = df.select("id", label, draw.alias("_d")).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_d", "id"))).where(F.col("_r") <= n)
    return first.join(quota, F.col(label) == F.col("_label")).where("_r <= quota").select("id", label)


def hard_first_sample(df: DataFrame, label: str, hard: Column, n: int, least: int = 2) -> DataFrame:
    """``id, label, tier`` of ``n`` rows: hard ones first, then ``least`` of each class, then always one of the class that is furthest below its share.

    A class's deficit is its share of ``n`` less what it has, and falls by one with each row it gets; so the rows filled in one by one are the ``n`` largest deficits of
    all classes' next, second next and further rows, ties to the greater label. Within a tier and class the order is by hash of the id. Every tier is a limit that Spark
    applies before the shuffle, so a class or a hard tier of any size sends few rows.
    """
    draw = F.substring(F.md5(F.col("id").cast("string")), 1, 13)
    rows = df.select("id", F.coalesce(F.col(label), F.lit("(null)")).alias("label"), F.coalesce(hard, F.lit(False)).alias("hard"), draw.alias("_d"))
    first = rows.where("hard").orderBy("_d", "id").limit(n)
    first = written(first.select("id", "label", F.lit("hard").alias("tier")), "hard")
    have = first.groupBy("label").agg(F.count("*").alias("have"))
    rest = rows.join(F.broadcast(first.select("id")), "id", "left_anti")  # n rows at most
    pools = rest.groupBy("label").agg(F.count("*").alias("pool"))
    classes = rows.groupBy("label").agg(F.count("*").alias("size")).join(have, "label", "left").join(pools, "label", "left").na.fill(0).crossJoin(rows.agg(F.count("*").alias("total")))
    classes = written(classes.withColumn("low", F.least(F.col("pool"), F.greatest(F.lit(0), least - F.col("have")))), "classes")
    left = n - (first.count() + (classes.agg(F.sum("low")).first()[0] or 0))
    unit = F.explode(F.when(F.col("pool") > F.col("low"), F.sequence(F.lit(1), F.least(F.col("pool") - F.col("low"), F.lit(n))))).alias("j")
    units = classes.select("label", (F.col("size") / F.col("total") * n - F.col("have") - F.col("low")).alias("deficit"), unit)
    filled = units.orderBy(F.desc(F.col("deficit") - F.col("j")), F.desc("label")).limit(max(left, 0)).groupBy("label").agg(F.count("*").alias("more"))
    quota = classes.join(filled, "label", "left").select(F.col("label").alias("_label"), "low", (F.col("low") + F.coalesce("more", F.lit(0))).alias("quota"))
    drawn = rest.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy("_d", "id"))).where(F.col("_r") <= n)
    drawn = drawn.join(quota, F.col("label") == F.col("_label")).where("_r <= quota")
    tiered = drawn.select("id", "label", F.when(F.col("_r") <= F.col("low"), "least").otherwise("fill").alias("tier"))
    rank = F.when(F.col("tier") == "hard", 0).when(F.col("tier") == "least", 1).otherwise(2)
    return first.unionByName(tiered).orderBy(rank, "label", "id").limit(n)


def capped_sample(df: DataFrame, label: str, n: int, most: int) -> DataFrame:
    """The first ``n`` by id with at most ``most`` of each class."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("id"))).where(f"_r <= {most}").drop("_r")
    return rows.orderBy("id").limit(n)


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return nearest_rank(df, keys, value, {"p50": 0.5, "p95": 0.95, "max": 1.0})
