"""Message operators: duplicates, rules, entities, routing, reply checks and summaries, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import patterns as P
from tidewater.functions.scalar import canonical_tokens, content_hash
from tidewater.operators.graph import connected_components
from tidewater.operators.relational import at_ranks, in_ranges
from tidewater.sources.shared import written

CONFIDENCE = 0.6
AUTO = ("auto_reply", "auto_reply_and_route")


def has(text: Column, pattern: str) -> Column:
    """Search without regard to case, with Unicode classes."""
    return text.rlike("(?iuU)" + pattern)


def first(text: Column, pattern: str, group: int = 0, flags: str = "(?iuU)") -> Column:
    return F.nullif(F.regexp_extract(text, flags + pattern, group), F.lit(""))


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit("(?iuU)" + pattern), F.lit(0))


# Duplicates -------------------------------------------------------------------------------------------------------


def exact_duplicates(messages: DataFrame) -> DataFrame:
    """``id, duplicate_of``: the first message by (time, id) of the same tokens; messages without tokens match nothing.

    The first id is a minimum per hash, so a hot text meets only in partial minima.
    """
    rows = messages.withColumn("_t", canonical_tokens(F.col("text"))).withColumn("_h", F.when(F.size("_t") > 0, content_hash(F.col("_t"))))
    heads = rows.where("_h is not null").groupBy("_h").agg(F.min(F.struct("received_at_utc", "id")).getField("id").alias("first_id"))
    return rows.join(heads, "_h", "left").select("id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")).alias("duplicate_of"))


def token_classes(messages: DataFrame) -> DataFrame:
    """One row per set of tokens: its least id and its size; members are found again by ``tokens``."""
    rows = messages.select("id", F.array_sort(F.array_distinct(canonical_tokens(F.col("text")))).alias("tokens")).where(F.size("tokens") > 0)
    return rows.groupBy("tokens").agg(F.min("id").alias("rep"), F.count("*").alias("members"))


#: Rows of one bucket that are paired in one place; larger buckets are dealt to pairs of blocks of about so many. Large buckets sent to all tasks.
BLOCK = 500
SENT_BUCKETS = 10_000
#: Bands of minima, and minima in each: sets at similarity s meet in one with probability 1 - (1 - s^ROWS)^BANDS, 0.9996 at 0.6.
BANDS, ROWS = 32, 3


def meetings(rows: DataFrame, carried: Sequence[str], block: int = BLOCK, sent: int = SENT_BUCKETS) -> DataFrame:
    """Every two rows of a bucket once a bucket, as ``x, y, nx, ny`` and both sides of ``carried``; ``rows`` are ``rep, n, bucket`` and those.

    A bucket of more than ``block`` rows is dealt to blocks by hash, and each pair of blocks meets by itself, so no task pairs a whole hot bucket;
    none is capped. The numbers of blocks of large buckets go to all tasks if there are few, else they are joined.
    With ``label`` in ``carried`` only rows of different labels meet, and a large bucket of one label is left out as a whole.
    """
    one = (F.min("label") == F.max("label")) if "label" in carried else F.lit(False)
    large = written(rows.groupBy("bucket").agg(F.count("*").alias("_size"), one.alias("_one")).where(F.col("_size") > block), "large-buckets")
    told = F.broadcast(large) if large.count() <= sent else large
    blocks = F.coalesce(F.ceil(F.col("_size") / block).cast("int"), F.lit(1))
    dealt = rows.join(told, "bucket", "left").where("not coalesce(_one, false)").withColumn("_k", blocks).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_k")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("_k") - 1), lambda j: F.struct(F.least(F.col("_own"), j).alias("i"), F.greatest(F.col("_own"), j).alias("j")))
    dealt = dealt.select("rep", "n", "bucket", "_own", *carried, F.explode(cells).alias("c")).select("rep", "n", "bucket", "_own", *carried, "c.*")
    side = lambda s: ["bucket", "i", "j", F.col("rep").alias(s), F.col("n").alias(f"n{s}"), *[F.col(c).alias(f"{c}_{s}") for c in carried]]
    met = dealt.where("_own = i").select(*side("x")).join(dealt.where("_own = j").select(*side("y")), ["bucket", "i", "j"])
    met = met.where(F.when(F.col("i") == F.col("j"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    return met.where("label_x <> label_y") if "label" in carried else met


def met_in_buckets(rows: DataFrame, threshold: float, block: int = BLOCK, sent: int = SENT_BUCKETS) -> DataFrame:
    """Pairs ``a < b`` of sets of one bucket whose sizes allow the threshold; ``rows`` are ``rep, n, bucket``, and buckets of any size meet as in `meetings`.

    With ``tokens`` in ``rows`` the similarity decides where a pair meets, and pairs come with ``jaccard``: sets travel once a bucket and block, not once a pair.
    With ``prefix``, a number of leading tokens (in one order for all sets) that are a set's buckets, a pair is taken only in the first bucket that both have, so none comes twice.
    """
    more = [c for c in ("tokens", "prefix") if c in rows.columns]
    met = meetings(rows, more, block, sent)
    met = met.where(F.least("nx", "ny") >= F.greatest("nx", "ny") * threshold - 1e-9)
    pair = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    if "prefix" in more:
        met = met.where(F.get(F.array_intersect(F.slice("tokens_x", 1, F.col("prefix_x")), F.slice("tokens_y", 1, F.col("prefix_y"))), F.lit(0)) == F.col("bucket"))
    if "tokens" not in more:
        return met.select(*pair).distinct()
    jaccard = F.size(F.array_intersect("tokens_x", "tokens_y")) / F.size(F.array_union("tokens_x", "tokens_y"))
    found = met.select(*pair, F.round(jaccard, 6).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return found if "prefix" in more else found.distinct()


def prefix_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """``rep, n, tokens, prefix, buckets``: tokens rarest first, of which the first ``prefix`` = n - ceil(threshold * n) + 1 are buckets: sets at the threshold share one.

    ``buckets`` are those that other sets have too.
    """
    counts = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    ranked = sets.select("rep", F.explode("tokens").alias("t")).join(counts, "t")
    ordered = ranked.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o")).withColumn("n", F.size("o"))
    ordered = ordered.withColumn("prefix", (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    shared = F.transform(F.filter(F.slice("o", F.lit(1), F.col("prefix")), lambda t: t["df"] > 1), lambda t: t["t"])
    return ordered.select("rep", "n", F.col("o.t").alias("tokens"), "prefix", shared.alias("buckets"))


def minhash_buckets(sets: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``rep, n, tokens, bucket`` by bands of minima of hashes of the tokens; a few buckets a set however long it is, but pairs may miss all of them."""
    minimum = lambda i: F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(i))))
    keys = [F.xxhash64(F.lit(b), *[minimum(b * rows + r) for r in range(rows)]) for b in range(bands)]
    return sets.select("rep", F.size("tokens").alias("n"), "tokens", F.explode(F.array_distinct(F.array(*keys))).alias("bucket"))


def near_duplicate_pairs(messages: DataFrame, threshold: float = 0.6, method: str = "exact", block: int = BLOCK) -> DataFrame:
    """``a, b, jaccard`` between representatives of token sets; equal sets are collapsed before.

    Sets that share a bucket meet, and there sizes and the exact similarity decide. Buckets are those of a prefix filter, which loses no pair, or with
    ``method="minhash"`` bands of minima.
    """
    sets = written(token_classes(messages), "token-sets")
    if method != "exact":
        return met_in_buckets(minhash_buckets(sets), threshold, block)
    ordered = written(prefix_sets(sets, threshold), "prefixes")
    return met_in_buckets(ordered.select("rep", "n", "tokens", "prefix", F.explode("buckets").alias("bucket")), threshold, block)


#: Sets that a leading token may bring together by itself; those of a more common one meet by two tokens.
COMMON = 100


def encoded_sets(sets: DataFrame) -> DataFrame:
    """``sid, n, o`` of sets ``sid, tokens``: their size, and the numbers of those tokens that other sets have too, rarest first; sets without such tokens are left out."""
    words = sets.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    words = written(words.repartitionByRange("df", "t").sortWithinPartitions("df", "t").select("t", F.monotonically_increasing_id().alias("k")), "words")
    at = sets.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(words, "t")
    return at.groupBy("sid", "n").agg(F.array_sort(F.collect_list("k")).alias("o"))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``a, b`` of ``nid`` whose sets reach the threshold; tokens outside ``o`` are in one set only, so they count in the union alone."""
    for s in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("nid").alias(s), F.col("n").alias(f"n{s}"), F.col("o").alias(f"o{s}")), s)
    both = F.size(F.array_intersect("oa", "ob"))
    return pairs.where(both / (F.col("na") + F.col("nb") - both) >= threshold).select("a", "b")


def component_links(sets: DataFrame, threshold: float, common: int = COMMON, block: int = BLOCK, sent: int = SENT_BUCKETS) -> DataFrame:
    """Links ``a, b`` at the threshold that join all sets ``nid, n, o`` that any chain of links joins: not every link, but the same components.

    Two sets at the threshold share a token among the leading n - ceil(threshold * n) + 1 of each, and two among one more, as they share two or more tokens.
    Sets with a leading token that at most ``common`` sets lead with meet by it, so such meetings grow with the input; those of a more common token meet by it and each next one, and the first two
    tokens that a pair shares bring it together. Where a pair meets, the tokens that are left in both must suffice for the threshold.
    Before that every set is held against the first one of each of its leading tokens, and takes the least that it links with as its label: sets of one label need not meet, so copies
    that all link with one of them make no pairs.
    """
    least = F.ceil(F.col("n") * threshold - 1e-9).cast("int")
    sets = sets.withColumn("least", least).withColumn("lead", F.size("o") - F.col("least") + 1).where("lead > 0")
    leading = lambda df: df.select("*", F.posexplode(F.slice("o", F.lit(1), F.col("lead"))).alias("at", "k")).withColumn("left", F.size("o") - F.col("at"))
    enough = lambda nx, ny, x, y: (F.least(x, y) >= F.ceil((F.col(nx) + F.col(ny)) * (threshold / (1 + threshold)) - 1e-9)) & (F.least(nx, ny) >= F.greatest(nx, ny) * threshold - 1e-9)
    ones = leading(sets).select("nid", "n", "k", "left")
    heads = written(ones.groupBy("k").agg(F.count("*").alias("size"), F.min(F.struct("nid", "n", "left")).alias("head")).where("size > 1"), "heads")
    tries = ones.join(heads, "k").where((F.col("nid") > F.col("head.nid")) & enough("n", "head.n", "left", "head.left"))
    stars = written(_similar(tries.select(F.col("head.nid").alias("a"), F.col("nid").alias("b")).distinct(), sets, threshold), "stars")
    labels = stars.groupBy(F.col("b").alias("nid")).agg(F.min("a").alias("label"))
    labelled = written(sets.join(labels, "nid", "left").withColumn("label", F.coalesce("label", "nid")), "labelled-sets")
    split = heads.where(F.col("size") > common).select("k", F.lit(True).alias("split"))
    split = F.broadcast(split) if split.count() <= sent else split
    alone = F.when(F.col("split").isNull() | (F.col("least") < 2), F.array(F.struct(F.lit(-1).cast("long").alias("next"), F.col("left"))))
    rest = F.transform(F.slice("o", F.col("at") + 2, F.col("lead") - F.col("at")), lambda t, i: F.struct(t.alias("next"), (F.col("left") - i).alias("left")))
    keys = F.concat(F.coalesce(alone, F.array()), F.when(F.col("split"), rest).otherwise(F.array()))
    rows = leading(labelled).join(split, "k", "left").select("nid", "n", "label", "k", F.explode(keys).alias("e"))
    rows = rows.select(F.col("nid").alias("rep"), "n", F.xxhash64("k", "e.next").alias("bucket"), F.col("e.left").alias("left"), "label")  # where two keys have one hash, more meet
    met = meetings(rows, ["left", "label"], block, sent).where(enough("nx", "ny", "left_x", "left_y"))
    met = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return _similar(met, labelled, threshold).unionByName(stars)


def near_duplicate_sets(messages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``tokens, members, head, component`` of every set of tokens: number and first (time, id) of its messages, and what links join it with.

    Sets that differ only in tokens that no other set has, as many in each, are alike to all others: they stand as one for the links, and are linked with each other or not by their size.
    """
    tokens = F.array_sort(F.array_distinct(canonical_tokens(F.col("text")))).alias("tokens")
    rows = messages.select("id", "received_at_utc", tokens).where(F.size("tokens") > 0)
    sets = rows.groupBy("tokens").agg(F.count("*").alias("members"), F.min(F.struct("received_at_utc", "id")).alias("head"))
    sets = written(sets.withColumn("sid", F.monotonically_increasing_id()), "token-sets")
    encoded = written(encoded_sets(sets), "encoded-sets")
    alike = written(encoded.groupBy("o", "n").agg(F.min("sid").alias("nid"), F.count("*").alias("sets")), "alike-sets")
    linked = connected_components(component_links(alike.select("nid", "n", "o"), threshold)).withColumnRenamed("node", "nid")
    by_size = F.size("o") / (2 * F.col("n") - F.size("o")) >= threshold
    found = alike.join(linked, "nid", "left").withColumn("component", F.coalesce("component", F.when((F.col("sets") > 1) & by_size, F.col("nid")))).where("component is not null")
    found = written(found, "found")
    several = encoded.join(found.where("sets > 1").select("o", "n", "component"), ["o", "n"]).select("sid", "component")
    found = found.where("sets = 1").select(F.col("nid").alias("sid"), "component").unionByName(several)
    return sets.join(found, "sid", "left").select("tokens", "members", "head", F.coalesce("component", "sid").alias("component"))


def near_duplicate_sizes(messages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``component, k``: messages of each group of two or more."""
    return near_duplicate_sets(messages, threshold).groupBy("component").agg(F.sum("members").alias("k")).where("k > 1")


def near_duplicate_groups(messages: DataFrame, threshold: float = 0.6) -> DataFrame:
    """``id, group_id`` of messages in groups of two or more, numbered by their first message in (time, id) order."""
    sets = written(near_duplicate_sets(messages, threshold), "joined-sets")
    groups = sets.groupBy("component").agg(F.sum("members").alias("n"), F.min("head").alias("head")).where("n > 1")
    groups = in_ranges(written(groups, "groups"), F.unix_micros(F.col("head.received_at_utc").cast("timestamp")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = groups.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"))
    number = F.row_number().over(Window.partitionBy("_range").orderBy("head")) + F.col("_rows")
    numbered = groups.join(F.broadcast(ranges), "_range").withColumn("group_id", number)
    numbered = sets.join(numbered.select("component", "group_id"), "component").select("tokens", "group_id")
    rows = messages.select("id", F.array_sort(F.array_distinct(canonical_tokens(F.col("text")))).alias("tokens"))
    return rows.join(numbered, "tokens").select("id", "group_id")


# Rules ------------------------------------------------------------------------------------------------------------


def tier0(text: Column) -> Column:
    """Rule code of a message without a request: noise, greeting or closing; the first rule that holds, else null."""
    tokens = canonical_tokens(text)
    n = F.size(tokens)
    words = F.filter(tokens, lambda t: ~t.rlike(r"\A[0-9]+\z"))
    odd = F.filter(words, lambda t: ~t.rlike("[aeiou]") | t.rlike("[bcdfghjklmnpqrstvwxyz]{4,}"))
    gibberish = (F.size(words) == 0) | (F.size(odd) * 2 >= F.size(words))
    within = lambda vocabulary: F.size(F.array_except(tokens, F.array(*map(F.lit, vocabulary)))) == 0
    thanks = ((n <= 9) & within([*P.THANKS, *P.GREETING]) & F.array_contains(tokens, "gracias")) | ((n <= 4) & within(P.THANKS))
    return (
        F.when((F.length(F.trim(text)) < 3) | (n == 0), "T0_EMPTY_OR_PUNCTUATION")
        .when(has(text, P.TEST_WORDS) & (n <= 6), "T0_TEST_MESSAGE")
        .when((n <= 6) & gibberish, "T0_GIBBERISH")
        .when((n <= 4) & within(P.GREETING), "T0_GREETING_ONLY")
        .when(thanks & ~has(text, P.PRAISE), "T0_CLOSING_THANKS")
    )


def flags(text: Column) -> dict[str, Column]:
    return {name: has(text, pattern) for name, pattern in P.FLAGS.items()}


def flag_codes() -> Column:
    return F.array_compact(F.array(*[F.when(F.col(n), F.lit(f"FLAG_{n.upper()}")) for n in P.FLAGS]))


ENTITIES = ("credit_number", "document_number", "amount", "payment_date", "transaction_reference", "payment_method", "named_agent")


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with one column for each entity and ``masked_values``; values stand in the text as written."""
    t = F.col(text)
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    out = df.withColumn("masked_values", every(t, P.MASKED)).withColumn("credit_number", first(t, P.CREDIT, 1)).withColumn("document_number", first(t, P.DOCUMENT, 1))
    hidden = F.exists("masked_values", lambda v: F.contains(v, F.col("document_number")))
    out = out.withColumn("document_number", F.when(~F.coalesce(hidden, F.lit(False)), F.col("document_number")))
    fits = lambda a: (
        (digits(a) != F.coalesce("credit_number", F.lit(""))) & (digits(a) != F.coalesce(digits(F.col("document_number")), F.lit(""))) & ~F.exists("masked_values", lambda v: F.contains(v, a))
    )
    out = out.withColumn("amount", F.get(F.filter(every(t, P.AMOUNT), fits), F.lit(0)))
    out = out.withColumn("payment_date", F.coalesce(*[first(t, p, 1) for p in P.PAYMENT_DATES]))
    reference = first(t, P.REFERENCE, 1)
    taken = (reference == F.col("credit_number")) | (reference == F.col("document_number"))
    out = out.withColumn("transaction_reference", F.when(~F.coalesce(taken, F.lit(False)), reference))
    methods = every(t, P.METHOD)
    second = F.get(methods, F.lit(1))
    out = out.withColumn("payment_method", F.when((F.lower(F.get(methods, F.lit(0))) == "banco") & second.isNotNull(), second).otherwise(F.get(methods, F.lit(0))))
    agent = first(t, P.AGENT, 1, "(?U)")
    out = out.withColumn("named_agent", F.when(~F.lower(agent).isin(*P.NOT_AGENTS), agent))
    return verbatim(out, text)


def verbatim(df: DataFrame, text: str = "text") -> DataFrame:
    """Entities that do not stand in the text become null; payment methods may differ in case."""
    t = F.col(text)
    there = {c: F.when(F.contains(F.lower(t), F.lower(F.col(c))) if c == "payment_method" else F.contains(t, F.col(c)), F.col(c)) for c in ENTITIES}
    return df.withColumns(there | {"masked_values": F.filter("masked_values", lambda v: F.contains(t, v))})


def merge_entities(df: DataFrame, prefix: str = "predicted_", text: str = "text") -> DataFrame:
    """Rules win, predictions fill gaps, and all is held against the text again."""
    return verbatim(df.withColumns({c: F.coalesce(c, f"{prefix}{c}") for c in ENTITIES if f"{prefix}{c}" in df.columns}), text)


def pii_present(text: Column, document: Column) -> Column:
    return document.isNotNull() | text.rlike(P.CARD)


def topic(text: Column) -> Column:
    chain = F.when(has(text, P.TOPICS[0][1]), P.TOPICS[0][0])
    for name, pattern in P.TOPICS[1:]:
        chain = chain.when(has(text, pattern), name)
    return chain.otherwise("(no keyword match)")


# Predictions and routing ------------------------------------------------------------------------------------------


def finalize(df: DataFrame) -> DataFrame:
    """Predicted labels put right by rules: flags are OR-ed, asking for a person becomes a flag unless it is all that is asked,
    fraud forces its flag, the kind of an out-of-scope message is defaulted or cleared, and what was changed is recorded.

    ``df`` has ``reason, secondary, out_of_scope_kind, text`` and predicted flags named ``predicted_<flag>`` where there are any.
    """
    found = flags(F.col("text"))
    df = df.withColumns({n: (F.coalesce(F.col(f"predicted_{n}"), F.lit(False)) | c) if f"predicted_{n}" in df.columns else c for n, c in found.items()})
    human = F.col("reason") == "hablar_con_humano"
    others = F.filter("secondary", lambda s: (s != F.col("reason")))
    moved = human & (F.size(others) > 0)
    plain = F.filter(others, lambda s: s != "hablar_con_humano")
    in_second = ~human & F.array_contains(others, "hablar_con_humano")
    df = df.withColumn("requests_human", F.col("requests_human") | human | F.coalesce(in_second, F.lit(False)))
    df = df.withColumn("_moved", F.coalesce(moved | in_second, F.lit(False)))
    df = df.withColumns({
        "final_reason": F.when(moved, F.get(others, F.lit(0))).otherwise(F.col("reason")),
        "final_secondary": F.slice(F.when(moved, F.slice(others, 2, 10)).when(human, others).otherwise(plain), 1, 3),
    })
    forced = (F.col("final_reason") == "fraude_seguridad") & ~F.col("fraud_or_security")
    out = F.col("final_reason") == "fuera_de_alcance"
    defaulted, cleared = out & F.col("out_of_scope_kind").isNull(), ~out & F.col("out_of_scope_kind").isNotNull()
    codes = F.array_compact(F.array(F.when(F.col("_moved"), "POST_HUMAN_TO_FLAG"), F.when(forced, "POST_FRAUD_FLAG"), F.when(defaulted, "POST_OOS_KIND_DEFAULT"), F.when(cleared, "POST_OOS_KIND_CLEARED")))
    return df.withColumns({
        "post_codes": codes, "fraud_or_security": F.col("fraud_or_security") | forced,
        "final_kind": F.when(defaulted, "unrelated").when(out, F.col("out_of_scope_kind")),
    }).drop("_moved")


def reuse_labels(df: DataFrame, duplicates: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A duplicate takes the labels of its original."""
    own = df.join(duplicates, "id", "left")
    heads = df.select(F.col("id").alias("duplicate_of"), *[F.col(c).alias(f"_{c}") for c in labels])
    joined = own.join(heads, "duplicate_of", "left")
    return joined.withColumns({c: F.when(F.col("duplicate_of").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in labels}).drop(*[f"_{c}" for c in labels])


def reasons(spark) -> DataFrame:
    """The policy table, one row per reason."""
    return spark.createDataFrame(list(P.REASONS), "final_reason string, coverage string, default_action string, default_queue string, base_priority int, source string")


def route(df: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Action, queue, priority, service hours, source of the reply and codes.

    The first of eight overrides that holds decides; without one the reason's defaults stand. The most urgent base priority
    of all reasons is used, then the override's least urgency, then bumps by flags.
    """
    df = df.join(reasons(df.sparkSession), "final_reason", "left")
    general = F.when(F.col("default_queue") != "none", F.col("default_queue")).otherwise("cx_general")
    lit = F.lit
    rules = (
        ("OVR_INJECTION", F.col("prompt_injection_suspected"), "route_to_human", lit("cx_general"), 2, True, None),
        ("OVR_FRAUD", F.col("fraud_or_security"), "auto_reply_and_route", lit("fraude"), 0, False, "security_ack"),
        ("OVR_HUMAN", F.col("requests_human"), "route_to_human", general, 2, True, None),
        ("OVR_LEGAL", F.col("legal_threat") | F.col("collections_harassment"), "auto_reply_and_route", lit("pqr_legal"), 1, False, None),
        ("OVR_HABEAS", (F.col("final_reason") == "privacidad_habeas_data") | F.array_contains("final_secondary", "privacidad_habeas_data"), "auto_reply_and_route", lit("datos_privacidad"), 2, False, None),
        ("OVR_LOW_CONFIDENCE", F.col("confidence") < threshold, "route_to_human", general, 3, True, None),
        ("OVR_NO_POLICY", (F.col("coverage") == "none") & (F.col("source") == "none"), "route_to_human", general, 3, True, None),
        ("OVR_OOS_SALES", (F.col("final_reason") == "fuera_de_alcance") & (F.col("final_kind") == "other_business_inquiry"), "route_to_human", lit("comercial"), 3, True, None),
    )
    def pick(at: int, kind: str, default: Column | None = None) -> Column:
        chain = None
        for rule in rules:
            value = (rule[at] if isinstance(rule[at], Column) else lit(rule[at])).cast(kind)
            chain = F.when(rule[1], value) if chain is None else chain.when(rule[1], value)
        return chain.otherwise(default) if default is not None else chain

    df = df.withColumns({
        "override": pick(0, "string"), "action": pick(2, "string", F.col("default_action")), "queue": pick(3, "string", F.col("default_queue")),
        "_least": pick(4, "int"), "_no_draft": pick(5, "boolean", lit(False)), "template": pick(6, "string"),
    })
    df = df.withColumn("priority", priority())
    own = F.create_map(*[lit(x) for x in ("saludo_incompleto", "greeting_prompt", "felicitacion_feedback", "feedback_thanks", "fuera_de_alcance", "unrelated")])
    auto = F.col("action").isin(*AUTO)
    df = df.withColumn("template", F.coalesce("template", F.when((F.col("source") == "template") & auto & ~F.col("_no_draft"), F.element_at(own, F.col("final_reason")))))
    return reply_source(df)


def priority() -> Column:
    """0 most urgent to 4: the least of base priorities, the override's bound, then one level for each bump, floor 1 for the vulnerable."""
    base = F.create_map(*[F.lit(x) for r in P.REASONS for x in (r[0], r[4])])
    urgent = F.array_min(F.concat(F.array("base_priority"), F.transform("final_secondary", lambda s: F.element_at(base, s))))
    p = F.least(urgent, F.coalesce("_least", F.lit(4)))
    p = F.when(F.col("vulnerable_customer"), F.least(F.greatest(p - 1, F.lit(0)), F.lit(1))).otherwise(p)
    for flag in ("imminent_deadline", "repeat_contact"):
        p = F.when(F.col(flag), F.greatest(p - 1, F.lit(0))).otherwise(p)
    return p


def reply_source(df: DataFrame) -> DataFrame:
    """Where the reply comes from; an automatic action without a source goes to a person, and queues are put right."""
    auto = F.col("action").isin(*AUTO)
    draft = auto & ~F.col("_no_draft") & F.col("template").isNull() & (F.col("source") == "llm") & F.col("coverage").isin("full", "partial")
    df = df.withColumn("_draft", draft)
    lost = auto & ~F.col("_draft") & F.col("template").isNull()
    df = df.withColumn("_lost", lost).withColumn("action", F.when(lost, "route_to_human").otherwise(F.col("action")))
    general = F.when(F.col("default_queue") != "none", F.col("default_queue")).otherwise("cx_general")
    queue = F.when((F.col("action") == "route_to_human") & (F.col("queue") == "none"), general).when(F.col("action").isin("close_no_reply", "auto_reply"), "none").otherwise(F.col("queue"))
    sla = F.element_at(F.array(*[F.lit(h) for h in P.SLA_HOURS]), F.col("priority") + 1)
    return df.withColumns({
        "queue": queue, "reply_source": F.when(F.col("template").isNotNull(), "template").when(F.col("_draft"), "llm").otherwise("none"), "sla_hours": sla,
        "codes": F.array_compact(F.array(F.col("override"), F.when(F.col("_lost"), "NO_REPLY_SOURCE"))),
    }).drop("_least", "_no_draft", "_draft", "_lost")


def known_gaps(df: DataFrame) -> DataFrame:
    """``gaps``: holes of the policy that the reason is known for and the text shows."""
    found = F.array_compact(F.array(*[F.when((F.col("final_reason") == r) & has(F.col("text"), p), F.lit(g)) for r, p, g in P.GAPS]))
    return df.withColumn("gaps", found)


def gap_routed(routed: DataFrame) -> DataFrame:
    """What `route` gives, with ``gaps``: an automatic reply to a message with a gap opens a case too, and codes say so."""
    df = known_gaps(routed).withColumn("_gap", F.size("gaps") > 0)
    df = df.withColumn("_up", F.col("_gap") & (F.col("action") == "auto_reply") & (F.col("reply_source") != "none"))
    general = F.when(F.col("default_queue") != "none", F.col("default_queue")).otherwise("cx_general")
    return df.withColumns({
        "action": F.when(F.col("_up"), "auto_reply_and_route").otherwise(F.col("action")), "queue": F.when(F.col("_up") & (F.col("queue") == "none"), general).otherwise(F.col("queue")),
        "codes": F.concat("codes", F.array_compact(F.array(F.when(F.col("_gap"), "KNOWN_GAP"), F.when(F.col("_up"), "GAP_ROUTED")))),
    }).drop("_gap", "_up")


def allowed_sections(routed: DataFrame) -> DataFrame:
    """What `route` gives, with ``allowed``: the sections of the reason, then of its secondary reasons, then what the override adds, each once and in this order."""
    table = lambda of: F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    own = F.flatten(F.transform(F.concat(F.array("final_reason"), F.coalesce("final_secondary", none)), lambda r: F.coalesce(F.element_at(table(P.SECTIONS), r), none)))
    return routed.withColumn("allowed", F.array_distinct(F.concat(own, F.coalesce(F.element_at(table(P.EXTRA_SECTIONS), F.coalesce("override", F.lit(""))), none))))


def signal_counts(df: DataFrame) -> DataFrame:
    """``signal, n, example``: messages that show each signal and the smallest id of these, in one pass; a signal never seen has n 0."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    shown = {name: has(F.col("text"), p) for name, p in P.SIGNALS.items()} | {"capitals": capitals > 0.5 * F.greatest(letters, F.lit(1))}
    one = df.agg(*[c for i, there in enumerate(shown.values()) for c in (F.count_if(there).alias(f"n{i}"), F.min(F.when(there, F.col("id"))).alias(f"e{i}"))])
    rows = F.array(*[F.struct(F.lit(name).alias("signal"), F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("example")) for i, name in enumerate(shown)])
    return one.select(F.inline(rows))


def section_split(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, section_id, heading, body`` of each part under a ``## `` heading, in order; text before the first is left out."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), F.col(text)), r"\n##[ \t]+"), 2, 1 << 30)
    rows = docs.select(F.col(doc_id).alias("doc"), F.posexplode(parts).alias("at", "part"))
    heading = F.trim(F.regexp_extract("part", r"\A([^\n]*)", 1))
    body = F.trim(F.regexp_replace("part", r"\A[^\n]*\n?", ""))
    return rows.select("doc", F.concat_ws(".", F.col("doc").cast("string"), F.col("at").cast("string")).alias("section_id"), heading.alias("heading"), body.alias("body"))


CHECKS = ("citations", "numbers", "forbidden_phrases", "no_document_echo", "length", "language", "no_placeholders", "contact_details")


def reply_checks(replies: DataFrame, sections: DataFrame) -> DataFrame:
    """``replies`` with one boolean for each of CHECKS.

    ``replies`` has ``id, reply, message, citations, allowed, document_number``; ``sections`` has ``section_id, body``. Citations are
    exploded and joined, so sections may be many.
    """
    cited = replies.select("id", F.explode("citations").alias("section_id")).join(sections.select("section_id", "body"), "section_id")
    cited = cited.groupBy("id").agg(F.concat_ws("\n", F.sort_array(F.collect_list("body"))).alias("_body"), F.collect_set("section_id").alias("_known"))
    df = replies.join(cited, "id", "left").withColumn("_body", F.coalesce("_body", F.lit("")))
    digits_in = lambda c: F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d.,]*"), F.lit(0)), lambda x: F.regexp_replace(x, r"\D", "")))
    in_words = F.create_map(*[F.lit(x) for pair in (P.NUMBER_WORDS | P.ORDINALS).items() for x in pair])
    worded = lambda c: F.transform(F.regexp_extract_all(c, F.lit("(?iuU)" + P.WORD_NUMBER), F.lit(1)), lambda x: F.element_at(in_words, F.lower(x)))
    numbers = lambda c: F.concat(digits_in(c), worded(c))
    tokens = canonical_tokens(F.col("reply"))
    joined = F.array_join(tokens, " ")
    digits = lambda c: F.regexp_replace(c, r"\D", "")
    echo = (F.length(digits(F.col("document_number"))) >= 5) & F.contains(digits(F.col("reply")), digits(F.col("document_number")))
    words = F.size(F.filter(F.split("reply", r"\s+"), lambda w: w != ""))
    spanish = F.size(F.filter(tokens, lambda t: t.isin(*P.SPANISH)))
    contacts = F.regexp_extract_all("reply", F.lit(r"(?i)[\w.+-]+@[\w-]+\.[\w.-]+|https?://\S+|www\.\S+"), F.lit(0))
    bad = F.lit(False)
    for phrase in P.FORBIDDEN:
        bad = bad | F.contains(joined, F.lit(phrase))
    return df.withColumns({
        "citations_ok": (F.size("citations") > 0) & (F.size(F.array_except("citations", F.coalesce("_known", F.array().cast("array<string>")))) == 0) & (F.size(F.array_except("citations", "allowed")) == 0),
        "numbers_ok": F.size(F.array_except(numbers(F.col("reply")), F.concat(digits_in(F.col("_body")), numbers(F.col("message"))))) == 0,
        "forbidden_phrases_ok": ~bad, "no_document_echo_ok": ~F.coalesce(echo, F.lit(False)) & ~F.col("reply").rlike(P.CARD),
        "length_ok": words.between(8, 160), "language_ok": (spanish >= 3) & ~has(F.col("reply"), P.ENGLISH), "no_placeholders_ok": ~F.col("reply").rlike(P.PLACEHOLDER),
        "contact_details_ok": F.forall(contacts, lambda c: F.contains(F.col("_body"), F.rtrim(c, F.lit(".,;")))),
    }).drop("_body", "_known")


def reply_outcome(checked: DataFrame) -> DataFrame:
    """``reply_codes, final_action, policy_gap`` of drafted replies; ``checked`` has what `reply_checks` gives, and may have ``can_answer`` and ``uncovered``.

    A draft that can't answer goes to a person, and what it leaves uncovered is the gap, or that the sections don't answer. Of the others a failed check sends the message to
    a person, with a code for each; one that passes but leaves points uncovered is sent, and the points are a gap that opens a case.
    """
    given = set(checked.columns)
    able = F.coalesce("can_answer", F.lit(False)) if "can_answer" in given else F.lit(True)
    open_points = F.nullif("uncovered", F.lit("")) if "uncovered" in given else F.lit(None).cast("string")
    failed = F.array_compact(F.array(*[F.when(~F.col(f"{c}_ok"), F.lit(f"VERIFIER_{c.upper()}")) for c in CHECKS]))
    df = checked.withColumn("_failed", failed).withColumn("_passed", F.size("_failed") == 0)
    gap = F.when(~able, F.coalesce(open_points, F.lit("The allowed sections do not answer the request."))).when(F.col("_passed"), open_points)
    codes = F.when(~able, F.array(F.lit("DRAFT_NOT_ANSWERABLE"))).when(F.col("_passed"), F.array_compact(F.array(F.lit("DRAFT_VERIFIED"), F.when(open_points.isNotNull(), "GAP_ROUTED")))).otherwise(F.col("_failed"))
    action = F.when(~able | ~F.col("_passed"), "route_to_human").when(open_points.isNotNull(), "auto_reply_and_route").otherwise("auto_reply")
    return df.withColumns({"reply_codes": codes, "final_action": action, "policy_gap": gap}).drop("_failed", "_passed")


def length_profile(df: DataFrame, key: str = "channel") -> DataFrame:
    """``channel, n, shortest, median, p90, longest`` of text lengths by channel and of all, by place in order: the median at n // 2 and p90 at 0.9 n, from zero."""
    rows = df.select(F.explode(F.array(F.col(key), F.lit("(all)"))).alias(key), F.length("text").alias("_w"))
    ranks = {"shortest": F.lit(1), "median": F.floor(F.col("n") / 2) + 1, "p90": F.floor(F.col("n") * 0.9) + 1}
    return at_ranks(rows, [key], "_w", ranks).select(key, "n", "shortest", "median", "p90", F.col("max").alias("longest"))


def batch_summary(df: DataFrame) -> DataFrame:
    """``section, key, n``: counts by several attributes in one pass, each row giving one entry per section."""
    entry = lambda section, key: F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
    entries = [
        entry("channel", F.col("channel")), entry("reason", F.col("final_reason")), entry("priority", F.concat(F.lit("P"), F.col("priority"))),
        entry("action", F.col("action")), entry("queue", F.col("queue")), entry("reply_source", F.col("reply_source")),
        *[F.when(F.col(f), entry("flag", F.lit(f))) for f in P.FLAGS], F.when(F.col("confidence") < CONFIDENCE, entry("quality", F.lit("low_confidence"))),
    ]
    return df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.section", "e.key").agg(F.count("*").alias("n"))


CASE = ("auto_reply_and_route", "route_to_human")


def batch_totals(gapped: DataFrame, duplicates: DataFrame, groups: DataFrame, prices: dict[str, float]) -> DataFrame:
    """``measure, value`` for a whole batch: work, replies, gaps, copies, doubts, tokens and cost. ``gapped`` is what `gap_routed` gives, with a column of tokens for each price.

    ``groups`` are messages with ``group_id``, or groups with their size ``k`` (`near_duplicate_sizes`), which needs neither numbers nor members.
    """
    reply, gap = F.col("reply_source") != "none", F.size("gaps") > 0
    cost = sum((F.col(c) * p / 1e6 for c, p in prices.items()), F.lit(0.0))
    measures = {
        "messages": F.count("*"), "replies_ready": F.count_if(reply), "auto_answerable": F.count_if(reply & F.col("action").isin(*AUTO)), "cases_opened": F.count_if(F.col("action").isin(*CASE)),
        "drafts": F.count_if(F.col("reply_source") == "llm"), "gaps_no_policy": F.count_if(gap & (F.col("coverage") == "none")), "gaps_partly_covered": F.count_if(gap & (F.col("coverage") != "none")),
        "low_confidence": F.count_if(F.col("confidence") < CONFIDENCE), "unclassified": F.count_if(F.col("final_reason").isNull()), **{c: F.sum(c) for c in prices}, "cost_usd": F.round(F.sum(cost), 6),
    }
    sizes = groups if "k" in groups.columns else groups.groupBy("group_id").agg(F.count("*").alias("k"))
    sizes = sizes.agg(F.count("*").alias("near_groups"), F.coalesce(F.sum("k"), F.lit(0)).alias("near_messages"), F.coalesce(F.max("k"), F.lit(0)).alias("largest_group"))
    one = gapped.agg(*[c.cast("double").alias(n) for n, c in measures.items()]).withColumn("auto_answerable_share", F.when(F.col("messages") > 0, F.round(F.col("auto_answerable") / F.col("messages"), 4)).otherwise(0.0))
    one = one.crossJoin(duplicates.agg(F.count("duplicate_of").alias("exact_duplicates"))).crossJoin(sizes)
    return one.selectExpr(f"stack({len(one.columns)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in one.columns) + ") as (measure, value)")


def queue_matrix(routed: DataFrame) -> DataFrame:
    """Cases by queue and priority."""
    cases = routed.where(F.col("action").isin(*CASE) & (F.col("queue") != "none"))
    return cases.groupBy("queue").agg(*[F.count_if(F.col("priority") == p).alias(f"p{p}") for p in range(5)], F.count("*").alias("cases"))


def reason_breakdown(df: DataFrame) -> DataFrame:
    """Per reason: number, share, replies ready, cases, mean and least confidence."""
    total = df.agg(F.count("*").alias("t"))
    per = df.groupBy("final_reason").agg(
        F.count("*").alias("n"), F.count_if(F.col("reply_source") != "none").alias("ready"), F.count_if(F.col("queue") != "none").alias("cases"), F.round(F.avg("confidence"), 6).alias("confidence"),
        F.min("confidence").alias("least_confidence"),
    )
    return per.crossJoin(total).select("final_reason", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"), "ready", "cases", "confidence", "least_confidence")


def usage_rollup(calls: DataFrame, prices: dict[str, float]) -> DataFrame:
    """Tokens, cost by price per million, cached share and mean cost of a call, per label."""
    cost = sum((F.col(c) * p / 1e6 for c, p in prices.items()), F.lit(0.0))
    sums = calls.withColumn("cost", cost).groupBy("label").agg(F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in prices], F.round(F.sum("cost"), 8).alias("cost"), F.round(F.avg("cost"), 10).alias("mean_cost"))
    return sums.withColumn("cached_share", F.round(F.col("cached_tokens") / (F.col("cached_tokens") + F.col("input_tokens")), 6))
