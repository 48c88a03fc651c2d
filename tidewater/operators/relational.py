"""Relational transforms that the lending models and reports are made of."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.sources.shared import written


def typed_distinct(df: DataFrame, **types: Column) -> DataFrame:
    """Rows after typing, once each: twins that differ only in how their text was written become one."""
    return df.select(*[c.alias(n) for n, c in types.items()]).distinct()


def as_rows(df: DataFrame, key: str, **columns: Column) -> DataFrame:
    """``key`` and the given columns, made by a generator: a union of such rows stays dealt by the key if its sides are, which Spark doesn't see past a projection."""
    return df.select(key, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key under ``order``; for a rank of one Spark keeps only the first of each key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def forward_fill(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each column's last value that is not null, up to the row."""
    to_here = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(to_here) for c in columns})


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.col(value).cast("decimal(38,2)")).over(rows).cast("decimal(38,2)"))


def point_in_time(events: DataFrame, versions: DataFrame, key: str, on: Column) -> DataFrame:
    """Events with the version of their key that holds on a day, if any: an equi join with a range left over."""
    v = versions.withColumnRenamed(key, "_key")
    return events.join(v, (F.col(key) == F.col("_key")) & on.between(F.col("valid_from"), F.col("valid_to_effective")), "left").drop("_key")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of one key whose half-open intervals [a_start, a_end) and [b_start, b_end) overlap."""
    return a.join(b, key).where((F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start")))


def series(start: Column, end: Column, step: str) -> Column:
    """One row per step from start to end, none if start is later."""
    return F.explode(F.when(start <= end, F.sequence(start, end, F.expr(f"interval 1 {step}"))))


def dense_grid(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every row with every calendar entry; the calendar is a bounded list of days or months."""
    return rows.crossJoin(calendar)


def swept(rows: DataFrame, key: str, position: str, sides: Sequence[str]) -> DataFrame:
    """Where intervals of two sides meet, by a sweep line: the overlap join of intervals that follow each other from zero without gaps.

    ``rows`` are the ends of the intervals of both sides at ``position``, each with a payload in the column of its side and null in the other.
    Going down a key's ends, the last one seen of each side is the interval that the piece below it belongs to. So every pair that
    overlaps comes out once, with ``below`` and ``position`` as its piece and ``<side>_position`` as the ends of its intervals, and no other pair is ever made: rows stay
    linear in the input. What only one side covers is left out. One window by key, no join.
    """
    down = Window.partitionBy(key).orderBy(F.desc(position))
    seen = down.rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.lead(position).over(down), F.lit(0).cast(rows.schema[position].dataType))
    last = {s: F.last(F.when(F.col(s).isNotNull(), F.struct(F.col(s).alias("p"), F.col(position).alias("at"))), ignorenulls=True).over(seen) for s in sides}
    met = rows.select(key, position, below.alias("below"), *[c.alias(f"_{s}") for s, c in last.items()])
    met = met.where(F.col("below") < F.col(position))
    for s in sides:
        met = met.where(F.col(f"_{s}").isNotNull())
    return met.select(key, position, "below", *[F.col(f"_{s}.p").alias(s) for s in sides], *[F.col(f"_{s}.at").alias(f"{s}_position") for s in sides])


def overlapping_versions(versions: DataFrame, key: str, sk: str) -> DataFrame:
    """Pairs of versions of a key whose validity overlaps.

    By start, then name, a version overlaps an earlier one only if it starts no later than the latest end before it. Versions between two that
    do not form a stretch with a number; only those of a stretch with more than one are paired, so versions without overlap cost one window
    and no pairs, and a key's stretches meet by key and number.
    """
    order = Window.partitionBy(key).orderBy("valid_from", sk)
    before = F.max("valid_to_effective").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("valid_from") > before, F.lit(True))
    rows = versions.select(key, F.col(sk).alias("_sk"), "valid_from", "valid_to_effective", opens.cast("int").alias("_opens"))
    rows = rows.withColumn("_stretch", F.sum("_opens").over(Window.partitionBy(key).orderBy("valid_from", "_sk").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_size", F.count("*").over(Window.partitionBy(key, "_stretch"))).where("_size > 1")
    a = rows.select(key, "_stretch", F.col("_sk").alias("sk_a"), F.col("valid_from").alias("from_a"), F.col("valid_to_effective").alias("to_a"))
    b = rows.select(key, "_stretch", F.col("_sk").alias("sk_b"), F.col("valid_from").alias("from_b"), F.col("valid_to_effective").alias("to_b"))
    return a.join(b, [key, "_stretch"]).where("sk_a < sk_b and from_a <= to_b and from_b <= to_a").drop("_stretch")


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], measures: Sequence[str], tolerance: float = 0.005) -> DataFrame:
    """Rows of either side that the other lacks, or whose measures differ, with a label."""
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in measures], F.lit(True).alias("_a"))
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in measures], F.lit(True).alias("_b"))
    differs = F.lit(False)
    for m in measures:
        differs = differs | (F.abs(F.coalesce(F.col(f"{m}_a"), F.lit(0)) - F.coalesce(F.col(f"{m}_b"), F.lit(0))) > tolerance)
    side = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").when(differs, "differs")
    return left.join(right, list(keys), "full").withColumn("side", side).where("side is not null").drop("_a", "_b")


def rollup_totals(df: DataFrame, key: str, aggregates: Sequence[Column], total: str = "TOTAL") -> DataFrame:
    """Aggregates per key and over all; ``grouping`` tells a null key from the total."""
    rows = df.rollup(key).agg(*aggregates, F.grouping(key).alias("_g"))
    return rows.withColumn(key, F.when(F.col("_g") == 1, total).otherwise(F.coalesce(F.col(key).cast("string"), F.lit("(null)")))).drop("_g")


#: Values of one group that a task may order; groups of more are narrowed first. Pieces a range is cut into each time, and groups sent to all tasks.
HELD = 100_000
PIECES = 64
SENT_GROUPS = 10_000


def _in_pieces(rows: DataFrame) -> DataFrame:
    """``_p``: the number of ``cuts`` below ``_v`` and of those not above it, found by halving; odd for a value that is a cut."""
    rows, step = rows.withColumn("_p", F.lit(0)), 1 << PIECES.bit_length() - 1
    while step:
        rows = rows.withColumn("_p", F.col("_p") + F.when(F.get("cuts", F.col("_p") + F.lit(step - 1)) < F.col("_v"), step).otherwise(0))
        step //= 2
    return rows.withColumn("_p", 2 * F.col("_p") + F.when(F.get("cuts", F.col("_p")) == F.col("_v"), 1).otherwise(0))


def at_ranks(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Column], held: int = HELD, sent: int = SENT_GROUPS) -> DataFrame:
    """``keys, n, max`` and, for each name, the value at that rank of its group, from one; ``ranks`` are columns over ``n``. Nulls do not count.

    Selection by counting ranges, so no task orders a group: each target keeps the range of values that holds its rank and the number
    of rows below. While a range has more than ``held`` rows and more than one value, it is cut at approximate quantiles, the rows strictly between two cuts
    and those equal to a cut are counted apart, and the piece with the rank is kept; each turn leaves about a PIECES-th.
    Counts are summed in every task before the shuffle. Only ranges of at most ``held`` rows are ordered. Ranges are sent to all tasks if there are at most
    ``sent`` of them, else rows are joined to them by group.
    """
    rows = written(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v")), "ranked")
    kind = rows.schema["_v"].dataType
    groups = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_v").alias("_low"), F.max("_v").alias("max")), "groups")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items()]))
    targets = groups.select(*keys, wanted.alias("t"), F.col("_low").alias("low"), F.col("max").alias("high"), F.col("n").alias("inside")).select(*keys, "t.*", "low", "high", "inside", F.lit(0).cast("long").alias("below"))
    few = groups.count() * len(ranks) <= sent
    same = [F.col(f"_r.{k}").eqNullSafe(F.col(f"_t.{k}")) for k in keys]

    def met(to: DataFrame) -> DataFrame:
        on = F.lit(True)
        for c in same:
            on = on & c
        t = F.broadcast(to.alias("_t")) if few else to.alias("_t")
        return rows.alias("_r").join(t, on & F.col("_v").between(F.col("low"), F.col("high"))).select(*[f"_t.{c}" for c in to.columns], "_v")

    while True:
        targets = written(targets, "targets")
        wide = targets.where((F.col("inside") > held) & (F.col("low") < F.col("high")))
        if wide.isEmpty():
            break
        cuts = F.percentile_approx("_v", [i / PIECES for i in range(PIECES + 1)], 10_000)
        cut = written(met(wide).groupBy(*keys, "name", "rank", "below").agg(F.array_distinct(cuts).alias("cuts"), F.min("_v").alias("low"), F.max("_v").alias("high")), "cuts")
        counted = _in_pieces(met(cut)).groupBy(*keys, "name", "rank", "below", "_p").agg(F.count("*").alias("inside"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        up = Window.partitionBy(*keys, "name").orderBy("_p")
        before = F.coalesce(F.sum("inside").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        narrowed = counted.withColumn("below", before).where("below < rank and rank <= below + inside")
        targets = targets.where((F.col("inside") <= held) | (F.col("low") == F.col("high"))).unionByName(narrowed.select(*targets.columns))
    single = targets.where("low = high").select(*keys, "name", F.col("low").cast(kind).alias("_v"))
    ordered = met(targets.where("low < high")).withColumn("_at", F.row_number().over(Window.partitionBy(*keys, "name").orderBy("_v")) + F.col("below"))
    found = single.unionByName(ordered.where("_at = rank").select(*keys, "name", "_v"))
    found = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in ranks])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"f.{k}"))
    return groups.alias("g").join(found.alias("f"), on).select(*[f"g.{k}" for k in keys], "g.n", "g.max", *[f"f.{n}" for n in ranks])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], held: int = HELD) -> DataFrame:
    """Nearest-rank percentiles: the value at rank ceil(share * n), counting from one; ``max`` at share 1."""
    ranks = {f"_{name}": F.greatest(F.lit(1), F.ceil(F.col("n") * share)) for name, share in shares.items()}
    return at_ranks(df, keys, value, ranks, held).select(*keys, "n", *[F.col(f"_{name}").alias(name) for name in shares])


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "med", held: int = HELD) -> DataFrame:
    """Exact median of each group: the mean of the middle value, or of the middle two."""
    found = at_ranks(df, keys, value, {"_a": F.floor((F.col("n") + 1) / 2), "_b": F.floor(F.col("n") / 2) + 1}, held)
    return found.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name))


def in_ranges(df: DataFrame, order: Column, parts: int = 64) -> DataFrame:
    """``df`` with ``_range``, the number of the range of ``order`` that a row is in; equal values share one, null is -1.

    Bounds are approximate quantiles, so ranges are about equal. With them an order over a whole table is windows within
    ranges plus the totals of the ranges before, and no task holds the table.
    """
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"] or []
    at = sum(((order > F.lit(b)).cast("int") for b in sorted(set(bounds))), F.lit(0))
    return df.withColumn("_range", F.coalesce(at, F.lit(-1)))


def cumulative_share(df: DataFrame, keys: Sequence[str], measure: str, tie: str) -> DataFrame:
    """Rank by measure and the running share of the total up to it; ties share a running sum, as a RANGE frame gives."""
    rows = in_ranges(written(df, "measured"), F.col(measure))
    within = Window.partitionBy("_range").orderBy(F.desc_nulls_last(measure), tie)
    peers = Window.partitionBy("_range").orderBy(F.desc_nulls_last(measure)).rangeBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    total = rows.agg(F.sum(measure).alias("_total"))
    ranges = rows.groupBy("_range").agg(F.count("*").alias("_n"), F.sum(measure).alias("_s"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_rows"), F.sum("_s").over(above).alias("_sum"))
    own = F.sum(measure).over(peers)
    return (
        rows.join(F.broadcast(ranges), "_range")
        .crossJoin(total)
        .withColumn("rank", F.row_number().over(within) + F.col("_rows"))
        .withColumn("running", F.coalesce(own + F.col("_sum"), own, F.col("_sum")).cast(total.schema[0].dataType))
        .withColumn("share", F.round(F.col("running").cast("double") / F.col("_total").cast("double"), 6))
        .select(*df.columns, "rank", "running", "share")
    )


def segments(df: DataFrame, named: dict[str, Column], aggregates: Sequence[Column]) -> DataFrame:
    """The same aggregates over several segments in one pass: rows are tagged with each segment that they are in."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))
    return df.withColumn("segment", F.explode(tags)).groupBy("segment").agg(*aggregates)


def top_k(df: DataFrame, measure: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(measure), tie).limit(k)
