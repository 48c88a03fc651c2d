"""Mixing sources to target weights: repetition rates from per-source totals, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, uniform
from tidewater.sources.shared import written

#: No document is repeated more often than this.
MOST = 3
WEIGHTS = (5, 2, 1)
SEED = 7


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: words that each source gives to the mix.

    Sources ordered by code point, null last, weigh ``weights`` in turn. The targets share the total of all sizes by
    weight; a target that passes ``most`` times its source's size stops there and the excess is shared again by weight.
    That is a water level: with sources ordered by cap / weight, the capped ones are a prefix, so running sums over the
    table of sources give the level. That table has one row of five numbers for each source, summed before any shuffle; its
    windows run in one task, which holds millions of sources. Sources without words get a target of zero.
    """
    totals = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranked = (
        ranked.withColumn("total", F.sum(F.col("source_size").cast("double")).over(whole))
        .withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("height", (F.col("total") - F.col("spent")) / F.col("open"))
        .withColumn("free", F.col("cap") > F.col("height") * F.col("weight"))
    )
    height = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "height"))).over(whole).getField("height")
    ranked = ranked.withColumn("level", height)
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def _draw(doc_id: str, text: str, seed: int) -> Column:
    """The seeded number of a row's id, or of its text if the id is null."""
    return uniform(F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))), seed=seed)


def rates(sized: DataFrame, source: str = "source", most: int = MOST) -> DataFrame:
    """The written table of sources: ``own, source_size, target, rate`` with rate = target / source size."""
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    return written(source_targets(sized, source, most=most).select(F.col("source").alias("own"), "source_size", "target", rate.alias("rate")), "rates")


def _copies(rows: DataFrame, source: Column, told: DataFrame) -> DataFrame:
    """``rows`` with their source's rate and ``copies``: floor(rate), and one more if the draw is below the fraction."""
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rows.join(told, source.eqNullSafe(told["own"])).withColumn("copies", copies.cast("int")).drop("own")


def mixed(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED, most: int = MOST) -> DataFrame:
    """``doc_id, source, size, draw, source_size, target, rate, copies`` for each row.

    A document is taken floor(rate) times and once more with a probability of the fraction, by the number that a seeded hash
    draws from its id (from its text, if the id is null): an independent Bernoulli trial, so reruns agree and no document
    changes another's copies but through its source's total. Texts are read once, for their sizes, and never shuffled: the table of
    sources is written before the join is planned, so Spark broadcasts it within its own threshold. Null text counts as
    size zero; a null source is a source. Repeated rows draw alike. Empty input gives no rows.
    """
    each = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"), _draw(doc_id, text, seed).alias("draw"))
    each = written(each, "sizes")
    return _copies(each, each["source"], rates(each, most=most))


def emit(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id", seed: int = SEED, most: int = MOST) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with its own columns, whatever their names; see mixed. An empty table gives an empty one."""
    told = rates(docs.select(F.col(source).alias("source"), word_count(text).alias("size")), most=most)
    rows = docs.select(F.struct("*").alias("d"), F.col(source).alias("src"), _draw(doc_id, text, seed).alias("draw"))
    many = _copies(rows, rows["src"], told).where("copies > 0")
    return many.select("d", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("d.*")


ORACLE = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast(concat('0x', substr(md5(concat('7|', coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))))), 1, 13)) as bigint)::double / 4503599627370496.0 as draw
  from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select *, list_value(5.0::double, 2.0::double, 1.0::double)[1 + (row_number() over (order by encode(source) asc nulls last) - 1) % 3] as weight,
    source_size::double * 3 as cap from s),
r as (
  select *, sum(source_size::double) over () as total,
    coalesce(sum(cap) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as spent,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as open
  from w),
h as (select *, (total - spent) / open as height from r),
l as (select min_by(height, cap / weight) as level from h where cap > height * weight),
t as (
  select source, source_size, case when level is null then cap else least(cap, level * weight) end as target from h cross join l),
q as (select *, case when source_size > 0 then least(target / source_size, 3.0) else 0.0 end as rate from t)
select d.doc_id, d.size, q.source_size, q.target, cast(d.size * (floor(q.rate) + case when d.draw < q.rate - floor(q.rate) then 1 else 0 end) as bigint) as taken
from d join q on d.source is not distinct from q.source
"""
