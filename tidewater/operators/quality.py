"""Data quality checks: each gives the rows that fail, and none means pass."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.operators.relational import as_rows
from tidewater.sources.shared import dealt, drop_path, make_folder, names, new_path, rename

DIMENSIONS = ("completeness", "uniqueness", "validity", "consistency", "integrity", "accuracy", "timeliness")


@dataclass(frozen=True)
class Check:
    name: str
    model: str
    dimension: str
    severity: str
    failing: Callable[[], DataFrame]


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def not_accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list; null is no value."""
    return df.where(~F.col(column).isin(*values))


def orphans(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def out_of_range(df: DataFrame, column: str, low=None, high=None, inclusive: bool = True) -> DataFrame:
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | ((c < low) if inclusive else (c <= low))
    if high is not None:
        bad = bad | ((c > high) if inclusive else (c >= high))
    return df.where(bad)


def not_true(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(~condition)


def allocation_excess(allocation: DataFrame, parts: DataFrame, keys: Sequence[str], amount: str, over: int = 0) -> DataFrame:
    """Parts that got more than their amount by half a cent.

    Both sides meet in one aggregation within loans, so tables in buckets of the loan need no join; keys that may go over
    loans are then dealt, one row a key and loan, over ``over`` partitions.
    """
    other = [k for k in keys if k != "loan_id"]
    own = {k: F.col(k) for k in other}
    kind = {"laid": allocation.schema["allocated"].dataType, "amount": parts.schema[amount].dataType}
    laid = as_rows(allocation, "loan_id", **own, laid=F.col("allocated"), amount=F.lit(None).cast(kind["amount"]))
    due = as_rows(parts, "loan_id", **own, laid=F.lit(None).cast(kind["laid"]), amount=F.col(amount))
    rows = laid.unionByName(due).groupBy("loan_id", *other).agg(F.sum("laid").alias("laid"), F.max("amount").alias("amount"))
    if "loan_id" not in keys:
        rows = dealt(rows.drop("loan_id"), over, other[0]).groupBy(*keys).agg(F.sum("laid").alias("laid"), F.max("amount").alias("amount"))
    return rows.where("laid > amount + 0.005")


def not_covered(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that one side has and the other lacks."""
    left = a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").withColumn("missing_in", F.lit("b"))
    right = b.select(key).distinct().join(a.select(key).distinct(), key, "left_anti").withColumn("missing_in", F.lit("a"))
    return left.unionByName(right)


def skipped_installments(status: DataFrame) -> DataFrame:
    """Installments that are open while a later one of the loan has money."""
    later = Window.partitionBy("loan_id").orderBy("installment_number").rowsBetween(1, Window.unboundedFollowing)
    rows = status.withColumn("later_paid", F.max("paid_any").over(later))
    return rows.where(F.col("settled_date_any").isNull() & (F.col("later_paid") > 0)).select("loan_id", "installment_number")


def paid_mismatch(payments: DataFrame, installments: DataFrame, allocation: DataFrame) -> DataFrame:
    """Loans whose allocation is not the smaller of paid and planned, within a cent."""
    paid = payments.where("amount > 0").groupBy("loan_id").agg(F.sum("amount").alias("paid"))
    plan = installments.groupBy("loan_id").agg(F.sum("amount_due").alias("planned"))
    laid = allocation.groupBy("loan_id").agg(F.sum("allocated").alias("laid"))
    rows = paid.join(plan, "loan_id").join(laid, "loan_id", "left").withColumn("expected", F.least("paid", "planned"))
    return rows.where(F.abs(F.coalesce("laid", F.lit(0)) - F.col("expected")) > 0.01).select("loan_id", "paid", "planned", "laid")


def _comparable(df: DataFrame, column: str) -> Column:
    """The column, or its JSON where its type has no order."""
    return F.to_json(F.struct(f"`{column}`")) if "map<" in dict(df.dtypes)[column] or dict(df.dtypes)[column] == "variant" else F.col(f"`{column}`")


def twin_differences(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, n, differing``: keys held by rows that differ, and the columns in which they do, for any schema; null is a value of its own.

    Per column least and greatest value and number of nulls, summed up in every task: no row is paired with another and a hot key meets in partial results.
    """
    rest = [c for c in df.columns if c not in keys]
    each = [F.when((F.min(_comparable(df, c)) != F.max(_comparable(df, c))) | ((F.count(f"`{c}`") > 0) & (F.count(f"`{c}`") < F.count("*"))), F.lit(c)) for c in rest]
    found = df.groupBy(*keys).agg(F.count("*").alias("n"), F.array_compact(F.array(*each) if each else F.array().cast("array<string>")).alias("differing"))
    return found.where(F.size("differing") > 0)


def counted_list(df: DataFrame, groups: Sequence[str], separator: str = ", ") -> DataFrame:
    """One row with one text ``listed``, ``a/b=n`` for each group in the order of its columns; for categories, as all groups meet in the list."""
    name = F.concat_ws("/", *[F.coalesce(F.col(g).cast("string"), F.lit("(null)")) for g in groups])
    counted = df.groupBy(*groups).agg(F.count("*").alias("n")).select(F.struct(*groups).alias("g"), F.concat(name, F.lit("="), F.col("n")).alias("t"))
    return counted.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "t"))), lambda x: x["t"]), separator).alias("listed"))


def _status() -> Column:
    return F.when(F.col("failures") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("error")


class AuditSink:
    """Failing rows of checks, whole and of any schema, kept by run and check in the shared folder, with every check of the run, also those that find nothing.

    A run is written aside and named by one rename under its next version; the last version stands, so a rerun replaces its run and readers never see half of one.
    Older versions go after that.
    """

    ROWS = "check string, severity string, seq long, row string"
    CHECKS = "check string, severity string, schema string"
    #: Times to the microsecond, on both ways.
    TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root = spark, root or new_path(spark, "audit")

    def _versions(self, run: str) -> list[str]:
        return [n for n in names(self.spark, f"{self.root}/run={run}") if n.startswith("v")]

    def write(self, run: str, failing: dict[str, tuple[str, DataFrame]]) -> None:
        """Store ``check: (severity, failing rows)`` as the run; checks that find nothing leave no rows, but stand among its checks."""
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        self.spark.createDataFrame([], self.ROWS).write.partitionBy("check").parquet(f"{aside}/rows")
        for check, (severity, df) in failing.items():  # one after the other, so the driver plans one check at a time
            whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false", **self.TIMES})
            rows = df.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.monotonically_increasing_id().alias("seq"), whole.alias("row"))
            rows.write.partitionBy("check").parquet(f"{aside}/rows", mode="append")
        checks = [(check, severity, df.schema.json()) for check, (severity, df) in failing.items()]
        self.spark.createDataFrame(checks, self.CHECKS).coalesce(1).write.parquet(f"{aside}/checks")
        old = self._versions(run)
        version = f"v{int(old[-1][1:]) + 1 if old else 0:09d}"
        make_folder(self.spark, f"{self.root}/run={run}")
        if not rename(self.spark, aside, f"{self.root}/run={run}/{version}"):
            raise RuntimeError("the same run was written at the same time")
        for name in old:
            drop_path(self.spark, f"{self.root}/run={run}/{name}")

    def runs(self) -> list[str]:
        return [n[4:] for n in names(self.spark, self.root) if n.startswith("run=") and self._versions(n[4:])]

    def _read(self, run: str | None, table: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], "run string, " + schema)
        for name in self.runs() if run is None else [run]:
            for version in self._versions(name)[-1:]:
                base = f"{self.root}/run={name}/{version}/{table}"
                out = out.unionByName(self.spark.read.schema(schema).parquet(base).withColumn("run", F.lit(name)))
        return out

    def read(self, run: str | None = None) -> DataFrame:
        """``run, check, severity, seq, row`` of one run or of all; each ``row`` is the JSON of a failing row."""
        return self._read(run, "rows", self.ROWS)

    def checks(self, run: str | None = None) -> DataFrame:
        """``run, check, severity, failures, status`` of every check of one run or of all, counted from the rows stored."""
        counts = self.read(run).groupBy("run", "check").agg(F.count("*").alias("n"))
        rows = self._read(run, "checks", self.CHECKS).join(counts, ["run", "check"], "left")
        return rows.withColumn("failures", F.coalesce("n", F.lit(0).cast("long"))).select("run", "check", "severity", "failures", _status().alias("status"))

    def parsed(self, schema: T.StructType) -> Column:
        """The ``row`` of a check with such a schema as it was."""
        return F.from_json("row", schema, self.TIMES)

    def rows(self, run: str, check: str, schema: T.StructType) -> DataFrame:
        """The failing rows of one check as they were."""
        return self.read(run).where(F.col("check") == check).select(self.parsed(schema).alias("r")).select("r.*")


def outcome(checks: Sequence[tuple[str, str, str, str, DataFrame]]) -> DataFrame:
    """``check, model, dimension, severity, failures, status`` of ``(name, model, dimension, severity, failing rows)``, as one plan."""
    rows = None
    for name, model, dimension, severity, failing in checks:
        n = failing.agg(F.count("*").alias("failures"))
        row = n.select(F.lit(name).alias("check"), F.lit(model).alias("model"), F.lit(dimension).alias("dimension"), F.lit(severity).alias("severity"), "failures")
        rows = row if rows is None else rows.unionByName(row)
    return rows.withColumn("status", _status())


def matrix(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Checks by model and dimension; of each model also how many there are, how many warn or fail, the dimensions covered and the worst status.

    Models without any check stand with zeros and the status ``none``.
    """
    all_models = results.sparkSession.createDataFrame([(m,) for m in models], "model string")
    counts = results.groupBy("model").pivot("dimension", list(DIMENSIONS)).agg(F.count(F.lit(1)))
    state = results.groupBy("model").agg(
        F.count("*").alias("checks"), F.count_if(F.col("status") == "warn").alias("warnings"), F.count_if(F.col("status") == "error").alias("errors"), F.countDistinct("dimension").alias("covered")
    )
    worst = F.when(F.col("errors") > 0, "error").when(F.col("warnings") > 0, "warn").when(F.col("checks") > 0, "pass").otherwise("none")
    return all_models.join(counts, "model", "left").join(state, "model", "left").na.fill(0).withColumn("status", worst)


def greedy_fifo(payments: DataFrame, installments: DataFrame) -> DataFrame:
    """A second allocation, payment by payment in whole cents, to hold the interval one against.

    Loans come in order, each with its plan first and then its payments; only the plan of one loan is held at a time.
    """
    money = payments.where("amount > 0").select("loan_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("due"), F.col("payment_seq").cast("long").alias("seq"), F.round(F.col("amount") * 100).cast("long").alias("cents"))
    debt = installments.where("amount_due > 0").select("loan_id", F.lit(0).alias("kind"), F.col("due_date").cast("string").alias("due"), F.col("installment_number").cast("long").alias("seq"), F.round(F.col("amount_due") * 100).cast("long").alias("cents"))

    def lay(parts):
        import pandas as pd

        columns = ["loan_id", "installment_number", "paid_cents"]
        loan, plan, at, out = None, [], 0, []
        for part in parts:
            for row_loan, kind, seq, cents in part[["loan_id", "kind", "seq", "cents"]].itertuples(index=False):
                if row_loan != loan:
                    out += [(loan, number, due - left) for number, due, left in plan]
                    loan, plan, at = row_loan, [], 0
                if kind == 0:
                    plan.append([seq, cents, cents])
                while kind == 1 and cents and at < len(plan):
                    paid = min(cents, plan[at][2])
                    cents -= paid
                    plan[at][2] -= paid
                    at += plan[at][2] == 0
            yield pd.DataFrame(out, columns=columns)
            out = []
        yield pd.DataFrame([(loan, number, due - left) for number, due, left in plan], columns=columns)

    rows = money.unionByName(debt).where("loan_id is not null").repartition("loan_id").sortWithinPartitions("loan_id", "kind", "due", "seq")
    return rows.mapInPandas(lay, "loan_id long, installment_number long, paid_cents long")
