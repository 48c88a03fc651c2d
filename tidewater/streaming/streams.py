"""Streaming forms of the message and lending operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.scalar import canonical_tokens, content_hash
from tidewater.operators import messages as M
from tidewater.operators.lending import cdc_merged, cdc_partials, cdc_resolved, fifo_allocation
from tidewater.sources.shared import dealt_over, names, new_path
from tidewater.streaming.store import BucketStore


def annotate(messages: DataFrame) -> DataFrame:
    """Stateless rules, flags and entities; the same columns for a batch and for a stream."""
    rows = M.entities(messages).withColumns({"rule": M.tier0(F.col("text")), "topic": M.topic(F.col("text"))} | M.flags(F.col("text")))
    return rows.withColumn("codes", M.flag_codes())


def first_copies(messages: DataFrame, horizon: str = "10 days") -> DataFrame:
    """The first copy of a text within a horizon; state older than the watermark is let go."""
    rows = messages.withColumn("hash", content_hash(canonical_tokens(F.col("text"))))
    return rows.withWatermark("received_at", horizon).dropDuplicatesWithinWatermark(["hash"])


def as_stream(spark: SparkSession, df: DataFrame, files: int = 4, per_batch: int = 1) -> DataFrame:
    """``df`` written as files and read back as a stream of them, ``per_batch`` at a time."""
    path = new_path(spark, "stream")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def run(stream: DataFrame, name: str = "sink") -> DataFrame:
    """Run a stream to the end of its input into a table in the shared folder, and give that."""
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


class Upsert:
    """``foreachBatch`` that keeps the resolved state of each application over a stream of events in any order.

    The store holds one row of partials for each application: what its events so far tell in each competing order, so a batch is reduced to
    partials and merged into those of the buckets it touches, and no event is kept or read again. An event may come as late as it likes unless ``lookback``
    (an interval) is given: then one older than the newest event of earlier batches less the lookback is put into ``late`` and not applied.
    """

    def __init__(self, spark: SparkSession, buckets: int = 8, lookback: str | None = None, root: str | None = None) -> None:
        self.spark, self.lookback = spark, lookback
        self.events = T._parse_datatype_string(
            "event_pk long, application_id long, customer_id_raw long, merchant_id long, status string, requested_amount decimal(18,2), cdc_op string, event_at_utc timestamp_ntz, ingested_at_utc timestamp_ntz, currency string"
        )
        schemas = {"partials": cdc_partials(spark.createDataFrame([], self.events)).schema}
        self.store = BucketStore(spark, "application_id", schemas, buckets, root)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.store.known(batch_id):
            return
        batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.events])
        if self.lookback and (newest := self.store.read("partials").agg(F.max("by_event.event_at_utc")).first()[0]):
            late = F.col("event_at_utc") < F.lit(newest).cast("timestamp_ntz") - F.expr(f"interval {self.lookback}")
            batch.where(late).write.mode("overwrite").parquet(f"{self.store.root}/late/batch={batch_id}")
            batch = batch.where(~F.coalesce(late, F.lit(False)))
        touched = self.store.touched(batch)
        merged = cdc_merged(self.store.read("partials", touched).unionByName(cdc_partials(batch)))
        self.store.commit(batch_id, {"partials": merged}, touched)

    def late(self) -> DataFrame:
        """Events that came too late to be applied."""
        folder = f"{self.store.root}/late"
        return self.spark.read.schema(self.events).parquet(f"{folder}/*") if names(self.spark, folder) else self.spark.createDataFrame([], self.events)

    def state(self) -> DataFrame:
        return cdc_resolved(self.store.read("partials"))


class FifoStream:
    """``foreachBatch`` that keeps the allocation of payments over a stream of them, in any order of files.

    Plan, payments so far and allocation stand in the same buckets of loans. A batch lays out anew the loans it has payments of, from the buckets they
    are in; other loans of those buckets are carried over and other buckets are not read. A payment that comes again under its id counts once.
    Within a batch all rows are dealt over as many partitions as there are buckets, so what is laid out is written where it is.
    """

    def __init__(self, spark: SparkSession, installments: DataFrame, buckets: int = 8, root: str | None = None) -> None:
        self.spark = spark
        self.money = T._parse_datatype_string("loan_id long, payment_id long, paid_at_utc timestamp_ntz, paid_date date, amount decimal(18,2)")
        plan = T._parse_datatype_string("loan_id long, installment_number int, due_date date, amount_due decimal(18,2)")
        laid = fifo_allocation(spark.createDataFrame([], self.money), spark.createDataFrame([], plan)).schema
        self.store = BucketStore(spark, "loan_id", {"plan": plan, "payments": self.money, "allocation": laid}, buckets, root)
        self.store.commit(-1, {"plan": installments}, list(range(buckets)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.store.known(batch_id):
            return
        batch = batch.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.money])
        with dealt_over(self.spark, self.store.buckets), dealt_over(batch.sparkSession, self.store.buckets):
            self._lay_out(batch, batch_id)

    def _lay_out(self, batch: DataFrame, batch_id: int) -> None:
        touched = self.store.touched(batch)
        loans = batch.select("loan_id").distinct()
        payments = self.store.read("payments", touched).unionByName(batch).repartition(self.store.buckets, "loan_id").dropDuplicates(["loan_id", "payment_id"])
        again = fifo_allocation(payments.join(loans, "loan_id", "left_semi"), self.store.read("plan", touched).join(loans, "loan_id", "left_semi"))
        kept = self.store.read("allocation", touched).join(loans, "loan_id", "left_anti")
        self.store.commit(batch_id, {"payments": payments, "allocation": kept.unionByName(again)}, touched)

    def allocation(self) -> DataFrame:
        return self.store.read("allocation")


def drain(stream: DataFrame, each) -> None:
    """Send a stream's batches to ``each`` until its input ends."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{each.store.root}-position").trigger(availableNow=True).start().awaitTermination()
