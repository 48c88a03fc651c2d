"""Tables in buckets of a key, of which a batch rewrites those that it touches and nothing else.

A version is a manifest: one row for each bucket and table with the folder that holds it. A batch writes the new content of its buckets
into a folder of its own and then a manifest, aside, which gets its name by one rename; until then the version before stands, and what a
crash has left is named by no manifest. A batch whose manifest is there is known and changes nothing. After a commit only the last two manifests and the
folders they name stay, so files are bounded by buckets and not by batches, and who still reads the version before can finish.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.shared import drop_path, names, new_path, rename

_MANIFEST = "bucket int, name string, folder string"


class BucketStore:
    """Named tables, all in buckets of one key; ``schemas`` are those of the tables without the bucket."""

    def __init__(self, spark: SparkSession, key: str, schemas: dict[str, T.StructType], buckets: int = 8, root: str | None = None) -> None:
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schemas = {n: T.StructType.fromJson(json.loads(s.json().replace('"nullable":false', '"nullable":true'))) for n, s in schemas.items()}
        self.root = root or new_path(spark, "store")

    @property
    def bucket(self) -> Column:
        """The partition that Spark deals the key to, so rows that are dealt over as many partitions are written as they are, one file a bucket."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets)).cast("int")

    def _manifests(self) -> list[str]:
        return [n for n in names(self.spark, self.root) if n.startswith("manifest-")]

    def known(self, batch_id: int) -> bool:
        """Whether this batch, or a later one, has been committed."""
        made = self._manifests()
        return bool(made) and int(made[-1][9:]) >= batch_id

    def _folders(self, manifest: str | None = None) -> dict[tuple[int, str], str]:
        made = [manifest] if manifest else self._manifests()[-1:]
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/{made[0]}").collect() if made else []  # buckets x tables at most
        return {(r["bucket"], r["name"]): r["folder"] for r in rows}

    def touched(self, batch: DataFrame) -> list[int]:
        return [r["b"] for r in batch.select(self.bucket.alias("b")).distinct().collect()]  # at most ``buckets``

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """A table of the last version, or some buckets of it; only their files are read."""
        folders = {f"{self.root}/{f}/{name}/bucket={b}" for (b, n), f in self._folders().items() if n == name and (buckets is None or b in buckets)}
        reader = self.spark.read.schema(self.schemas[name])
        return reader.parquet(*sorted(folders)) if folders else self.spark.createDataFrame([], self.schemas[name])

    def commit(self, batch_id: int, tables: dict[str, DataFrame], touched: list[int]) -> bool:
        """Put ``tables``, the whole new content of the ``touched`` buckets, in place of the old; false if the batch is known."""
        if self.known(batch_id):
            return False
        folder = f"data-{batch_id:012d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            rows = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schemas[name]])
            rows.repartition(self.buckets, self.key).withColumn("bucket", self.bucket).write.partitionBy("bucket").parquet(f"{self.root}/{folder}/{name}")
        filled = {(int(b[7:]), name) for name in tables for b in names(self.spark, f"{self.root}/{folder}/{name}") if b.startswith("bucket=")}
        folders = {k: f for k, f in self._folders().items() if not (k[0] in touched and k[1] in tables)} | dict.fromkeys(filled, folder)
        aside = f"{self.root}/aside-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(b, n, f) for (b, n), f in folders.items()], _MANIFEST).coalesce(1).write.parquet(aside)
        if not rename(self.spark, aside, f"{self.root}/manifest-{batch_id:012d}"):
            drop_path(self.spark, aside)  # the same batch came in between
            return False
        self._clean()
        return True

    def _clean(self) -> None:
        *old, before, last = ["", "", *self._manifests()]
        used = {f for m in (before, last) if m for f in self._folders(m).values()}
        gone = [m for m in old if m] + [n for n in names(self.spark, self.root) if n.startswith(("data-", "aside-")) and n not in used]
        for name in gone:
            drop_path(self.spark, f"{self.root}/{name}")
