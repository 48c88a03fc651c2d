"""Tables written to the folder that the driver and all executors share.

A written table cuts the lineage of what follows, is computed once however often it is read, and outlives the
executors that made it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (local tests), a new temporary one."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewater-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dealt_over(spark: SparkSession, parts: int) -> Iterator[None]:
    """What is planned inside has at least ``parts`` shuffle partitions, so that a task's share is bounded however large the input."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, max(parts, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(df: DataFrame, parts: int, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over ``parts``, for plans that run later; as it is where the session has as many shuffle partitions."""
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def written_in_buckets(df: DataFrame, name: str, key: str, path: str | None = None) -> DataFrame:
    """``df`` as a table in the shared folder in buckets of ``key``, sorted by it within each, with its size and number of rows in the catalog.

    There are as many buckets as shuffle partitions, one file each, so tables of one session that share a key are joined, grouped and windowed by it
    without another shuffle. Rows that are dealt by the key already are not dealt again.
    """
    spark = df.sparkSession
    path = path or new_path(spark, name)
    buckets, table = int(spark.conf.get("spark.sql.shuffle.partitions")), "tidewater_" + re.sub(r"\W", "_", path.rsplit("/", 1)[-1])
    df.repartition(buckets, key).write.format("parquet").option("compression", "zstd").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    spark.sql(f"analyze table {table} compute statistics")
    return spark.table(table)


def drop_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names(spark: SparkSession, path: str) -> list[str]:
    """What stands in a folder, sorted; nothing if there is none."""
    fs, target = _file_system(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(target)) if fs.exists(target) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def rename(spark: SparkSession, source: str, target: str) -> bool:
    """Give a whole written table its name in one step; false if the name is taken."""
    fs, end = _file_system(spark, target)
    return not fs.exists(end) and fs.rename(_file_system(spark, source)[1], end)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, target = _file_system(spark, path)
    fs.mkdirs(target)
