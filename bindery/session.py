"""Shared-storage scratch tables used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``, or else one below the warehouse, which all executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    spark.sparkContext.setCheckpointDir(f"{warehouse}/bindery-scratch")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings while something runs."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Workers get 4 MB at a time while something runs: those that handle files one by one need not be sent 64 MB.

    Ten thousand rows, Spark's other bound on a batch, are as many megabytes as the files make them.
    """
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}):
        yield


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to shared storage and read it back.

    The written table survives executor loss, freezes generated row ids, and gives
    later joins measured file sizes to choose their strategy by.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a bucket of a bucketed table.
BUCKET_ROWS = 200_000


def materialize_bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """:func:`materialize` in buckets by ``key``: joins on it do not move the table, however often it is joined.

    The table is first written as it comes, so that its size can set the number of buckets.
    """
    spark = df.sparkSession
    written = materialize(df, label)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-written.count() // BUCKET_ROWS))
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    written.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
