"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only by local sessions that name no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints/ledgerloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or LOCAL_FALLBACK).rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write ``df`` as Parquet and read it back: cuts a growing plan, and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task of a bucketed table meets on average at most.
BUCKET_ROWS = 250_000


def buckets(spark: SparkSession, rows: int) -> int:
    """Into how many buckets ``rows`` go: they grow with the table, so that no task's sort does."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


@contextmanager
def shuffled_in(spark: SparkSession, n: int) -> Iterator[None]:
    """What is written inside is shuffled in ``n`` partitions; the session's own number holds again afterwards."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, key: str, n: int, label: str = "table") -> DataFrame:
    """Like :func:`materialize`, as a table of ``n`` buckets by ``key``, one file each: what groups or orders within ``key`` needs no shuffle."""
    spark = df.sparkSession
    name = f"ledgerloom_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def drop(df: DataFrame) -> None:
    """Delete the folder that ``df``, the result of :func:`materialize`, reads."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder, with the tables that name it."""
    for t in spark.catalog.listTables():
        if t.name.startswith("ledgerloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
