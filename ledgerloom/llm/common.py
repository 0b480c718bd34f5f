"""Helpers that the corpus operators share."""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by local sessions that name no shared folder, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints/ledgerloom"

#: White space that separates words in most contracts: space, tab .. carriage return.
WHITESPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a cluster has to name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(named or LOCAL_FALLBACK).rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"


#: With this setting Spark deletes a write's shuffle files when the write has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files: what they wrote is read instead, and nothing runs their plans again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and lets several
    consumers read a result that was worked out once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _note(path)
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Like :func:`materialize`, as a table bucketed by ``key``: grouping or joining it by that key needs no shuffle."""
    return add_to(bucket_table(label), df, key)


def bucket_table(label: str) -> str:
    """A name for a table that :func:`add_to` makes."""
    return f"ledgerloom_{label.replace('-', '_')}_{uuid.uuid4().hex}"


def add_to(name: str, df: DataFrame, key: str) -> DataFrame:
    """Write ``df`` to the table ``name``, bucketed by ``key``, behind what it has; the whole table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    _note(path, name)
    with _freeing(spark):
        df.write.mode("append").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(name)
    return spark.table(name)


#: Folders and tables written inside each open :func:`settle`, innermost last.
_OPEN: list[list[tuple[str, str | None]]] = []


def _note(path: str, name: str | None = None) -> None:
    if _OPEN:
        _OPEN[-1].append((path, name))


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """:func:`materialize` of ``make()``; what ``make`` wrote to the shared folder on the way is deleted once the result is written.

    Elsewhere such tables stay, for whoever still reads the lazy results, until :func:`release`.
    """
    _OPEN.append([])
    spark = None
    try:
        df = make()
        spark = df.sparkSession
        path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        with _freeing(spark):
            df.write.parquet(path)
    finally:
        written = _OPEN.pop()
        for at, name in written if spark else ():
            _delete(spark, at, name)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the folders (or the bucketed table) that ``df``, the result of :func:`materialize` or :func:`bucketed`, reads."""
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    names = {f.rpartition("/")[2] for f in folders}
    for path in folders:
        name = path.rpartition("/")[2]
        _delete(df.sparkSession, path, name if name.startswith("ledgerloom_") and len(names) == 1 else None)


def release(spark: SparkSession) -> None:
    """Delete all that this application's operators wrote to the shared folder, with the tables that name it."""
    for t in spark.catalog.listTables():
        if t.name.startswith("ledgerloom_"):
            spark.sql(f"DROP TABLE IF EXISTS {t.name}")
    _delete(spark, shared_dir(spark))


def _delete(spark: SparkSession, path: str, name: str | None = None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    An expression used inside a lambda is evaluated for each element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


T = TypeVar("T")


def shipped(spark: SparkSession, value: T) -> Callable[[], T]:
    """Broadcast ``value`` with this subpackage's own classes in it; in a task, the returned function gives it.

    A plain broadcast only names such classes, so that executors would have to have the package.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def words(text: Column) -> Column:
    """White-space separated words of ``text`` (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITESPACE), lambda w: w != "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def with_results(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with result columns; input columns of those names are replaced."""
    return df.withColumns(columns)
