"""Incremental jobs as Structured Streaming. Each runs over what is there (``availableNow``) and returns its result as a table.

Results and checkpoints are kept in a folder that the driver and all executors share; a job that is
started again with the same folder goes on where it ended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.scalars import identity
from ..operators.evidence import latest_by
from ..sources.shared import shared_dir


def work_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """The Parquet table at ``path``, a single file or a folder of part files, as a stream."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return stream(spark, path, "*", schema, **options)
    folder, _, name = path.rpartition("/")
    return stream(spark, folder, name, schema, **options)


def whole_span(table: DataFrame, at: str, least_days: int) -> str:
    """A watermark delay with which no row of ``table`` is late, in whatever order its files come."""
    instant = F.col(at).cast("timestamp").cast("double")
    span = table.agg(F.max(instant) - F.min(instant)).first()[0] or 0
    return f"{max(least_days * 86_400, int(span) + 2)} seconds"


def stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_batch: int | None = 1000) -> DataFrame:
    """New Parquet files of a folder; without ``files_per_batch`` all of them are one batch, in which no row is late."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(folder)


def process_once(new: DataFrame, parts: list[Column], at: str, delay: str, folder: str) -> DataFrame:
    """Rows whose fingerprint was not seen within ``delay``; state is dropped after that."""
    keyed = new.withColumn("fingerprint", identity(*parts)).withWatermark(at, delay).dropDuplicatesWithinWatermark(["fingerprint"])
    query = keyed.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return new.sparkSession.read.schema(keyed.schema).parquet(f"{folder}/out")


def rolling_counts(new: DataFrame, keys: list[str], at: str, width: str, slide: str, delay: str, folder: str) -> DataFrame:
    """Rows per key and window; late rows count as long as ``delay`` allows."""
    counts = new.withWatermark(at, delay).groupBy(*keys, F.window(at, width, slide)).count()

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")

    query = counts.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    every = new.sparkSession.read.schema(StructType(list(counts.schema.fields)).add("batch", "integer")).parquet(f"{folder}/out")
    # an update replaces what earlier batches said of the window
    return latest_by(every, [*keys, "window"], [F.col("batch").desc()]).drop("batch")


#: Keeps the state of keyed operators on executors' disks instead of their heaps.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ROCKSDB[0], None)
    spark.conf.set(*ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(ROCKSDB[0]) if before is None else spark.conf.set(ROCKSDB[0], before)


def late_rows(query: StreamingQuery) -> int:
    """How many rows a run dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def sessions(new: DataFrame, keys: list[str], at: str, gap: str, delay: str, folder: str) -> tuple[DataFrame, int]:
    """Per key the closed sessions (rows less than ``gap`` apart) with their number of rows, and how many late rows this run dropped.

    A session is written once, when the watermark (the latest time less ``delay``) has passed its end; open ones stay in
    the state until a later run closes them.
    """
    spark = new.sparkSession
    counts = new.withWatermark(at, delay).groupBy(*keys, F.session_window(at, gap)).count()
    with _rocksdb(spark):
        query = counts.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{folder}/out"), late_rows(query)


def state_changes(new: DataFrame, keys: list[str], order: list[str], folder: str) -> DataFrame:
    """The log of changes of the newest row per key: each batch adds the keys whose newest row changed, with ``batch``.

    The newest rows are the state of a keyed aggregate; a batch touches the keys it has rows of, and writes those
    whose newest row came with it. Of rows that are equal in ``order`` the one that came first stays. A batch that is run
    again has the same time, and replaces what it wrote.
    """
    spark = new.sparkSession
    others = [c for c in new.columns if c not in keys]
    timed = new.withColumn("_came", F.current_timestamp())
    newest = F.max_by(F.struct(*others, "_came"), F.struct(*order, (-F.unix_micros("_came")).alias("_first")))
    state = timed.groupBy(*keys).agg(newest.alias("_row"), F.max("_came").alias("_touched"))
    changed = state.filter(F.col("_row._came") == F.col("_touched")).select(*keys, *(F.col(f"_row.{c}").alias(c) for c in others))

    def keep(batch: DataFrame, k: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={k}")

    with _rocksdb(spark):
        query = changed.select(*new.columns).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(StructType(list(new.schema.fields)).add("batch", "long")).parquet(f"{folder}/out")


def latest_state(new: DataFrame, keys: list[str], order: list[str], folder: str) -> DataFrame:
    """The newest row per key, from the log of changes."""
    return latest_by(state_changes(new, keys, order, folder), keys, [F.col("batch").desc()]).drop("batch")
