"""A versioned store of published payloads.

A version is a manifest that names, for each bucket of keys, the folder that holds it. Publishing writes new folders for
the buckets in which something changed and leaves the others; the manifest is written last, under a new number, so
that readers see a whole version or the one before. Publishing the same payloads again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
#: What a row of the store has beside its key.
FIELDS = "payload string, payload_hash string, config string, accounts_run long, control_run long, version long"


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def manifest(spark: SparkSession, folder: str) -> tuple[int, dict[int, str]]:
    """The newest version and the folder of each of its buckets; version 0 of an empty store has none."""
    files, at = _path(spark, f"{folder}/manifest")
    if not files.exists(at):
        return 0, {}
    newest = max((int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()), default=0)
    if not newest:
        return 0, {}
    text = spark.read.text(f"{folder}/manifest/{newest}", wholetext=True).first()["value"]  # a line a bucket
    return newest, {int(b): p for b, p in json.loads(text).items()}


def _commit(spark: SparkSession, folder: str, version: int, where: dict[int, str]) -> None:
    """Write the manifest aside and rename it: two writers of one version cannot both succeed."""
    files, aside = _path(spark, f"{folder}/manifest/.{version}-{uuid.uuid4().hex}")
    out = files.create(aside)
    out.write(bytearray(json.dumps(where).encode()))
    out.close()
    _, final = _path(spark, f"{folder}/manifest/{version}")
    if files.exists(final) or not files.rename(aside, final):
        files.delete(aside, False)
        raise RuntimeError(f"version {version} was published by another writer")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, folder: str, key: str, key_type: str = "long", only: list[int] | None = None) -> DataFrame:
    """The rows of the newest version (of the buckets ``only``)."""
    _, where = manifest(spark, folder)
    schema = f"{key} {key_type}, {FIELDS}"
    paths = sorted({f"{p}/bucket={b}" for b, p in where.items() if only is None or b in only})
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def publish(rows: DataFrame, folder: str, key: str, buckets: int = BUCKETS) -> int:
    """Upsert ``key, payload, config, accounts_run, control_run`` and return the version that has them.

    A key occurs once; its row is replaced if payload, configuration or a run differ. A null key is refused.
    """
    spark = rows.sparkSession
    version, where = manifest(spark, folder)
    kind = rows.schema[key].dataType.simpleString()
    content = ("payload_hash", "config", "accounts_run", "control_run")
    checked = rows.select(F.when(F.col(key).isNull(), F.raise_error(F.lit("a published key is null"))).otherwise(F.col(key)).alias(key), "payload", F.sha2("payload", 256).alias("payload_hash"), "config", "accounts_run", "control_run")
    known = read(spark, folder, key, kind).select(key, F.struct(*content).alias("_known"))
    changed = checked.join(known, key, "left").filter(~F.struct(*content).eqNullSafe(F.col("_known"))).drop("_known")
    changed = changed.withColumn("version", F.lit(version + 1).cast("long")).withColumn("bucket", _bucket(key, buckets))
    touched = sorted(r["bucket"] for r in changed.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return version
    kept = read(spark, folder, key, kind, touched).withColumn("bucket", _bucket(key, buckets)).join(changed.select(key), key, "left_anti")
    target = f"{folder}/data/{uuid.uuid4().hex}"
    # a bucket is dealt over several tasks, each of which writes one file of it
    spread = F.pmod(F.hash(key), F.lit(4))
    kept.unionByName(changed).repartition("bucket", spread).write.partitionBy("bucket").parquet(target)
    _commit(spark, folder, version + 1, where | {b: target for b in touched})
    return version + 1


def status(published: DataFrame, latest: DataFrame, key: str, config: str) -> DataFrame:
    """Whether each key's published row can be shown, or why not; ``latest`` has the newest runs of every key."""
    p = published.withColumnsRenamed({"accounts_run": "_accounts", "control_run": "_control"})
    j = latest.select(key, "accounts_run", "control_run").join(p, key, "left")
    newer = ~(F.col("accounts_run").eqNullSafe(F.col("_accounts")) & F.col("control_run").eqNullSafe(F.col("_control")))
    why = F.when(F.col("payload").isNull(), "MISSING").when(F.col("config") != config, "OLD_CONFIG").when(newer, "NEWER_EVIDENCE").when(F.sha2("payload", 256) != F.col("payload_hash"), "HASH_MISMATCH")
    return j.select(key, why.isNull().alias("shown"), F.coalesce(why, F.lit("CURRENT")).alias("status"))
