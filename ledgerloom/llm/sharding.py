"""Sharding by extendible hashing.

Each document hashes to 60 bits. The directory is indexed by leading bits; only
buckets above the byte limit are split on one more bit, until every shard fits.

Defined results
---------------
* null or empty text counts 0 bytes; a null id hashes like the empty string;
* rows with equal ids hash alike and stay in one shard; a shard whose rows all
  hash alike cannot be split, and is marked ``oversized`` if it is above the limit
  (so is a single document above the limit);
* an empty table gives an empty result;
* input columns named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, table

#: Production limit of a shard's text bytes.
SHARD_BYTES = 64 * 1024 * 1024

HASH_BITS = 60

#: A directory of up to so many cells is broadcast (under 50 MB); a larger one is joined by shuffle.
BROADCAST_CELLS = 500_000


def hash_bits(doc_id: Column) -> Column:
    """The first 60 bits of the id's MD5 as a non-negative long."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth) -> Column:
    return F.call_function("shiftright", h, (F.lit(HASH_BITS) - depth).cast("int"))


def _leaves(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell of ``high`` bits, the bucket of ``low`` to ``high`` bits that holds it.

    ``rows`` has ``h`` and ``n_bytes``. Cells whose ``high``-bit bucket is still too
    large get a null depth.
    """
    cells = materialize(
        rows.groupBy(_prefix(F.col("h"), F.lit(high)).alias("cell")).agg(
            F.sum("n_bytes").alias("b"), F.count("*").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")
        ),
        "shard-cells",
    )
    paths = cells.select("cell", "b", "n", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).withColumn(
        "prefix", F.expr(f"shiftright(cell, {high} - depth)")
    )
    buckets = paths.groupBy("depth", "prefix").agg(
        F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    fits = buckets.filter((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi")))
    first = (
        paths.select("cell", "depth", "prefix")
        .join(fits.select("depth", "prefix", "shard_bytes", "shard_docs"), ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "prefix", "shard_bytes", "shard_docs")).alias("s"))
    )
    return cells.select("cell").join(first, "cell", "left").select("cell", "s.depth", "s.prefix", "s.shard_bytes", "s.shard_docs")


def assign_shards(docs: DataFrame, limit_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes``, ``shard_depth``, ``shard_id`` (the bucket's bits), ``shard_bytes``, ``shard_docs`` and ``oversized``."""
    if limit_bytes < 1:
        raise ValueError("limit_bytes must be positive")
    sized = docs.select(hash_bits(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    sized = materialize(sized, "shard-sizes")
    total = sized.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(HASH_BITS, max(1, math.ceil(math.log2(total / limit_bytes + 1)) + 4))
    open_rows, levels = sized, []
    while True:
        leaves = materialize(_leaves(open_rows, low, high, limit_bytes), "shard-directory")
        levels.append((high, leaves.filter("depth is not null")))
        too_large = leaves.filter("depth is null").select("cell")
        if high == HASH_BITS or too_large.isEmpty():
            break
        open_rows = open_rows.withColumn("cell", _prefix(F.col("h"), F.lit(high))).join(too_large, "cell", "left_semi").select("h", "n_bytes")
        low, high = high + 1, min(HASH_BITS, high + 8)

    out, h, cell = docs, free_name(docs, "_h"), free_name(docs, "_cell")
    out = out.withColumn(h, hash_bits(F.col(id_col)))
    found = []
    for k, (bits, leaves) in enumerate(levels):
        found.append(s := free_name(docs, f"_shard{k}"))
        side = leaves.select(F.col("cell").alias(cell), F.struct("depth", "prefix", "shard_bytes", "shard_docs").alias(s))
        side = F.broadcast(side) if leaves.count() <= BROADCAST_CELLS else side
        out = out.withColumn(cell, _prefix(F.col(h), F.lit(bits))).join(side, cell, "left").drop(cell)
    s = F.coalesce(*(F.col(x) for x in found))
    bits = F.lpad(F.conv(s["prefix"].cast("string"), 10, 2), HASH_BITS, "0")
    named = {
        "n_bytes": F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long"),
        "shard_depth": s["depth"],
        "shard_id": F.when(s["depth"] == 0, F.lit("")).otherwise(F.right(bits, s["depth"])),
        "shard_bytes": s["shard_bytes"],
        "shard_docs": s["shard_docs"],
        "oversized": s["shard_bytes"] > limit_bytes,
    }
    return out.withColumns(named).drop(h, *found)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "n_bytes", "shard_depth", "shard_id", "shard_bytes", "shard_docs", "oversized")


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
p AS (SELECT d.*, k.depth, h >> ({HASH_BITS} - k.depth) AS prefix
      FROM d, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, {HASH_BITS + 1})) k),
b AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs, min(h) AS lo, max(h) AS hi
      FROM p GROUP BY depth, prefix),
f AS (SELECT p.doc_id, p.h, p.n_bytes, p.depth, p.prefix, b.shard_bytes, b.shard_docs,
             row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS k
      FROM p JOIN b USING (depth, prefix) WHERE b.shard_bytes <= {SHARD_BYTES} OR b.lo = b.hi)
SELECT doc_id, n_bytes, depth AS shard_depth,
       CASE WHEN depth = 0 THEN '' ELSE right(lpad(CAST(prefix::BIT AS VARCHAR), 64, '0'), depth) END AS shard_id,
       CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_docs, shard_bytes > {SHARD_BYTES} AS oversized
FROM f WHERE k = 1
"""
