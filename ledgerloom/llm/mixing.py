"""Mixing sources to target weights by entropy balancing.

Every document starts with rate 1. Entropy balancing finds the rates that are closest to that, in relative
entropy summed over documents, among those that meet each source's word target and stay at ``max_rate`` or
below. They are exponentially tilted by size: ``min(max_rate, exp(lambda_source * size))``, where ``lambda``
minimises the convex dual ``sum over documents of phi(lambda * size) - lambda * target``. Its gradient and
Hessian are sums over all documents of a source, so that each Newton iteration is one distributed aggregate;
documents of equal source and size are counted together first. A step that leaves the bracket of the root, as
Newton's can beyond documents whose rate is at the bound, is replaced by bisection. Rates are then rounded
into whole copies.

Defined results
---------------
* null or empty text has size 0 and takes 0 words; null sources form one source, last in order;
* ranks go by code point; the weight pattern repeats over them;
* a source without words has target 0;
* ties in the rounding order are broken by a hash of the id; repeated rows are
  mixed as rows of their own; an empty table gives an empty result;
* reruns agree: nothing depends on the layout of the input.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table, words

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MAX_RATE = 2.0
#: Iterations between two writes of the tilts, and writes at most.
STEPS_A_ROUND, NEWTON_ROUNDS = 4, 40
#: Rates are rounded to units of this part of a copy, so that their sums are exact.
UNIT = 1 << 32
#: How near, as a share, a source's expected words come to its target.
PRECISION = 1e-9
#: Rows that one rounding stratum holds on average at most.
STRATUM_ROWS = 5_000


def _source_key(source: Column) -> Column:
    """A non-null key; the null source sorts and joins as a key of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with ``rank`` (0, 1, ...) by code point, null last, without one task seeing all."""
    ordered = materialize(
        sources.orderBy(F.col("source").asc_nulls_last()).select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "mix-sources"
    )
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ordered.join(parts, "part").withColumn("rank", F.col("before") + F.col("pos") - F.col("first")).drop("part", "pos", "first", "before")


def water_fill(sources: DataFrame, budget: float, cap: float) -> DataFrame:
    """``sources`` (``weight``, ``source_size``) with ``target``: shares of ``budget`` by weight, at most ``cap`` times the size, the excess reshared."""
    level = 0.0
    while True:
        full = F.col("source_size") * cap <= F.col("weight") * level
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size") * cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("free"),
        ).first()
        if not row["free"]:
            break
        new = max(0.0, budget - row["held"]) / row["free"]
        if new <= level * (1 + 1e-15):
            break
        level = new
    return sources.withColumn("target", F.least(F.col("source_size") * cap, F.col("weight") * F.lit(level)).cast("double"))


def balanced(sizes: DataFrame, targets: DataFrame, max_rate: float) -> DataFrame:
    """``(key, tilt)``: the dual's solution for each source, from ``sizes`` (``key, size, n``) and ``targets`` (``key, source_size, target``).

    A source whose target is its ``max_rate``-fold size, or without words, needs none: null.
    """
    # sizes are measured by the source's mean size, so that tilts are alike in all sources
    scale = F.col("source_size") / F.col("words")
    goal = targets.join(sizes.groupBy("key").agg(F.sum(F.when(F.col("size") > 0, F.col("n"))).alias("words")), "key")
    goal = goal.filter((F.col("target") > 0) & (F.col("target") < F.col("source_size") * (max_rate * (1 - 1e-12)))).select("key", "target", scale.alias("scale"))
    more = F.col("target") > F.col("source_size")
    start = targets.select("key", F.lit(0.0).alias("tilt"), "source_size").join(goal, "key")
    # at the upper end all rates are at the bound; at the lower end, of 700, none is left
    top = F.col("scale") * math.log(max_rate)
    state = start.select("key", "target", "scale", "tilt", F.when(more, 0.0).otherwise(-700.0 * F.col("scale")).alias("low"), F.when(more, top).otherwise(0.0).alias("high"), F.lit(False).alias("done"))
    state = materialize(state, "mix-tilts")
    words_of = sizes.filter("size > 0").select("key", "size", "n")
    for _ in range(NEWTON_ROUNDS):
        if state.filter("not done").isEmpty():
            return state.select("key", (F.col("tilt") / F.col("scale")).alias("tilt"))
        now = state
        for _ in range(STEPS_A_ROUND):
            now = _newton(words_of, now, max_rate)
        state = materialize(now, "mix-tilts")
    raise RuntimeError(f"the dual of the mix is not solved after {NEWTON_ROUNDS * STEPS_A_ROUND} steps")


def _newton(sizes: DataFrame, state: DataFrame, max_rate: float) -> DataFrame:
    """One iteration for every source: gradient and Hessian over its documents, then a Newton step or a bisection."""
    x = F.col("size") / F.col("scale")
    free = F.exp(F.col("tilt") * x)
    rate, bound = F.least(free, F.lit(float(max_rate))), free >= max_rate
    # decimals add up alike in any order, so that reruns agree
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    at = sizes.join(state, "key").groupBy(*state.columns).agg(
        exact(F.col("n") * F.col("size") * rate).alias("moment"), exact(F.when(bound, 0.0).otherwise(F.col("n") * F.col("size") * x * free)).alias("slope")
    )
    over = F.col("moment") > F.col("target")
    at = at.withColumns({"low": F.when(over, F.col("low")).otherwise(F.col("tilt")), "high": F.when(over, F.col("tilt")).otherwise(F.col("high"))})
    step = F.col("tilt") - F.try_divide(F.col("moment") - F.col("target"), F.col("slope"))
    inside = F.coalesce((step > F.col("low")) & (step < F.col("high")), F.lit(False))
    met = F.abs(F.col("moment") - F.col("target")) <= PRECISION * F.col("target")
    narrow = F.col("high") - F.col("low") <= 1e-15 * F.abs(F.col("high") + F.col("low"))
    done = F.col("done") | met | narrow
    return at.select("key", "target", "scale", F.when(done, F.col("tilt")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2).alias("tilt"), "low", "high", done.alias("done"))


def _unit(*cols: Column) -> Column:
    """A number from 0 to UNIT, without UNIT, from a hash."""
    return F.pmod(F.xxhash64(*cols), F.lit(UNIT))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, max_rate: float = MAX_RATE, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """For each row of ``docs``: ``doc_id, size, source_size, target, rate, copies, taken``, and ``key`` and ``said`` of its source and text."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), F.xxhash64(text_col).alias("said"))
    sized = materialize(sized.withColumn("key", _source_key(F.col("source"))), "mix-sizes")
    per_source = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = _ranked(per_source)
    pattern = F.array(*(F.lit(float(w)) for w in weights))
    ranked = materialize(ranked.withColumn("weight", F.get(pattern, (F.col("rank") % len(weights)).cast("int"))), "mix-ranks")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    targets = water_fill(ranked, budget * total, max_rate)
    targets = materialize(targets.select("key", "source_size", "target", "rows"), "mix-targets")
    tilts = balanced(materialize(sized.groupBy("key", "size").agg(F.count("*").alias("n")), "mix-counts"), targets, max_rate)
    targets = materialize(targets.join(tilts, "key", "left"), "mix-targets")
    most = F.lit(float(max_rate))
    rate = F.when((F.col("target") <= 0) | (F.col("size") == 0), 0.0).when(F.col("tilt").isNull(), most).otherwise(F.least(most, F.exp(F.col("tilt") * F.col("size"))))

    # systematic rounding inside strata of alike sizes, each small enough for one task
    spread = sized.join(targets, "key").withColumn("rate", rate).drop("tilt").withColumn("h", F.xxhash64("doc_id", "said"))
    spread = spread.withColumn("bin", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    spread = spread.withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("rows") / STRATUM_ROWS)).cast("int"))
    stratum = Window.partitionBy("key", "bin", "bucket").orderBy("size", "h", "doc_id")
    units, u = F.round(F.col("rate") * UNIT).cast("long"), _unit(F.col("key"), F.col("bin"), F.col("bucket"))
    spread = spread.withColumns({"units": units, "u": u})
    upto = F.sum("units").over(stratum.rowsBetween(Window.unboundedPreceding, 0)) + F.col("u")
    copies = F.floor(F.col("upto") / UNIT) - F.floor((F.col("upto") - F.col("units")) / UNIT)
    rounded = spread.withColumn("upto", upto).withColumn("copies", F.least(copies, F.lit(int(max_rate))).cast("int"))
    rounded = materialize(rounded.drop("upto", "units", "u", "rows", "bucket"), "mix-rounded")

    # what rounding left over goes to (or comes from) a few documents of falling size
    gap = rounded.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("gap"))
    doc = F.struct("size", "h", "doc_id")
    choice = (
        rounded.filter("size > 0")
        .groupBy("key", "bin")
        .agg(F.max(F.when(F.col("copies") < int(max_rate), doc)).alias("more"), F.max(F.when(F.col("copies") > 0, doc)).alias("less"))
        .groupBy("key")
        .agg(F.collect_list("more").alias("more"), F.collect_list("less").alias("less"))
        .join(gap, "key")
        .select("key", "gap", F.sort_array(F.when(F.col("gap") > 0, F.col("more")).otherwise(F.col("less")), asc=False).alias("choices"))
    )
    start = F.struct(F.abs(F.col("gap")).alias("left"), F.filter(F.col("choices"), lambda c: F.lit(False)).alias("picked"))

    def pick(acc: Column, c: Column) -> Column:
        take = c["size"] <= acc["left"]
        return F.struct(F.when(take, acc["left"] - c["size"]).otherwise(acc["left"]).alias("left"), F.when(take, F.concat(acc["picked"], F.array(c))).otherwise(acc["picked"]).alias("picked"))

    picks = choice.select("key", F.signum("gap").cast("int").alias("change"), F.explode(F.aggregate("choices", start, pick)["picked"]).alias("p"))
    picks = picks.select(F.col("key").alias("p_key"), "change", F.col("p.h").alias("p_h"), F.col("p.doc_id").alias("p_id"))
    done = rounded.join(picks, (F.col("key") == F.col("p_key")) & (F.col("h") == F.col("p_h")) & F.col("doc_id").eqNullSafe(F.col("p_id")), "left")
    final = F.least(F.lit(int(max_rate)), F.greatest(F.lit(0), F.col("copies") + F.coalesce(F.col("change"), F.lit(0))))
    return done.select("doc_id", "size", "source_size", "target", "rate", final.alias("copies"), (final * F.col("size")).cast("long").alias("taken"), "key", "said")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it (not at all, once, or twice).

    Rows equal in id, text and source are all taken as often as the one taken most.
    """
    of = lambda name, default: F.col(options.get(f"{name}_col", default))
    n, key, said, own = (free_name(docs, x) for x in ("_copies", "_source", "_said", "_own"))
    plan = mix(docs, **options).groupBy(F.col("doc_id").alias(own), F.col("key").alias(key), F.col("said").alias(said)).agg(F.max("copies").alias(n)).filter(F.col(n) > 0)
    same = of("id", "doc_id").eqNullSafe(plan[own]) & (_source_key(of("source", "source")) == plan[key]) & (F.xxhash64(of("text", "text")) == plan[said])
    taken = docs.join(plan, same)
    return taken.select(*(docs[f"`{c}`"] for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(n))).alias(n)).drop(n)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
