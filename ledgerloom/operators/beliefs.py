"""Beliefs of single variables and their combination by Evidential Reasoning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown mass below this is rounding noise.
SNAP = 1e-12


def anchored_high(value: Column, low_ref: Column, high_ref: Column) -> Column:
    """How far ``value`` is on the way from the low-risk to the high-risk level, between 0 and 1; levels may descend."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value - low_ref) / (high_ref - low_ref)))


def memberships(values: DataFrame, variables: DataFrame) -> DataFrame:
    """``values`` (company, code, value) with ``low, high, unknown``; a missing value is unknown as a whole."""
    v = values.join(F.broadcast(variables.select("code", "low_ref", "high_ref")), "code")
    high = anchored_high(F.col("value"), F.col("low_ref"), F.col("high_ref"))
    known = F.col("value").isNotNull()
    return v.withColumns({"high": F.when(known, high).otherwise(0.0), "low": F.when(known, 1 - high).otherwise(0.0), "unknown": F.when(known, 0.0).otherwise(1.0)})


def leaves(companies: DataFrame, values: DataFrame, variables: DataFrame) -> DataFrame:
    """One leaf for each company and variable: beliefs discounted once by the reliability ``r`` (the least of the mandatory inputs)."""
    grid = companies.select("company").crossJoin(F.broadcast(variables.select("code", "low_ref", "high_ref", "unit")))  # a few variables per company
    v = grid.join(values, ["company", "code"], "left")
    known = F.col("value").isNotNull() & F.col("r").isNotNull()
    high = anchored_high(F.col("value"), F.col("low_ref"), F.col("high_ref"))
    r = F.when(known, F.col("r")).otherwise(0.0)
    return v.withColumns({"high": F.when(known, r * high).otherwise(0.0), "low": F.when(known, r * (1 - high)).otherwise(0.0), "unknown": 1 - r})


#: Stored beliefs may differ so much from their reproduction.
TOLERANCE = 1e-8


def reproduced(stored: DataFrame, variables: DataFrame) -> DataFrame:
    """Each stored leaf with ``same``: whether its stored inputs (``value``, ``r``) and the model's levels give its beliefs again.

    A leaf without value or reliability has to be unknown as a whole; one of a variable that the model does not have is not reproduced.
    """
    v = stored.join(F.broadcast(variables.select("code", "low_ref", "high_ref")), "code", "left")
    known = F.col("value").isNotNull() & F.col("r").isNotNull()
    high = anchored_high(F.col("value"), F.col("low_ref"), F.col("high_ref"))
    want = {"high": F.when(known, F.col("r") * high).otherwise(0.0), "low": F.when(known, F.col("r") * (1 - high)).otherwise(0.0), "unknown": F.when(known, 1 - F.col("r")).otherwise(1.0)}
    near = reduce(Column.__and__, (F.abs(F.col(c) - x) <= TOLERANCE for c, x in want.items()))
    return v.withColumn("same", F.coalesce(near & F.col("low_ref").isNotNull(), F.lit(False))).drop("low_ref", "high_ref")


def combine(children: DataFrame, keys: list[str]) -> DataFrame:
    """Analytical Evidential Reasoning: ``keys`` with ``low, high, unknown`` from children (``weight, low, high``).

    The four products are aggregates, so that partial products are made before the shuffle. Factors may be
    0, which rules logarithms out. A single child is returned as it is. Where the normalisation is
    undefined, all three are null.
    """
    w, low, high = F.col("weight"), F.col("low"), F.col("high")
    rest = 1 - w * (low + high)
    p = children.groupBy(*keys).agg(
        F.product(w * low + rest).alias("_l"), F.product(w * high + rest).alias("_h"), F.product(rest).alias("_b"), F.product(1 - w).alias("_c"),
        F.count("*").alias("_n"), F.max("low").alias("_low1"), F.max("high").alias("_high1"),
    )
    mu = F.try_divide(F.lit(1.0), F.col("_l") + F.col("_h") - F.col("_b"))
    share = lambda x: F.when(F.col("_n") == 1, F.col(f"_{x}1")).otherwise(F.try_divide(mu * (F.col("_l" if x == "low" else "_h") - F.col("_b")), 1 - mu * F.col("_c")))
    out = p.select(*keys, share("low").alias("low"), share("high").alias("high"))
    left = 1 - F.col("low") - F.col("high")
    return out.withColumn("unknown", F.when(F.abs(left) < SNAP, 0.0).otherwise(left))


def aggregate_tree(leaves: DataFrame, hierarchy: DataFrame, levels: int, key: str = "company") -> DataFrame:
    """``(key, node, level, low, high, unknown)`` of all inner nodes, combined from the deepest level up.

    The hierarchy is a small fixed table. One aggregate puts a company's leaves (one for each code) into a row; all
    nodes are expressions over it. Leaves that a company lacks do not take part; a node without any has no row.
    """
    edges = hierarchy.select("parent", "child", "weight", "level").collect()  # tens of rows: the model
    parents = {e["parent"] for e in edges}
    codes = sorted({e["child"] for e in edges} - parents)
    name = {c: f"_{k}" for k, c in enumerate([*codes, *sorted(parents)])}
    row = leaves.filter(F.col("code").isin(*codes)).groupBy(key).agg(*(F.max(F.when(F.col("code") == c, F.struct("low", "high"))).alias(name[c]) for c in codes))
    nodes = []
    for level in range(levels, 0, -1):
        here = sorted({e["parent"] for e in edges if e["level"] == level})
        row = row.withColumns({name[p]: _combined([(F.col(name[e["child"]]), e["weight"]) for e in edges if e["parent"] == p and e["level"] == level]) for p in here})
        nodes += [F.struct(F.lit(p).alias("node"), F.lit(level).alias("level"), F.col(name[p]).alias("b")) for p in here]
    out = row.select(key, F.inline(F.array(*nodes))).filter("b is not null").select(key, "node", "b.low", "b.high", "level")
    left = 1 - F.col("low") - F.col("high")
    return out.select(key, "node", "low", "high", F.when(F.abs(left) < SNAP, 0.0).otherwise(left).alias("unknown"), "level")


def _combined(children: list[tuple[Column, float]]) -> Column:
    """The struct ``(low, high)`` of a node over its children's, as in :func:`combine`; null without any."""
    weights = [w for _, w in children]
    names = [f"c{k}" for k in range(len(children))]

    def node(x: Column) -> Column:
        beliefs = [x[n] for n in names]
        there = [c.isNotNull() for c in beliefs]
        n = reduce(Column.__add__, [t.cast("int") for t in there])
        rest = [1 - w * (c["low"] + c["high"]) for c, w in zip(beliefs, weights, strict=True)]
        product = lambda factors: reduce(Column.__mul__, [F.when(t, f).otherwise(1.0) for t, f in zip(there, factors, strict=True)])
        low, high = (product([w * c[side] + r for c, w, r in zip(beliefs, weights, rest, strict=True)]) for side in ("low", "high"))
        products = F.struct(low.alias("low"), high.alias("high"), product(rest).alias("none"), product([F.lit(1 - w) for w in weights]).alias("free"))
        shares = _once(products, lambda p: _shares(p["low"], p["high"], p["none"], p["free"]))
        return F.when(n == 1, F.coalesce(*beliefs)).when(n > 1, shares)

    return _once(F.struct(*(c.alias(n) for (c, _), n in zip(children, names, strict=True))), node)


def _shares(low: Column, high: Column, none: Column, free: Column) -> Column:
    mu = F.try_divide(F.lit(1.0), low + high - none)
    return F.struct(*(F.try_divide(mu * (x - none), 1 - mu * free).alias(n) for x, n in ((low, "low"), (high, "high"))))


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row: a lambda's variable is not worked out again where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def belief_violations(beliefs: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Rows whose beliefs do not sum to 1 or leave [0, 1]."""
    total = F.col("low") + F.col("high") + F.col("unknown")
    bad = F.abs(total - 1) > tolerance
    for c in ("low", "high", "unknown"):
        bad = bad | ~F.col(c).between(-tolerance, 1 + tolerance)
    return beliefs.filter(bad)
