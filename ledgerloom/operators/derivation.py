"""From observed amounts to canonical facts: uniqueness, coverage, derived subtotals, completeness, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_value(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Per key the one value that all observations agree on; else null and CONFLICT_UNRESOLVED, or the first missing status."""
    n = rows.groupBy(*keys).agg(
        F.count_distinct(value).alias("_n"), F.max(value).alias(value), F.min_by("availability", F.when(F.col(value).isNull(), F.col("observation_id"))).alias("_missing")
    )
    return n.select(*keys, F.when(F.col("_n") == 1, F.col(value)).alias(value), F.when(F.col("_n") == 1, "AVAILABLE").when(F.col("_n") > 1, "CONFLICT_UNRESOLVED").otherwise(F.coalesce("_missing", F.lit("NOT_DISCLOSED"))).alias("availability"))


def coverage(facts: DataFrame, keys: list[str], targets: tuple[str, ...]) -> DataFrame:
    """Per key the targets with exactly one value, and those without."""
    one = facts.filter(F.col("concept").isin(*targets)).groupBy(*keys, "concept").agg(F.count_distinct("value").alias("n"))
    have = one.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(F.col("n") == 1, F.col("concept")))).alias("resolved"))
    return have.withColumn("unknown", F.array_sort(F.array_except(F.array(*map(F.lit, targets)), F.col("resolved"))))


def derived_subtotals(facts: DataFrame, keys: list[str], rules: tuple[tuple[str, str, str, int], ...]) -> DataFrame:
    """``keys, concept, value`` of subtotals ``left + sign * right``; a repeated operand, a negative result or a direct value gives none."""
    names = sorted({x for _, a, b, _ in rules for x in (a, b)} | {r[0] for r in rules})
    n = facts.filter(F.col("concept").isin(*names)).groupBy(*keys).agg(*(F.count_if(F.col("concept") == c).alias(f"n_{c}") for c in names), *(F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c) for c in names))
    out = None
    for target, left, right, sign in rules:
        value = F.col(left) + sign * F.col(right)
        one = n.filter((F.col(f"n_{left}") == 1) & (F.col(f"n_{right}") == 1) & (F.col(f"n_{target}") == 0) & (value >= 0)).select(*keys, F.lit(target).alias("concept"), value.cast("decimal(20,4)").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def component_sum(components: DataFrame, schedule: str, allowed: tuple[str, ...]) -> DataFrame:
    """The sum of a schedule's components if all are available, distinct, of allowed labels, in one context, and said to be complete."""
    # one row for each label first: distinct counts of several columns would multiply the rows before they are shuffled
    label = components.groupBy(schedule, "label").agg(
        F.sum("value").alias("total"), F.count("*").alias("n"), F.count("value").alias("values"), F.min("context").alias("first"), F.max("context").alias("last"), F.bool_or("says_complete").alias("said")
    )
    n = label.groupBy(schedule).agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.count("label").alias("labels"), F.bool_and(F.col("label").isin(*allowed)).alias("known"),
        F.sum("values").alias("values"), (F.min("first") != F.max("last")).alias("contexts"), F.bool_or("said").alias("said"),
    )
    reason = (
        F.when(F.col("values") < F.col("n"), "COMPONENT_MISSING").when(F.col("labels") < F.col("n"), "REPEATED_LABEL").when(~F.col("known"), "LABEL_NOT_ALLOWED").when(F.col("contexts"), "OTHER_CONTEXT").when(~F.coalesce("said", F.lit(False)), "NOT_COMPLETE")
    )
    return n.select(schedule, F.when(reason.isNull(), F.col("total")).alias("total"), reason.alias("reason"))


_INTEGER = "decimal(38,0)"
MAX_OPERANDS = 32
#: Digits behind the numerator's last one that an exact quotient may have.
MAX_DIGITS = 18


def fold(operands: Column) -> Column:
    """Exact left-to-right value of an ordered array of ``struct(position, op, value decimal(20,4))``.

    The result is ``struct(numerator, denominator, reason)``; the value is ``numerator / denominator`` ten-thousandths. There is none,
    but a reason, for no or more than 32 operands, a first operation other than ADD or an unknown one (INVALID_EXPRESSION), a
    missing value (MISSING_OPERAND), a division by 0 (DIVISION_BY_ZERO) or one whose quotient does not end (INEXACT), and more
    than 38 digits (OVERFLOW). All steps are in integers: sums keep the denominator, only divisions and factors with a
    fraction raise it, and nothing is rounded.
    """
    ten = F.array(*(F.lit(10**k).cast(_INTEGER) for k in range(MAX_DIGITS + 1)))
    times = lambda x, y: F.try_multiply(x, y).cast(_INTEGER)
    state = lambda n, d, why=None: F.struct(n.cast(_INTEGER).alias("numerator"), d.cast(_INTEGER).alias("denominator"), (F.lit(why).cast("string") if why is None or isinstance(why, str) else why).alias("reason"))
    refused = lambda why: state(F.lit(None), F.lit(None), why)

    def fits(n: Column, d: Column) -> Column:
        return F.when(n.isNull() | d.isNull(), refused("OVERFLOW")).otherwise(state(n, d))

    def step(acc: Column, x: Column) -> Column:
        n, d = acc["numerator"], acc["denominator"]
        units = (x["value"] * 10_000).cast(_INTEGER)
        whole = units % 10_000 == 0
        # as a fraction: a whole number over 1, else ten-thousandths
        top = F.when(whole, x["value"].cast(_INTEGER)).otherwise(units)
        bottom = F.when(whole, 1).otherwise(10_000).cast(_INTEGER)
        shift = times(units, d)
        over, under = times(times(n, bottom), F.signum(top).cast(_INTEGER)), times(d, F.abs(top))
        ends = F.exists(F.sequence(F.lit(0), F.lit(MAX_DIGITS)), lambda k: F.coalesce(times(over, F.get(ten, k)) % under == 0, F.lit(False)))
        divided = F.when(units == 0, refused("DIVISION_BY_ZERO")).when(over.isNull() | under.isNull(), refused("OVERFLOW")).when(ends, state(over, under)).otherwise(refused("INEXACT"))
        return (
            F.when(acc["reason"].isNotNull(), acc)
            .when(x["value"].isNull(), refused("MISSING_OPERAND"))
            .when(x["op"] == "ADD", fits(F.try_add(n, shift).cast(_INTEGER), d))
            .when(x["op"] == "SUBTRACT", fits(F.try_subtract(n, shift).cast(_INTEGER), d))
            .when(x["op"] == "MULTIPLY", fits(times(n, top), times(d, bottom)))
            .when(x["op"] == "DIVIDE", divided)
            .otherwise(refused("INVALID_EXPRESSION"))
        )

    first = F.get(F.array_sort(operands), F.lit(0))
    bad = operands.isNull() | ~F.size(operands).between(1, MAX_OPERANDS) | ~F.coalesce(first["op"] == "ADD", F.lit(False))
    return F.when(bad, refused("INVALID_EXPRESSION")).otherwise(F.aggregate(F.array_sort(operands), state(F.lit(0), F.lit(1)), step))


STRENGTHS = ("NONE", "MEANINGFUL", "STRONG")


def support_strength(outcomes: DataFrame, key: str) -> DataFrame:
    """The strongest passing support per key: one outcome per independence group counts, more of them do not add up."""
    rank = F.array_position(F.array(*map(F.lit, STRENGTHS)), F.col("strength")).cast("long") - 1
    groups = outcomes.filter((F.col("role") == "SUPPORT") & (F.col("result") == "PASS") & ~F.col("construction_only")).groupBy(key, "independence_group").agg(F.max(rank).alias("s"))
    best = groups.groupBy(key).agg(F.max("s").alias("s"), F.count("*").alias("groups"))
    return outcomes.select(key).distinct().join(best, key, "left").select(key, F.element_at(F.array(*map(F.lit, STRENGTHS)), (F.coalesce("s", F.lit(0)) + 1).cast("int")).alias("strength"), F.coalesce("groups", F.lit(0)).cast("long").alias("groups"))


def run_status(parts: DataFrame, key: str) -> DataFrame:
    return parts.groupBy(key).agg(F.when(F.bool_and("complete"), "COMPLETE").when(F.bool_or("complete"), "PARTIAL").otherwise("FAILED").alias("status"))


def readiness(companies: DataFrame, facts: DataFrame, needs: dict[str, tuple[str, ...]], trend: tuple[str, str] | None = None) -> DataFrame:
    """``company, period_end, code, present, missing, ready, candidates``: the concepts that each variable has and lacks.

    Rows without a period say what a company has in any period, rows with one what that period has. ``trend`` (code,
    concept) is a variable over periods: it has no rows of single periods, and ``candidates`` counts those with its concept.
    Facts count if they have a value and, where facts say so, are available. Both kinds of rows come from one aggregate
    over grouping sets; a group holds names of concepts, of which there are few.
    """
    known = F.col("value").isNotNull()
    if "availability" in facts.columns:
        known = known & (F.col("availability") == "AVAILABLE")
    grid = [F.col("company"), F.col("period_end")]
    names = sorted({c for n in needs.values() for c in n})
    have = facts.groupingSets([[grid[0]], grid], *grid).agg(
        F.grouping("period_end").alias("_any"), F.array_sort(F.collect_set(F.when(known & F.col("concept").isin(*names), F.col("concept")))).alias("_have"),
        F.count_distinct(F.when(known & (F.col("concept") == (trend[1] if trend else "")), F.col("period_end"))).alias("_periods"),
    )
    whole = companies.select("company").join(have.filter("_any = 1").drop("_any"), "company", "left")
    single = companies.select("company").join(have.filter("_any = 0").drop("_any"), "company")
    none = F.array().cast("array<string>")

    def rows(df: DataFrame, codes: list[str], any_period: bool) -> DataFrame:
        got = F.coalesce("_have", none)
        parts = []
        for code in codes:
            lacks = F.array_except(F.array(*map(F.lit, sorted(needs[code]))), got)
            candidates = F.coalesce("_periods", F.lit(0)).cast("long") if any_period and trend and code == trend[0] else F.lit(None).cast("long")
            parts.append(F.struct(F.lit(code).alias("code"), (F.lit(len(needs[code])) - F.size(lacks)).cast("long").alias("present"), F.array_join(lacks, ",").alias("missing"), (F.size(lacks) == 0).alias("ready"), candidates.alias("candidates")))
        return df.select("company", "period_end", F.inline(F.array(*parts)))

    return rows(whole, list(needs), True).unionByName(rows(single, [c for c in needs if not trend or c != trend[0]], False))


def completed(facts: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """Every (company, period, target) with its value, or an explicit row with a reason."""
    periods = facts.select("company", "period_end").distinct()
    grid = periods.select("company", "period_end", F.explode(F.array(*map(F.lit, targets))).alias("concept"))
    j = grid.join(facts.select("company", "period_end", "concept", "value"), ["company", "period_end", "concept"], "left")
    return j.withColumn("reason", F.when(F.col("value").isNull(), "NOT_DISCLOSED"))


def decide(proposals: DataFrame, keys: list[str], precedence: tuple[str, ...]) -> DataFrame:
    """Proposals with ``status``: the valid one of the first method wins, other valid ones are superseded, invalid ones failed."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("method"))
    w = Window.partitionBy(*keys, "valid").orderBy(rank, "proposal_id")
    k = F.row_number().over(w)
    return proposals.withColumn("status", F.when(~F.col("valid"), "VALIDATION_FAILED").when(k == 1, "SELECTED").otherwise("SUPERSEDED"))
