"""Validation rules as columns, their roll-up, and the reliability that follows from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the reliability policy.
SOURCE_QUALITY = {"API": 0.98, "TAGGED": 0.97, "PDF": 0.95, "WEBSITE": 0.85}
TRANSFORMATION_QUALITY = {"STRUCTURED": 0.99, "TAGGED": 0.98, "NATIVE_PDF": 0.95, "OCR": 0.85, "GROUNDED_MODEL": 0.85, "COMPLEX_MODEL": 0.75, "UNSUPPORTED_MODEL": 0.0}
VALIDATION_FACTOR = {"NONE": 0.0, "MEANINGFUL": 0.3, "STRONG": 0.6}
CONFLICT_FACTOR = {"NONE": 0.0, "PARTIAL_UNRESOLVED": 0.3, "SERIOUS_UNRESOLVED": 1.0}
MAX_RELIABILITY = 0.99


@dataclass(frozen=True)
class Rule:
    """A versioned rule: ``passes`` is null where a required input is missing."""

    rule_id: str
    version: str
    passes: Callable[[], Column]
    failure_code: str
    hard: bool = True


def outcomes(inputs: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """``key, rule_id, version, result, failure_code``: every rule on every input, in rule order."""
    rows = []
    for r in sorted(rules, key=lambda r: r.rule_id):
        p = r.passes()
        result = F.when(p.isNull(), "INCONCLUSIVE").when(p, "PASS").otherwise("FAIL")
        code = F.when(result == "FAIL", r.failure_code).when((result == "INCONCLUSIVE") & F.lit(r.hard), "MISSING_INPUT")
        rows.append(F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.version).alias("version"), result.alias("result"), code.alias("failure_code")))
    return inputs.select(key, F.inline(F.array(*rows)))


def report(outcomes: DataFrame, key: str) -> DataFrame:
    """Per input: status (FAIL over INCONCLUSIVE over PASS), its failures, and whether it is admissible (none)."""
    n = outcomes.groupBy(key).agg(
        F.bool_or(F.col("result") == "FAIL").alias("f"), F.bool_or(F.col("result") == "INCONCLUSIVE").alias("i"), F.array_join(F.array_sort(F.collect_set("failure_code")), ",").alias("failures")
    )
    return n.select(key, F.when(F.col("f"), "FAIL").when(F.col("i"), "INCONCLUSIVE").otherwise("PASS").alias("status"), "failures", (F.col("failures") == "").alias("admissible"))


def chronology(rows: DataFrame, key: str) -> DataFrame:
    """Per key whether every subject's start precedes its end."""
    return rows.groupBy(key).agg(F.bool_and(F.coalesce(F.col("appointed") <= F.col("resigned"), F.lit(True))).alias("in_order"), F.count_if(F.col("appointed") > F.col("resigned")).alias("breaks"))


def duplicates(rows: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """Per key whether its (subject, concept) pairs are unique and all present."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), F.count_distinct(*parts).alias("distinct_rows")).withColumn("passes", F.col("rows") == F.col("distinct_rows"))


#: Columns in which a competitor has to agree, stage by stage, and what explains the difference if none of the stage before does.
STAGES = (("company", "NONE"), ("concept", "NONE"), ("period", "PERIOD_DIFFERENCE"), ("unit", "UNIT_DIFFERENCE"))


def conflict_class(selected: DataFrame, competing: DataFrame, keys: list[str], stages: tuple[tuple[str, str], ...] = STAGES) -> DataFrame:
    """The conflict between the selected observation of each key and its competitors.

    Competitors are narrowed in stages: a difference explains the disagreement only if no competitor is left after its
    stage. Of those that agree in all stages, one with another value is a serious conflict; one without value is none.
    Stages whose column the tables do not have are passed. The selected observation itself does not compete.

    One aggregate finds how far any competitor gets, so that a key's competitors are counted where they lie.
    """
    have = [(c, why) for c, why in stages if c in selected.columns and c in competing.columns and c not in keys]
    s = selected.select(*keys, *(F.col(c).alias(f"s_{c}") for c in ("observation_id", "value", *(c for c, _ in have))))
    j = s.join(competing, keys, "left").filter(F.col("observation_id").isNotNull() & (F.col("observation_id") != F.col("s_observation_id")))
    passed = F.lit(0)
    for c, _ in reversed(have):
        passed = F.when(F.col(c).eqNullSafe(F.col(f"s_{c}")), 1 + passed).otherwise(0)
    j = j.withColumn("_passed", passed)
    differs = (F.col("_passed") == len(have)) & F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("s_value"))
    n = j.groupBy(*keys).agg(F.max("_passed").alias("passed"), F.bool_or(differs).alias("serious"))
    kind = F.when(F.col("serious"), "SERIOUS")
    for k, (_, why) in enumerate(have):
        kind = kind.when(F.col("passed") == k, why)
    return selected.select(*keys).distinct().join(n, keys, "left").select(*keys, kind.otherwise("NONE").alias("conflict"))


def recomputed(derived: DataFrame, components: DataFrame, key: str) -> DataFrame:
    """Each derived amount (``key, value, context``) against the sum of its components (``key, value, context``), exactly.

    INTACT if they are equal; else BROKEN. NO_COMPONENTS, COMPONENT_MISSING (one without value) and OTHER_CONTEXT (components, or
    the amount itself, of more than one context) leave nothing to compare.
    """
    n = components.groupBy(key).agg(
        F.sum("value").alias("_sum"), F.count("*").alias("components"), F.count("value").alias("_values"), F.min("context").alias("_low"), F.max("context").alias("_high")
    )
    j = derived.select(key, "value", "context").join(n, key, "left")
    one = F.col("_low").eqNullSafe(F.col("_high")) & F.col("_low").eqNullSafe(F.col("context"))
    verdict = F.when(F.col("components").isNull(), "NO_COMPONENTS").when(F.col("_values") < F.col("components"), "COMPONENT_MISSING").when(~one, "OTHER_CONTEXT").when(F.col("value").eqNullSafe(F.col("_sum")), "INTACT").otherwise("BROKEN")
    return j.select(key, F.coalesce("components", F.lit(0)).cast("long").alias("components"), verdict.alias("verdict"))


def lookup(table: dict[str, float], key: Column) -> Column:
    """A fixed table's value as an exact decimal; null for a key that it does not have."""
    return F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(str(v)).cast("decimal(4,2)")))), key)


def reliability(s: Column, e: Column, v: Column, c: Column, hard_failure: Column) -> Column:
    """``r`` in exact decimals: base S*E, raised by support, lowered by conflict, at most .99; 0 after a hard failure, null for an unmapped quality."""
    base = (s * e).cast("decimal(10,8)")
    raised = (base + ((1 - base) * v).cast("decimal(12,10)")).cast("decimal(12,10)")
    r = (raised * (1 - c)).cast("decimal(14,12)")
    return F.when(hard_failure, F.lit(0).cast("decimal(14,12)")).when(r.isNotNull(), F.least(F.lit("0.99").cast("decimal(14,12)"), r))


def assessed(inputs: DataFrame, key: str, outcomes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The whole assessment of each input: report, support, conflict, S, E, V, C, reliability, and the reason of each.

    ``inputs`` has ``key, source, transformation``; ``outcomes`` has ``key, rule_id, result, role, strength,
    independence_group, failure_code`` (admission failures and independent support); ``conflicts`` has ``key, conflict``.
    Only admission rules fail an input, by not passing. Support is the strongest candidate of any group of passed support rules. An unmapped source or transformation gives
    no reliability; a failure, a serious conflict or a number that a model made up without support gives 0.
    """
    hard = F.col("role") == "ADMISSION"
    support = (F.col("role") == "SUPPORT") & (F.col("result") == "PASS")
    rank = F.when(F.col("strength") == "STRONG", 2).when(F.col("strength") == "MEANINGFUL", 1).otherwise(0)
    n = outcomes.groupBy(key).agg(
        F.bool_or(hard & (F.col("result") == "FAIL")).alias("_f"), F.bool_or(hard & (F.col("result") == "INCONCLUSIVE")).alias("_i"),
        F.array_sort(F.collect_set(F.when(hard & (F.col("result") != "PASS"), F.col("failure_code")))).alias("_failures"),
        F.coalesce(F.max(F.when(support, rank)), F.lit(0)).alias("_rank"),
        F.count_distinct(F.when(support & (rank > 0), F.col("independence_group"))).alias("groups"),
    )
    j = inputs.select(key, "source", "transformation").join(n, key, "left").join(conflicts.select(key, "conflict"), key, "left")
    level = F.when(F.col("conflict") == "SERIOUS", "SERIOUS_UNRESOLVED").when(F.col("conflict") == "PARTIAL", "PARTIAL_UNRESOLVED").otherwise("NONE")
    extra = F.array(F.when(F.col("transformation") == "UNSUPPORTED_MODEL", "UNSUPPORTED_LLM_NUMERIC"), F.when(level == "SERIOUS_UNRESOLVED", "SERIOUS_UNRESOLVED_CONFLICT"))
    failures = F.array_sort(F.array_distinct(F.concat(F.coalesce("_failures", F.array().cast("array<string>")), F.array_compact(extra))))
    names = F.array(*map(F.lit, VALIDATION_FACTOR))
    j = j.select(
        key, "source", "transformation", F.coalesce("groups", F.lit(0)).alias("groups"), F.coalesce("conflict", F.lit("NONE")).alias("conflict"), level.alias("_level"),
        F.when(F.col("_f"), "FAIL").when(F.col("_i"), "INCONCLUSIVE").otherwise("PASS").alias("status"), failures.alias("failures"),
        F.get(names, F.coalesce("_rank", F.lit(0))).alias("support"),
        lookup(SOURCE_QUALITY, F.col("source")).alias("s"), lookup(TRANSFORMATION_QUALITY, F.col("transformation")).alias("e"),
    )
    j = j.withColumns({"v": lookup(VALIDATION_FACTOR, F.col("support")), "c": lookup(CONFLICT_FACTOR, F.col("_level"))})
    text = lambda c: F.col(c).cast("string")
    return j.withColumns({
        "r": reliability(F.col("s"), F.col("e"), F.col("v"), F.col("c"), F.size("failures") > 0),
        "source_reason": F.when(F.col("s").isNull(), "unmapped source").otherwise(F.concat(F.lit("source="), "source", F.lit(": S="), text("s"))),
        "transformation_reason": F.when(F.col("e").isNull(), "unmapped transformation").otherwise(F.concat(F.lit("transformation="), "transformation", F.lit(": E="), text("e"))),
        "support_reason": F.when(F.col("support") == "NONE", "no independent support").otherwise(F.concat("support", F.lit(" from "), text("groups"), F.lit(" groups: V="), text("v"))),
        "conflict_reason": F.concat("conflict", F.lit(": C="), text("c")),
    }).drop("_level")


def violations(checks: dict[str, Column]) -> Column:
    """The names of the checks that a row breaks, comma-joined."""
    return F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in checks.items()))), ",")


def weakest_component(rows: DataFrame, key: str, quality: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(quality).alias(quality))


def latest_first(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter("_k = 1").drop("_k")
