"""Queries for fact derivation (A05-A16), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derivation as D
from ..sources import adapters
from ..sources.adapters import CONCEPTS, table, with_ctes
from .base import Query, r6

MONEY = "CAST(l_extendedprice AS DECIMAL(12,2))"
TARGETS = CONCEPTS[:5]
_IN5 = ", ".join(f"'{c}'" for c in TARGETS)


def _money():
    return F.col("l_extendedprice").cast("decimal(12,2)")


def _a05(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("observation_id"),
        F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("value"), F.when(F.col("l_partkey") % 2 == 0, "EXTRACTION_FAILED").otherwise("RETRIEVAL_FAILED").alias("availability"),
    )
    return D.unique_value(li, ["l_orderkey", "l_linenumber"])


_A05 = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN n = 1 THEN v END AS value, CASE WHEN n = 1 THEN 'AVAILABLE' WHEN n > 1 THEN 'CONFLICT_UNRESOLVED' ELSE m END AS availability FROM (
  SELECT l_orderkey, l_linenumber, count(DISTINCT value) AS n, max(value) AS v, arg_min(a, id) FILTER (value IS NULL) AS m FROM (
    SELECT *, l_partkey * 1000 + l_suppkey AS id, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS value, CASE WHEN l_partkey % 2 = 0 THEN 'EXTRACTION_FAILED' ELSE 'RETRIEVAL_FAILED' END AS a FROM lineitem) GROUP BY 1, 2)"""


def _a06(s: SparkSession, d: str) -> DataFrame:
    c = D.coverage(adapters.facts(s, d), ["company", "yr"], CONCEPTS)
    return c.select("company", "yr", F.array_join("resolved", ",").alias("resolved"), F.array_join("unknown", ",").alias("unknown"))


_A06 = f"""SELECT company, yr, string_agg(concept, ',' ORDER BY concept) FILTER (have) AS resolved, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (NOT have), '') AS unknown FROM (
  SELECT k.company, k.yr, t.concept, f.concept IS NOT NULL AS have FROM (SELECT DISTINCT company, yr FROM facts) k CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in CONCEPTS)}) t(concept)
  LEFT JOIN facts f ON f.company = k.company AND f.yr = k.yr AND f.concept = t.concept) GROUP BY 1, 2"""

RULES = (("QUICK_ASSETS", "CURRENT_ASSETS", "INVENTORY", -1), ("TOTAL_OBLIGATIONS", "CURRENT_LIABILITIES", "INTEREST_BEARING_DEBT", 1))


def _a07(s: SparkSession, d: str) -> DataFrame:
    return D.derived_subtotals(adapters.facts(s, d), ["company", "yr"], RULES).select("company", "yr", "concept", F.col("value").cast("double").alias("value"))


_A07 = """SELECT company, yr, 'QUICK_ASSETS' AS concept, CAST(ca - inv AS DOUBLE) AS value FROM statements WHERE ca - inv >= 0 UNION ALL SELECT company, yr, 'TOTAL_OBLIGATIONS', CAST(cl + debt AS DOUBLE) FROM statements WHERE cl + debt >= 0"""


def _a08(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("schedule"), F.when(F.col("l_quantity") < 48, _money()).alias("value"), F.col("l_linenumber").cast("string").alias("label"), F.lit(1).alias("context"), (F.col("l_returnflag") == "A").alias("says_complete")
    )
    return D.component_sum(li, "schedule", ("1", "2", "3", "4", "5", "6")).select("schedule", F.col("total").cast("double").alias("total"), "reason")


_A08 = f"""SELECT schedule, CASE WHEN reason IS NULL THEN total END AS total, reason FROM (SELECT l_orderkey AS schedule, CAST(sum(CASE WHEN l_quantity < 48 THEN {MONEY} END) AS DOUBLE) AS total,
  CASE WHEN count(*) FILTER (l_quantity < 48) < count(*) THEN 'COMPONENT_MISSING' WHEN count(DISTINCT l_linenumber) < count(*) THEN 'REPEATED_LABEL' WHEN NOT bool_and(l_linenumber <= 6) THEN 'LABEL_NOT_ALLOWED' WHEN NOT bool_or(l_returnflag = 'A') THEN 'NOT_COMPLETE' END AS reason
  FROM lineitem GROUP BY 1)"""


def _a09(s: SparkSession, d: str) -> DataFrame:
    """Completeness cross-check: the order's total against the sum of its lines, within what was reported."""
    sums = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(_money()).alias("total"))
    o = table(s, d, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    reported = F.when(F.col("o_orderkey") % 3 == 0, F.col("total")).otherwise(F.col("o_totalprice").cast("decimal(12,2)"))
    return o.select("o_orderkey", F.when(F.col("total").isNull(), "NO_COMPONENTS").when(F.col("total") == reported, "ACCEPTED").otherwise("REJECTED").alias("verdict"))


_A09 = f"SELECT o_orderkey, CASE WHEN t IS NULL THEN 'NO_COMPONENTS' WHEN o_orderkey % 3 = 0 OR t = CAST(o_totalprice AS DECIMAL(12,2)) THEN 'ACCEPTED' ELSE 'REJECTED' END AS verdict FROM orders LEFT JOIN (SELECT l_orderkey, sum({MONEY}) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


def _a10(s: SparkSession, d: str) -> DataFrame:
    """Per order: its total, less its lines, over their number; pending orders begin with a subtraction."""
    op = lambda k, o, c: F.struct(k.alias("position"), o.alias("op"), c.cast("decimal(20,4)").alias("value"))
    order = table(s, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    lines = table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    taken = lines.groupBy("l_orderkey").agg(F.collect_list(op(F.lit(10_000) + F.col("l_linenumber"), F.lit("SUBTRACT"), F.col("l_extendedprice"))).alias("taken"), F.count("*").alias("n"))
    o = order.join(taken, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    start = F.array(op(F.lit(1).cast("long"), F.when(F.col("o_orderstatus") == "P", "SUBTRACT").otherwise("ADD"), F.col("o_totalprice")))
    share = F.array(op(F.lit(1_000_000).cast("long"), F.lit("DIVIDE"), F.coalesce("n", F.lit(0))))
    kind = "array<struct<position: bigint, op: string, value: decimal(20,4)>>"
    r = o.select("o_orderkey", D.fold(F.concat(start.cast(kind), F.coalesce(F.col("taken").cast(kind), F.array().cast(kind)), share.cast(kind))).alias("r"))
    return r.select("o_orderkey", r6("value", F.col("r.numerator").cast("double") / F.col("r.denominator").cast("double") / 10_000), F.col("r.reason").alias("reason"))


_A10 = """SELECT o_orderkey, CASE WHEN reason IS NULL THEN round(CAST(c AS DOUBLE) / n / 100, 6) END AS value, reason FROM (
  SELECT *, CASE WHEN o_orderstatus = 'P' THEN 'INVALID_EXPRESSION' WHEN n IS NULL THEN 'DIVISION_BY_ZERO' WHEN n > 30 THEN 'INVALID_EXPRESSION' WHEN (c::HUGEINT * 1000000000000000000::HUGEINT) % n <> 0 THEN 'INEXACT' END AS reason
  FROM (SELECT o_orderkey, o_orderstatus, n, CAST(round(o_totalprice * 100) AS BIGINT) - coalesce(cents, 0) AS c FROM orders LEFT JOIN (
    SELECT l_orderkey, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey))"""


def _a11(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("input_id"), F.when(F.col("l_linestatus") == "O", "SUPPORT").otherwise("CHECK").alias("role"), F.when(F.col("l_quantity") > 10, "PASS").otherwise("FAIL").alias("result"),
        F.when(F.col("l_tax") > 0.06, "STRONG").when(F.col("l_tax") > 0.02, "MEANINGFUL").otherwise("NONE").alias("strength"), (F.col("l_suppkey") % 4).alias("independence_group"), (F.col("l_returnflag") == "R").alias("construction_only"),
    )
    return D.support_strength(li, "input_id")


_A11 = """SELECT l_orderkey AS input_id, CASE coalesce(max(s), 0) WHEN 2 THEN 'STRONG' WHEN 1 THEN 'MEANINGFUL' ELSE 'NONE' END AS strength, count(DISTINCT CASE WHEN s IS NOT NULL THEN l_suppkey % 4 END) AS groups FROM (
  SELECT *, CASE WHEN l_linestatus = 'O' AND l_quantity > 10 AND l_returnflag <> 'R' THEN CASE WHEN l_tax > 0.06 THEN 2 WHEN l_tax > 0.02 THEN 1 ELSE 0 END END AS s FROM lineitem) GROUP BY 1"""

NEEDS = {"F1.1": ("NET_ASSETS", "TOTAL_ASSETS"), "F1.2": ("NET_ASSETS",), "F2.2": ("CURRENT_ASSETS", "CURRENT_LIABILITIES"), "F2.3": ("CURRENT_ASSETS", "INVENTORY", "CURRENT_LIABILITIES"), "F3.1": ("INTEREST_BEARING_DEBT", "TOTAL_ASSETS")}
TREND = ("F1.2", "NET_ASSETS")


def _a13(s: SparkSession, d: str) -> DataFrame:
    who = table(s, d, "customer").select(F.col("c_custkey").alias("company"))
    return D.readiness(who, adapters.facts(s, d), NEEDS, TREND)


_NEED_ROWS = ", ".join(f"('{code}', '{c}')" for code, n in NEEDS.items() for c in n)
_A13 = f"""SELECT company, period_end, code, count(f) AS present, coalesce(string_agg(concept, ',' ORDER BY concept) FILTER (f IS NULL), '') AS missing, count(f) = count(*) AS ready, max(candidates) AS candidates FROM (
  SELECT c_custkey AS company, NULL::DATE AS period_end, code, n.concept, h.concept AS f, CASE WHEN code = 'F1.2' THEN coalesce(k, 0) END AS candidates FROM customer CROSS JOIN (VALUES {_NEED_ROWS}) n(code, concept)
    LEFT JOIN (SELECT DISTINCT company, concept FROM facts) h ON h.company = c_custkey AND h.concept = n.concept LEFT JOIN (SELECT company, count(DISTINCT period_end) AS k FROM facts WHERE concept = 'NET_ASSETS' GROUP BY 1) t ON t.company = c_custkey
  UNION ALL SELECT p.company, p.period_end, code, n.concept, h.concept, NULL FROM (SELECT DISTINCT company, period_end FROM facts) p CROSS JOIN (VALUES {_NEED_ROWS}) n(code, concept) LEFT JOIN (SELECT DISTINCT company, period_end, concept FROM facts) h
    ON h.company = p.company AND h.period_end = p.period_end AND h.concept = n.concept WHERE code <> 'F1.2') GROUP BY 1, 2, 3"""


def _a14(s: SparkSession, d: str) -> DataFrame:
    return D.completed(adapters.facts(s, d), CONCEPTS).select("company", "period_end", "concept", F.col("value").cast("double").alias("value"), "reason")


_A14 = f"""SELECT p.company, p.period_end, t.concept, CAST(f.value AS DOUBLE) AS value, CASE WHEN f.value IS NULL THEN 'NOT_DISCLOSED' END AS reason
FROM (SELECT DISTINCT company, period_end FROM facts) p CROSS JOIN (VALUES {', '.join(f"('{c}')" for c in CONCEPTS)}) t(concept) LEFT JOIN facts f ON f.company = p.company AND f.period_end = p.period_end AND f.concept = t.concept"""

METHODS = ("DIRECT", "APPROVED", "DERIVED", "MODEL")


def _a16(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("period"), F.element_at(F.array(*map(F.lit, METHODS)), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("method"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("proposal_id"), (F.col("l_quantity") > 5).alias("valid"),
    )
    return D.decide(li, ["period"], METHODS).groupBy("method", "status").agg(F.count("*").alias("n"))


_A16 = """SELECT method, status, count(*) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'DIRECT' WHEN 1 THEN 'APPROVED' WHEN 2 THEN 'DERIVED' ELSE 'MODEL' END AS method,
  CASE WHEN l_quantity <= 5 THEN 'VALIDATION_FAILED' WHEN row_number() OVER (PARTITION BY l_orderkey, l_quantity > 5 ORDER BY l_linenumber % 4, l_partkey * 1000 + l_suppkey) = 1 THEN 'SELECTED' ELSE 'SUPERSEDED' END AS status FROM lineitem) GROUP BY 1, 2"""


def queries() -> dict[str, Query]:
    return {
        "A05_unique_value": Query(_a05, _A05),
        "A06_concept_coverage": Query(_a06, with_ctes(["facts"], _A06)),
        "A07_derived_subtotals": Query(_a07, with_ctes(["statements"], _A07)),
        "A08_component_sum": Query(_a08, _A08),
        "A09_completeness_check": Query(_a09, _A09),
        "A10_ordered_expression": Query(_a10, _A10),
        "A11_support_strength": Query(_a11, _A11),
        "A12_run_status": Query(
            lambda s, d: D.run_status(table(s, d, "orders").select(F.col("o_custkey").alias("run"), (F.col("o_orderstatus") == "F").alias("complete")), "run"),
            "SELECT o_custkey AS run, CASE WHEN bool_and(o_orderstatus = 'F') THEN 'COMPLETE' WHEN bool_or(o_orderstatus = 'F') THEN 'PARTIAL' ELSE 'FAILED' END AS status FROM orders GROUP BY 1",
        ),
        "A13_readiness_matrix": Query(_a13, with_ctes(["facts"], _A13)),
        "A14_missing_fact_rows": Query(_a14, with_ctes(["facts"], _A14)),
        "A15_evidence_inventory": Query(lambda s, d: table(s, d, "events").groupBy(F.col("user_id").alias("company"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n")), "SELECT user_id AS company, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2"),
        "A16_decision_precedence": Query(_a16, _A16),
    }
