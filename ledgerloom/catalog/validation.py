"""Queries for rules, reliability and record checks (R01-R23, Q01, U01, U02), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import validation as V
from ..sources import adapters
from ..sources.adapters import table, with_ctes
from .base import Query

AS_OF = f"DATE '{adapters.AS_OF}'"


def _inputs(s: SparkSession, d: str) -> DataFrame:
    """Lines as analytical inputs: a total order of fields that the rules look at."""
    o = table(s, d, "orders")
    li = table(s, d, "lineitem")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select((F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("l_partkey") % 10).alias("input_id"), "l_quantity", "l_tax", "l_shipdate", "o_orderdate", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), "l_returnflag")


RULES = [
    V.Rule("evidence.dated", "1", lambda: F.col("l_shipdate") >= F.col("o_orderdate"), "SHIPPED_BEFORE_ORDER"),
    V.Rule("evidence.amount", "1", lambda: F.col("l_quantity") < 45, "TOO_LARGE"),
    V.Rule("evidence.status", "2", lambda: F.col("status") == "F", "NOT_FINAL", hard=False),
]


def _one_per_input(s: SparkSession, d: str) -> DataFrame:
    i = _inputs(s, d)
    return i.groupBy("input_id").agg(*(F.max(c).alias(c) for c in i.columns if c != "input_id"))


def _r01(s: SparkSession, d: str) -> DataFrame:
    return V.outcomes(_one_per_input(s, d), "input_id", RULES).groupBy("rule_id", "version", "result", "failure_code").agg(F.count("*").alias("n"))


_ONE = """one AS (SELECT input_id, max(l_quantity) AS q, max(l_shipdate) AS ship, max(o_orderdate) AS od, max(status) AS status FROM (
  SELECT l_orderkey * 100 + l_linenumber * 10 + l_partkey % 10 AS input_id, l_quantity, l_shipdate, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1),
outcome AS (SELECT input_id, 'evidence.dated' AS rule_id, '1' AS version, CASE WHEN ship >= od THEN 'PASS' ELSE 'FAIL' END AS result, CASE WHEN ship < od THEN 'SHIPPED_BEFORE_ORDER' END AS failure_code FROM one
UNION ALL SELECT input_id, 'evidence.amount', '1', CASE WHEN q < 45 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN q >= 45 THEN 'TOO_LARGE' END FROM one
UNION ALL SELECT input_id, 'evidence.status', '2', CASE WHEN status IS NULL THEN 'INCONCLUSIVE' WHEN status = 'F' THEN 'PASS' ELSE 'FAIL' END, CASE WHEN status <> 'F' THEN 'NOT_FINAL' END FROM one)"""


def _r02(s: SparkSession, d: str) -> DataFrame:
    return V.report(V.outcomes(_one_per_input(s, d), "input_id", RULES), "input_id")


_R02 = f"""WITH {_ONE} SELECT input_id, CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL' WHEN bool_or(result = 'INCONCLUSIVE') THEN 'INCONCLUSIVE' ELSE 'PASS' END AS status,
  coalesce(string_agg(failure_code, ',' ORDER BY failure_code), '') AS failures, count(failure_code) = 0 AS admissible FROM outcome GROUP BY 1"""


def _r04(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("company")).agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    start = F.add_months(adapters.as_of(), -36)
    return o.select("company", (F.col("a") <= start).alias("covered"), (F.col("b") <= adapters.as_of()).alias("within_as_of"))


def _r08(s: SparkSession, d: str) -> DataFrame:
    need = ("1-URGENT", "5-LOW")
    o = table(s, d, "orders").filter(F.col("o_orderstatus") != "P").groupBy(F.col("o_custkey").alias("company")).agg(F.collect_set("o_orderpriority").alias("have"))
    return o.select("company", (F.size(F.array_except(F.array(*map(F.lit, need)), F.col("have"))) == 0).alias("passes"))


def _r09(s: SparkSession, d: str) -> DataFrame:
    b = adapters.obligations(s, d)
    return b.select("obligation_id", F.col("company").isNotNull().alias("identity"), (F.col("observed_at") <= adapters.as_of()).alias("observation"), (F.col("due") > F.col("period")).alias("deadline"), (F.col("filed").isNull() | (F.col("filed") >= F.col("period"))).alias("filing_match"))


def _facts_pair(s: SparkSession, d: str) -> DataFrame:
    """Canonical against source facts: lines against their order."""
    li, o = table(s, d, "lineitem"), table(s, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left")


def _r10(s: SparkSession, d: str) -> DataFrame:
    j = _facts_pair(s, d)
    return j.groupBy((F.col("l_suppkey") % 100).alias("bucket")).agg(F.count("*").alias("facts"), F.count_if(F.col("o_custkey") % 100 == F.col("l_suppkey") % 100).alias("same_company"))


def _r11(s: SparkSession, d: str) -> DataFrame:
    claims = table(s, d, "lineitem").select("l_suppkey", "l_orderkey").distinct()
    e = claims.join(table(s, d, "orders").filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return e.groupBy("l_suppkey").agg(F.count("*").alias("claimed"), F.count("o_custkey").alias("resolved")).withColumn("grounded", F.col("claimed") == F.col("resolved"))


def _r12(s: SparkSession, d: str) -> DataFrame:
    j = _facts_pair(s, d)
    role = F.when(F.col("l_returnflag") == "A", "CURRENT").otherwise("COMPARATIVE")
    y, doc = F.year("l_shipdate"), F.year("o_orderdate")
    return j.select("l_orderkey", role.alias("role"), F.when(role == "CURRENT", y == doc).otherwise(y < doc).alias("ok")).groupBy("l_orderkey").agg(F.bool_and("ok").alias("passes"), F.count_if(~F.col("ok")).alias("mismatches"))


def _r13(s: SparkSession, d: str) -> DataFrame:
    heading = F.element_at(F.array(*map(F.lit, ("Company balance sheet", "Consolidated balance sheet", "Notes"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    scope = S.scope_of_heading(heading)
    wanted = F.when(F.col("p_size") % 2 == 0, "COMPANY").otherwise("GROUP")
    return table(s, d, "part").select("p_partkey", F.when(scope == "UNRESOLVED", "INCONCLUSIVE").when(scope == wanted, "PASS").otherwise("FAIL").alias("result"))


def _currency(c: str):
    """A currency as a filing may print it: in capitals, or not."""
    return F.when(F.col("n_regionkey") == 0, F.lit("GBP")).when(F.col("n_regionkey") == 1, F.upper(F.substring(c, 1, 3))).when(F.col("n_regionkey") == 2, F.substring(c, 1, 3)).otherwise(F.substring(c, 1, 2))


def _r14(s: SparkSession, d: str) -> DataFrame:
    """The currency of an order's line (of its supplier's country) against the order's (of its customer's): three capitals, and the same."""
    n, c, su, o, li = (table(s, d, t) for t in ("nation", "customer", "supplier", "orders", "lineitem"))
    of = F.broadcast(n.select("n_nationkey", _currency("n_name").alias("currency")))  # the nations
    buyer = c.join(of, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("currency").alias("bought"))
    seller = su.join(of, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("currency").alias("sold"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(buyer, F.col("o_custkey") == F.col("c_custkey")).join(seller, F.col("l_suppkey") == F.col("s_suppkey"))
    ok = F.col("sold").rlike("^[A-Z]{3}$") & (F.col("sold") == F.col("bought"))
    return j.groupBy("l_orderkey").agg(F.count("*").alias("facts"), F.bool_and(ok).alias("passes"))


_CUR = "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'GBP' WHEN 1 THEN upper(left(n_name, 3)) WHEN 2 THEN left(n_name, 3) ELSE left(n_name, 2) END AS cur FROM nation"
_R14 = f"""SELECT l_orderkey, count(*) AS facts, bool_and(regexp_full_match(sn.cur, '[A-Z]{{3}}') AND sn.cur = cn.cur) AS passes FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN ({_CUR}) cn ON cn.n_nationkey = c_nationkey
JOIN supplier ON l_suppkey = s_suppkey JOIN ({_CUR}) sn ON sn.n_nationkey = s_nationkey GROUP BY 1"""


def _r15(s: SparkSession, d: str) -> DataFrame:
    scale = (F.col("p_size") - 22).cast("int")
    known = F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
    ok = F.when(F.col("p_type") == "ECONOMY", scale.isin(0, 3)).otherwise(scale.between(-18, 18))
    return table(s, d, "part").select("p_partkey", (known & ok).alias("passes"))


def _r16(s: SparkSession, d: str) -> DataFrame:
    mapping = s.createDataFrame([("1-URGENT", "ACCOUNTS", "v2"), ("2-HIGH", "ACCOUNTS", "v1"), ("5-LOW", "STATEMENT", "v2")], "o_orderpriority string, target string, version string")
    j = table(s, d, "orders").join(F.broadcast(mapping), "o_orderpriority", "left")
    want = F.when(F.col("o_orderkey") % 2 == 0, "ACCOUNTS").otherwise("STATEMENT")
    accepted = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100_000)
    return j.select("o_orderkey", F.when((F.col("version") == "v2") & (F.col("target") == want), "PASS").when(accepted, "PASS").when(F.col("target").isNull(), "INCONCLUSIVE").otherwise("FAIL").alias("result"))


_R16 = """SELECT o_orderkey, CASE WHEN (o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0) OR (o_orderpriority = '5-LOW' AND o_orderkey % 2 = 1) OR (o_orderstatus = 'F' AND o_totalprice > 100000) THEN 'PASS'
  WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '5-LOW') THEN 'INCONCLUSIVE' ELSE 'FAIL' END AS result FROM orders"""


def _r17(s: SparkSession, d: str) -> DataFrame:
    """The discount of an order, rounded once, against that of its lines, rounded each, where all of them have one status."""
    off = F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_discount").cast("decimal(4,2)")
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), off.alias("off"), F.col("l_linestatus").alias("context"))
    whole = li.groupBy("o_orderkey").agg(F.round(F.sum("off"), 2).cast("decimal(20,2)").alias("value"), F.min("context").alias("context"))
    derived = table(s, d, "orders").select("o_orderkey").join(whole, "o_orderkey", "left")
    return V.recomputed(derived, li.select("o_orderkey", F.round("off", 2).cast("decimal(20,2)").alias("value"), "context"), "o_orderkey")


_R17 = """SELECT o_orderkey, coalesce(n, 0) AS components, CASE WHEN n IS NULL THEN 'NO_COMPONENTS' WHEN contexts > 1 THEN 'OTHER_CONTEXT' WHEN whole = parts THEN 'INTACT' ELSE 'BROKEN' END AS verdict FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linestatus) AS contexts, round(sum(x), 2) AS whole, sum(round(x, 2)) AS parts FROM (SELECT l_orderkey, l_linestatus, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2)) AS x FROM lineitem) GROUP BY 1) ON l_orderkey = o_orderkey"""


def _r18(s: SparkSession, d: str) -> DataFrame:
    need = {"A": "SUBTOTAL", "R": "SCHEDULE", "N": "NOTE"}
    proof = F.when(F.col("l_linenumber") <= 3, "SUBTOTAL").when(F.col("l_linenumber") <= 5, "SCHEDULE").otherwise("NOTE")
    required = F.element_at(F.create_map(*(F.lit(x) for kv in need.items() for x in kv)), F.col("l_returnflag"))
    li = table(s, d, "lineitem").withColumn("ok", proof == required)
    return li.groupBy("l_returnflag").agg(F.count("*").alias("facts"), F.count_if("ok").alias("proved"))


def _r19(s: SparkSession, d: str) -> DataFrame:
    """TA - CL must equal the subtotal that is reported: here over the orders of the year that have lines, from those lines."""
    tax = F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * F.col("l_tax").cast("decimal(4,2)")).alias("cl")
    per_order = table(s, d, "lineitem").groupBy("l_orderkey").agg(tax)
    o = table(s, d, "orders").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    reported = o.groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").cast("long").alias("yr")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,4)") - F.col("cl") * 20).cast("decimal(20,4)").alias("reported"))
    st = adapters.statements(s, d).join(reported, ["company", "yr"], "left")
    agrees = (F.col("ta") - F.col("cl")) == F.col("reported")
    return st.select("company", "yr", F.when(agrees.isNull(), "INCONCLUSIVE").when(agrees, "PASS").otherwise("FAIL").alias("result"), F.when(agrees, "STRONG").otherwise("NONE").alias("strength"))


_R19 = """SELECT s.company, s.yr, CASE WHEN ta - cl = reported THEN 'PASS' WHEN ta - cl <> reported THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS result, CASE WHEN ta - cl = reported THEN 'STRONG' ELSE 'NONE' END AS strength
FROM statements s LEFT JOIN (SELECT o_custkey AS company, year(o_orderdate) AS yr, CAST(sum(CAST(o_totalprice AS DECIMAL(20,4)) - t * 20) AS DECIMAL(20,4)) AS reported FROM orders JOIN (
  SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS t FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1, 2) r ON r.company = s.company AND r.yr = s.yr"""


def _observations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Lines as observations of their order's amount, and the one that is selected: the first by id."""
    line = F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    li = table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("k"), line.alias("observation_id"), F.col("l_linestatus").alias("concept"), F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value")
    )
    first = li.groupBy("k").agg(F.min_by(F.struct(*(c for c in li.columns if c != "k")), "observation_id").alias("o")).select("k", "o.*")
    return first, li


def _r20(s: SparkSession, d: str) -> DataFrame:
    return V.conflict_class(*_observations(s, d), ["k"]).groupBy("conflict").agg(F.count("*").alias("n"))


_CONFLICT = """li AS (SELECT l_orderkey AS k, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS id, l_linestatus AS con, year(l_shipdate) AS per, l_returnflag AS unit, l_quantity AS val FROM lineitem),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rk FROM li) WHERE rk = 1),
stage AS (SELECT sel.k, count(li.id) FILTER (li.con = sel.con) AS same_concept, count(li.id) FILTER (li.con = sel.con AND li.per = sel.per) AS same_period, count(li.id) FILTER (li.con = sel.con AND li.per = sel.per AND li.unit = sel.unit) AS same_unit,
  count(li.id) FILTER (li.con = sel.con AND li.per = sel.per AND li.unit = sel.unit AND li.val <> sel.val) AS disagree FROM sel LEFT JOIN li ON li.k = sel.k AND li.id <> sel.id GROUP BY 1),
conflict AS (SELECT k, CASE WHEN same_concept = 0 THEN 'NONE' WHEN same_period = 0 THEN 'PERIOD_DIFFERENCE' WHEN same_unit = 0 THEN 'UNIT_DIFFERENCE' WHEN disagree > 0 THEN 'SERIOUS' ELSE 'NONE' END AS conflict FROM stage)"""
_R20 = f"WITH {_CONFLICT} SELECT conflict, count(*) AS n FROM conflict GROUP BY 1"

#: Where an order's amount comes from and how it was read, as far as its columns say.
_SOURCES = {"1-URGENT": "API", "2-HIGH": "TAGGED", "3-MEDIUM": "PDF", "5-LOW": "WEBSITE"}
_READINGS = {"BUILDING": "STRUCTURED", "AUTOMOBILE": "TAGGED", "MACHINERY": "NATIVE_PDF", "HOUSEHOLD": "OCR", "FURNITURE": "UNSUPPORTED_MODEL"}


def _named(names: dict[str, str], key: str):
    return F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), F.col(key))


def _assessed(s: SparkSession, d: str) -> DataFrame:
    """The assessment of every order: rules and support from its lines, conflict from its observations."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.sum(cents("l_extendedprice")).alias("amount"), F.sum(cents("l_tax")).alias("tax"), F.count("*").alias("n"))
    o = table(s, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    who = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    o = o.join(who, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", _named(_SOURCES, "o_orderpriority").alias("source"), _named(_READINGS, "c_mktsegment").alias("transformation"), "o_orderdate", "first", "amount", cents("o_totalprice").alias("total"), "tax", "n")
    rules = [
        V.Rule("financial.period", "1", lambda: F.col("first") >= F.col("o_orderdate"), "PERIOD_MISMATCH"),
        V.Rule("support.tax", "1", lambda: F.col("tax") <= 4 * F.col("n"), "NO_SUPPORT", hard=False),
        V.Rule("support.total", "1", lambda: F.col("amount") >= F.col("total"), "NO_SUPPORT", hard=False),
    ]
    admission = F.col("rule_id") == "financial.period"
    found = V.outcomes(o, "o_orderkey", rules).select(
        "o_orderkey", "rule_id", "result", F.when(admission, "ADMISSION").otherwise("SUPPORT").alias("role"),
        F.when(F.col("rule_id") == "support.total", "STRONG").when(F.col("rule_id") == "support.tax", "MEANINGFUL").otherwise("NONE").alias("strength"),
        F.when(~admission, F.col("rule_id")).alias("independence_group"), F.when(admission, F.col("failure_code")).alias("failure_code"),
    )
    conflicts = V.conflict_class(*_observations(s, d), ["k"]).withColumnRenamed("k", "o_orderkey")
    return V.assessed(o, "o_orderkey", found, conflicts).join(o.select("o_orderkey", "o_custkey"), "o_orderkey")


def _cases(column: str, names: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" if isinstance(v, str) else f"WHEN '{k}' THEN CAST({v} AS DECIMAL(4,2))" for k, v in names.items()) + " END"


_ASSESSED = f"""{_CONFLICT},
lines AS (SELECT l_orderkey, min(l_shipdate) AS first, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS amount, sum(CAST(round(l_tax * 100) AS BIGINT)) AS tax, count(*) AS n FROM lineitem GROUP BY 1),
graded AS (SELECT *, {_cases("source", V.SOURCE_QUALITY)} AS s, {_cases("transformation", V.TRANSFORMATION_QUALITY)} AS e, {_cases("support", V.VALIDATION_FACTOR)} AS v, CAST(CASE WHEN conflict = 'SERIOUS' THEN 1 ELSE 0 END AS DECIMAL(4,2)) AS c,
    concat_ws(',', CASE WHEN period_ok IS NULL THEN 'MISSING_INPUT' END, CASE WHEN NOT period_ok THEN 'PERIOD_MISMATCH' END, CASE WHEN conflict = 'SERIOUS' THEN 'SERIOUS_UNRESOLVED_CONFLICT' END, CASE WHEN transformation = 'UNSUPPORTED_MODEL' THEN 'UNSUPPORTED_LLM_NUMERIC' END) AS failures
  FROM (SELECT o_orderkey, o_custkey, {_cases("o_orderpriority", _SOURCES)} AS source, {_cases("c_mktsegment", _READINGS)} AS transformation, first >= o_orderdate AS period_ok,
      CASE WHEN coalesce(amount >= CAST(round(o_totalprice * 100) AS BIGINT), false) THEN 'STRONG' WHEN coalesce(tax <= 4 * n, false) THEN 'MEANINGFUL' ELSE 'NONE' END AS support,
      CAST(coalesce(amount >= CAST(round(o_totalprice * 100) AS BIGINT), false) AS INT) + CAST(coalesce(tax <= 4 * n, false) AS INT) AS groups, coalesce(conflict, 'NONE') AS conflict
    FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN lines ON l_orderkey = o_orderkey LEFT JOIN conflict ON k = o_orderkey)),
assessed AS (SELECT *, CASE WHEN period_ok THEN 'PASS' WHEN NOT period_ok THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS status,
    CASE WHEN failures <> '' THEN 0.0::DOUBLE WHEN s IS NOT NULL THEN round(CAST(least(0.99, (s * e + (1 - s * e) * v) * (1 - c)) AS DOUBLE), 8) END AS r FROM graded)"""


def _quality(s: SparkSession, d: str) -> DataFrame:
    """Per customer the weakest components of its orders."""
    return _assessed(s, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("s").alias("s"), F.min("e").alias("e"), F.min("v").alias("v"), F.max("c").alias("c"), F.bool_and(F.size("failures") > 0).alias("failed"))


_QUALITY = f"{_ASSESSED},\nquality AS (SELECT o_custkey AS c_custkey, min(s) AS s, min(e) AS e, min(v) AS v, max(c) AS c, bool_and(failures <> '') AS failed FROM assessed GROUP BY 1)"


def _r21(s: SparkSession, d: str) -> DataFrame:
    q = _assessed(s, d).select("o_orderkey", F.col("s").cast("double").alias("s"), F.col("e").cast("double").alias("e"), "source")
    return V.weakest_component(q, "source", "e").join(q.groupBy("source").agg(F.min("s").alias("s"), F.count("*").alias("inputs")), "source")


def _r22(s: SparkSession, d: str) -> DataFrame:
    r = V.reliability(F.col("s"), F.col("e"), F.col("v"), F.col("c"), F.col("failed"))
    return _quality(s, d).select("c_custkey", F.round(r.cast("double"), 8).alias("r"))


_R = "CASE WHEN failed THEN 0.0 ELSE least(0.99, (s * e + (1 - s * e) * v) * (1 - c)) END"


def _r23(s: SparkSession, d: str) -> DataFrame:
    j = _assessed(s, d)
    return j.select(
        "o_orderkey", "status", F.array_join("failures", ",").alias("failures"), "support", "conflict", *(F.col(c).cast("double").alias(c) for c in "sevc"), F.round(F.col("r").cast("double"), 8).alias("r"),
        "source_reason", "transformation_reason", "support_reason", "conflict_reason",
    )


_R23 = f"""WITH {_ASSESSED} SELECT o_orderkey, status, failures, support, conflict, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, CAST(v AS DOUBLE) AS v, CAST(c AS DOUBLE) AS c, r,
  CASE WHEN s IS NULL THEN 'unmapped source' ELSE 'source=' || source || ': S=' || s END AS source_reason, CASE WHEN e IS NULL THEN 'unmapped transformation' ELSE 'transformation=' || transformation || ': E=' || e END AS transformation_reason,
  CASE WHEN support = 'NONE' THEN 'no independent support' ELSE support || ' from ' || groups || ' groups: V=' || v END AS support_reason, conflict || ': C=' || c AS conflict_reason FROM assessed"""


def _q01(s: SparkSession, d: str) -> DataFrame:
    checks = {
        "VALUE_WITHOUT_EVIDENCE": F.col("o_totalprice").isNotNull() & F.col("o_orderpriority").isNull(),
        "FINAL_WITHOUT_VALUE": (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 5_000),
        "SENTINEL_TEXT": F.col("o_orderpriority") == "4-NOT SPECIFIED",
        "PERIOD_ORDER": F.col("o_orderdate") > F.lit("2001-01-01"),
    }
    return table(s, d, "orders").select("o_orderkey", V.violations(checks).alias("violations"))


_Q01 = """SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderpriority IS NULL THEN 'VALUE_WITHOUT_EVIDENCE' END, CASE WHEN o_orderstatus = 'F' AND o_totalprice < 5000 THEN 'FINAL_WITHOUT_VALUE' END,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'SENTINEL_TEXT' END, CASE WHEN o_orderdate > DATE '2001-01-01' THEN 'PERIOD_ORDER' END) AS violations FROM orders"""


def _u01(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("a"), F.array_sort(F.collect_set(F.col("l_partkey") % 50)).alias("b"))
    return li.select("l_orderkey", F.array_join(F.array_distinct(F.concat("a", "b")), ",").alias("ids"))


_U01 = """SELECT l_orderkey, string_agg(id::VARCHAR, ',' ORDER BY src, id) AS ids FROM (SELECT l_orderkey, id, min(src) AS src FROM (SELECT l_orderkey, l_suppkey AS id, 1 AS src FROM lineitem UNION ALL SELECT l_orderkey, l_partkey % 50, 2 FROM lineitem) GROUP BY 1, 2) GROUP BY 1"""


def _u02(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 10).alias("cited"), F.collect_set(F.col("l_partkey") % 10).alias("supplied"))
    return li.select("l_orderkey", (F.size(F.array_except("cited", "supplied")) == 0).alias("subset"))


_U02 = "SELECT l.l_orderkey, bool_and(s.p IS NOT NULL) AS subset FROM lineitem l LEFT JOIN (SELECT DISTINCT l_orderkey, l_partkey % 10 AS p FROM lineitem) s ON s.l_orderkey = l.l_orderkey AND s.p = l.l_suppkey % 10 GROUP BY 1"


def queries() -> dict[str, Query]:
    return {
        "R01_rule_outcomes": Query(_r01, f"WITH {_ONE} SELECT rule_id, version, result, failure_code, count(*) AS n FROM outcome GROUP BY 1, 2, 3, 4"),
        "R02_admissibility": Query(_r02, _R02),
        "R03_pagination_coverage": Query(
            lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.bool_and(F.length("text") > 0).alias("all_pages"), (F.max("turn") + 1 == F.count("*")).alias("no_gap")),
            "SELECT conv_id, bool_and(length(text) > 0) AS all_pages, max(turn) + 1 = count(*) AS no_gap FROM conversations GROUP BY 1",
        ),
        "R04_window_coverage": Query(_r04, f"SELECT o_custkey AS company, min(CAST(o_orderdate AS DATE)) <= ({AS_OF} - INTERVAL 36 MONTH)::DATE AS covered, max(CAST(o_orderdate AS DATE)) <= {AS_OF} AS within_as_of FROM orders GROUP BY 1"),
        "R05_duplicate_event": Query(
            lambda s, d: V.duplicates(table(s, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_returnflag"]),
            "SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber || l_returnflag) AS distinct_rows, count(*) = count(DISTINCT l_linenumber || l_returnflag) AS passes FROM lineitem GROUP BY 1",
        ),
        "R06_event_chronology": Query(
            lambda s, d: V.chronology(_facts_pair(s, d).select("l_suppkey", F.col("o_orderdate").alias("appointed"), F.col("l_shipdate").alias("resigned")), "l_suppkey"),
            "SELECT l_suppkey, bool_and(coalesce(o_orderdate <= l_shipdate, true)) AS in_order, count(*) FILTER (o_orderdate > l_shipdate) AS breaks FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        ),
        "R07_anchor_coverage": Query(
            lambda s, d: _facts_pair(s, d).groupBy("l_suppkey").agg(F.bool_and(F.coalesce(F.when(F.col("l_tax") > 0, F.col("l_shipdate")), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))).isNotNull()).alias("passes")),
            "SELECT l_suppkey, bool_and(l_tax > 0 OR o_orderstatus <> 'P') AS passes FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
        ),
        "R08_control_coverage": Query(_r08, "SELECT o_custkey AS company, count(DISTINCT o_orderpriority) FILTER (o_orderpriority IN ('1-URGENT', '5-LOW')) = 2 AS passes FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"),
        "R09_obligation_rules": Query(_r09, with_ctes(["obligations"], f"SELECT obligation_id, company IS NOT NULL AS identity, observed_at <= {AS_OF} AS observation, due > period AS deadline, filed IS NULL OR filed >= period AS filing_match FROM obligations")),
        "R10_financial_identity": Query(_r10, "SELECT l_suppkey % 100 AS bucket, count(*) AS facts, count(*) FILTER (o_custkey % 100 = l_suppkey % 100) AS same_company FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
        "R11_evidence_grounding": Query(_r11, "SELECT l_suppkey, count(DISTINCT l_orderkey) AS claimed, count(DISTINCT o_orderkey) AS resolved, count(DISTINCT l_orderkey) = count(DISTINCT o_orderkey) AS grounded FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1"),
        "R12_period_rule": Query(_r12, "SELECT l_orderkey, bool_and(ok) AS passes, count(*) FILTER (NOT ok) AS mismatches FROM (SELECT l_orderkey, CASE WHEN l_returnflag = 'A' THEN year(l_shipdate) = year(o_orderdate) ELSE year(l_shipdate) < year(o_orderdate) END AS ok FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1"),
        "R13_scope_rule": Query(_r13, "SELECT p_partkey, CASE p_partkey % 3 WHEN 2 THEN 'INCONCLUSIVE' WHEN 0 THEN CASE WHEN p_size % 2 = 0 THEN 'PASS' ELSE 'FAIL' END ELSE CASE WHEN p_size % 2 = 1 THEN 'PASS' ELSE 'FAIL' END END AS result FROM part"),
        "R14_currency_rule": Query(_r14, _R14),
        "R15_unit_scale_rule": Query(_r15, "SELECT p_partkey, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AND CASE WHEN p_type = 'ECONOMY' THEN p_size - 22 IN (0, 3) ELSE p_size - 22 BETWEEN -18 AND 18 END AS passes FROM part"),
        "R16_semantic_rule": Query(_r16, _R16),
        "R17_derivation_integrity": Query(_r17, _R17),
        "R18_completeness_rule": Query(_r18, "SELECT l_returnflag, count(*) AS facts, count(*) FILTER (CASE WHEN l_linenumber <= 3 THEN 'A' WHEN l_linenumber <= 5 THEN 'R' ELSE 'N' END = l_returnflag) AS proved FROM lineitem GROUP BY 1"),
        "R19_cross_check": Query(_r19, with_ctes(["statements"], _R19)),
        "R20_conflict_class": Query(_r20, _R20),
        "R21_quality_lookup": Query(_r21, f"WITH {_ASSESSED} SELECT source, CAST(min(e) AS DOUBLE) AS e, CAST(min(s) AS DOUBLE) AS s, count(*) AS inputs FROM assessed WHERE source IS NOT NULL GROUP BY 1"),
        "R22_reliability": Query(_r22, f"WITH {_QUALITY} SELECT c_custkey, CASE WHEN failed THEN 0.0::DOUBLE WHEN s IS NOT NULL THEN round(CAST({_R} AS DOUBLE), 8) END AS r FROM quality"),
        "R23_reliability_report": Query(_r23, _R23),
        "Q01_record_checks": Query(_q01, _Q01),
        "U01_ordered_union": Query(_u01, _U01),
        "U02_subset_check": Query(_u02, _U02),
    }
