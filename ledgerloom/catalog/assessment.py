"""Queries for variables, beliefs and aggregation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beliefs, variables
from ..plans import flagship, model
from ..sources import adapters
from ..sources.adapters import AS_OF, with_ctes
from ..sources.shared import bucketed, buckets, materialize, shuffled_in
from .base import Query, r6

DAY = f"DATE '{AS_OF}'"


# -- SQL of the selections and variables ------------------------------------------------------

_CURRENCY = "CASE WHEN concept = 'INVENTORY' AND CAST(value AS BIGINT) % 3 = 0 THEN 'EUR' ELSE 'GBP' END"


def _with_currency(s: SparkSession, d: str) -> DataFrame:
    """Facts with a currency: stocks whose whole amount 3 divides are in another one than the rest."""
    other = (F.col("concept") == "INVENTORY") & (F.round("value", 0).cast("long") % 3 == 0)
    return adapters.facts(s, d).withColumn("currency", F.when(other, "EUR").otherwise("GBP"))


def periods_sql(concepts: tuple[str, ...], places: int = 1, signature: str = "1") -> str:
    n = ", ".join(f"count(*) FILTER (concept = '{c}') AS n{k}, max(value) FILTER (concept = '{c}') AS v{k}" for k, c in enumerate(concepts))
    only = " AND ".join(f"n{k} = 1" for k in range(len(concepts)))
    once = f"{only} AND signs = 1"
    there = " AND ".join(f"n{k} >= 1" for k in range(len(concepts)))
    return f"""SELECT * FROM (
  SELECT *, sum(CASE WHEN {once} THEN 1 ELSE 0 END) OVER w AS place, max(CASE WHEN {there} AND NOT ({only}) THEN 1 ELSE 0 END) OVER w AS ambiguous
  FROM (SELECT company, period_end, count(DISTINCT {signature}) AS signs, {n} FROM facts WHERE concept IN ({', '.join(f"'{c}'" for c in concepts)}) GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY company ORDER BY period_end DESC)) WHERE {once} AND place <= {places}"""


def ratio_sql(code: str, mode: str = "strict") -> str:
    top, less, bottom, reason = variables.RATIOS[code]
    concepts = tuple(c for c in (top, less, bottom) if c)
    b = len(concepts) - 1
    amount = "CAST(v0 AS DOUBLE)" + (" - CAST(v1 AS DOUBLE)" if less else "")
    bad, why = (f"v{b} = 0", "ZERO_DENOMINATOR") if mode == "foundation" else (f"v{b} <= 0", reason)
    return f"""SELECT company, '{code}' AS code, CASE WHEN reason IS NULL THEN x END AS value, reason, period_end FROM (
  SELECT c_custkey AS company, period_end, ({amount}) / nullif(CAST(v{b} AS DOUBLE), 0) AS x,
         CASE WHEN period_end IS NULL THEN 'NO_COMPATIBLE_PERIOD' WHEN ambiguous = 1 THEN 'AMBIGUOUS' WHEN {bad} THEN '{why}' END AS reason
  FROM customer LEFT JOIN ({periods_sql(concepts)}) p ON c_custkey = company)"""


_TREND_SQL = f"""SELECT c_custkey AS company, 'F1.2' AS code, CASE WHEN n >= 2 AND amb = 0 AND b <> 0 THEN (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) / abs(CAST(b AS DOUBLE)) END AS value,
  CASE WHEN coalesce(n, 0) < 2 THEN 'NON_COMPARABLE_PERIODS' WHEN amb = 1 THEN 'AMBIGUOUS' WHEN b = 0 THEN 'ZERO_PREVIOUS_NET_ASSETS' END AS reason, period_end
FROM customer LEFT JOIN (SELECT company, count(*) AS n, max(ambiguous) AS amb, max(period_end) AS period_end, arg_max(v0, period_end) AS a, arg_min(v0, period_end) AS b
  FROM ({periods_sql(("NET_ASSETS",), 2)}) GROUP BY 1) ON c_custkey = company"""


def _dated_currency(s: SparkSession, d: str) -> DataFrame:
    """Facts in the currency of their time, and comparable from 1996 on."""
    f = adapters.facts(s, d)
    return f.withColumns({"currency": F.when(F.col("yr") < 2000, "ECU").otherwise("GBP"), "unit": F.lit("GBP"), "period_type": F.lit("INSTANT"), "comparability": F.when(F.col("yr") >= 1996, "COMPARABLE").otherwise("REVIEW_REQUIRED")})


_TREND_CURRENCY_SQL = f"""SELECT c_custkey AS company, 'F1.2' AS code, CASE WHEN reason IS NULL THEN (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) / abs(CAST(b AS DOUBLE)) END AS value, coalesce(reason, CASE WHEN n IS NULL THEN 'NON_COMPARABLE_PERIODS' END) AS reason, period_end
FROM customer LEFT JOIN (SELECT *, CASE WHEN n < 2 THEN 'NON_COMPARABLE_PERIODS' WHEN (newest < 2000) <> (oldest < 2000) THEN 'INCOMPATIBLE_INPUTS' WHEN b = 0 THEN 'ZERO_PREVIOUS_NET_ASSETS' END AS reason FROM (
  SELECT company, count(*) AS n, max(period_end) AS period_end, max(yr) AS newest, min(yr) AS oldest, arg_max(value, yr) AS a, arg_min(value, yr) AS b FROM (
    SELECT *, row_number() OVER (PARTITION BY company ORDER BY yr DESC) AS k FROM facts WHERE concept = 'NET_ASSETS' AND yr >= 1996 AND period_end <= {DAY}) WHERE k <= 2 GROUP BY 1)) ON c_custkey = company"""


def _late_sql(kind: str, code: str, mode: str = "strict") -> str:
    core = "CASE WHEN state IS NULL THEN 'NO_OBLIGATION' WHEN n > 1 THEN 'AMBIGUOUS' WHEN state = 'UNRESOLVED' OR due IS NULL OR (state = 'FILED' AND (filed IS NULL OR filed > DAY)) THEN 'WHY' END".replace("DAY", DAY).replace("WHY", "UNRESOLVED_OBLIGATION" if mode == "strict" else "INCOMPLETE_FILING_HISTORY")
    late = f"CAST(greatest(date_diff('day', due, CASE WHEN state = 'FILED' THEN filed ELSE {DAY} END), 0) AS DOUBLE)"
    if mode == "foundation":
        late = f"CASE WHEN due > {DAY} THEN 0.0 ELSE {late} END"
        core = f"CASE WHEN due > {DAY} AND n = 1 THEN NULL ELSE {core} END"
    return f"""SELECT company, '{code}' AS code, CASE WHEN reason IS NULL THEN late END AS value, reason FROM (
  SELECT c_custkey AS company, {late} AS late, {core} AS reason FROM customer LEFT JOIN (
    SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY company) AS n, row_number() OVER (PARTITION BY company ORDER BY obligation_id) AS k FROM (
      SELECT *, rank() OVER (PARTITION BY company ORDER BY observed_at DESC) AS rk FROM obligations WHERE kind = '{kind}' AND CAST(observed_at AS DATE) <= {DAY}) WHERE rk = 1) WHERE k = 1) o ON c_custkey = o.company)"""


_START24 = f"({DAY} - INTERVAL 24 MONTH)::DATE"
_ACTIVE = f"appointed <= {DAY} AND (resigned IS NULL OR resigned > {DAY})"
_BEFORE = f"appointed < {_START24} AND (resigned IS NULL OR resigned >= {_START24})"


def _tenure_sql(companies: str, key: str) -> str:
    return f"""SELECT {key} AS company, 'G2.2' AS code, CASE WHEN days IS NOT NULL AND NOT two THEN days / 365.2425 END AS value,
  CASE WHEN days IS NULL THEN 'EMPTY_DIRECTOR_POPULATION' WHEN two THEN 'AMBIGUOUS_DIRECTOR_IDENTITY' END AS reason
FROM {companies} LEFT JOIN (SELECT company, median(date_diff('day', a, {DAY})) AS days, bool_or(two) AS two FROM (
  SELECT company, person, min(appointed) AS a, min(appointed) <> max(appointed) AS two FROM directors WHERE {_ACTIVE} GROUP BY 1, 2) GROUP BY 1) ON {key} = company"""


_TURNOVER_SQL = f"""SELECT s_suppkey AS company, 'G2.1' AS code, CASE WHEN initial > 0 THEN CAST(gone AS DOUBLE) / initial END AS value, CASE WHEN coalesce(initial, 0) = 0 THEN 'ZERO_DIRECTOR_DENOMINATOR' END AS reason
FROM supplier LEFT JOIN (SELECT company, count(DISTINCT person) FILTER (resigned BETWEEN {_START24} AND {DAY}) AS gone, count(DISTINCT person) FILTER ({_BEFORE}) AS initial FROM directors GROUP BY 1) ON s_suppkey = company"""

_CONCENTRATION_SQL = """SELECT s_suppkey AS company, 'G2.3' AS code, share AS value, CASE WHEN share IS NULL THEN 'NO_COMPUTABLE_WINDOW' END AS reason, open AS window_start
FROM supplier LEFT JOIN (SELECT * FROM (SELECT company, open, gone / initial AS share, row_number() OVER (PARTITION BY company ORDER BY gone / initial DESC, open) AS k FROM (
  SELECT company, open, CAST(count(DISTINCT person) FILTER (resigned BETWEEN open AND open + 89) AS DOUBLE) AS gone, CAST(count(DISTINCT person) FILTER (appointed < open AND (resigned IS NULL OR resigned >= open)) AS DOUBLE) AS initial
  FROM opens JOIN directors USING (company) GROUP BY 1, 2) WHERE initial > 0) WHERE k = 1) ON s_suppkey = company"""

EXTRA = {
    "opens": (["gone_days"], f"SELECT DISTINCT company, greatest(least(x, {DAY} - 89), {_START24}) AS open FROM (SELECT company, day AS x FROM gone_days UNION ALL SELECT company, day - 89 FROM gone_days)"),
    "gone_days": (["directors"], f"SELECT DISTINCT company, person, resigned AS day FROM directors WHERE resigned BETWEEN {_START24} AND {DAY}"),
    "vals": (
        ["facts", "obligations", "directors"],
        " UNION ALL ".join(f"SELECT company, code, value, reason FROM ({q})" for q in [*(ratio_sql(c, "foundation") for c in ("F1.1", "F2.2", "F2.3")), _late_sql("ACCOUNTS", "G1.1", "foundation"), _late_sql("CONFIRMATION", "G1.2", "foundation"), _tenure_sql("customer", "c_custkey")]),
    ),
    "vars": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{d}', {float(a)}::DOUBLE, {float(b)}::DOUBLE, '{u}')" for c, d, a, b, u in model.VARIABLES) + ") t(code, domain, low_ref, high_ref, unit)"),
    "member": (
        ["vals", "vars"],
        """SELECT company, code, domain, unit, value, reason, CASE WHEN value IS NULL THEN 0 ELSE h END AS high, CASE WHEN value IS NULL THEN 0 ELSE 1 - h END AS low, CASE WHEN value IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS unknown
FROM (SELECT v.*, domain, unit, low_ref, high_ref, least(1.0, greatest(0.0, (value - low_ref) / (high_ref - low_ref))) AS h FROM vals v JOIN vars USING (code))""",
    ),
    "edges": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {w!r}::DOUBLE, {lv})" for p, c, w, lv in model.current_hierarchy()) + ") t(parent, child, weight, level)"),
    "old_edges": ([], "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {w!r}::DOUBLE, {lv})" for p, c, w, lv in model.HISTORICAL) + ") t(parent, child, weight, level)"),
}


def er_sql(source: str, node: str) -> str:
    """Analytical ER over rows (company, node, weight, low, high) of ``source``."""
    return f"""SELECT company, node, low, high, CASE WHEN abs(1 - low - high) < 1e-12 THEN 0 ELSE 1 - low - high END AS unknown FROM (
  SELECT company, node, CASE WHEN n = 1 THEN l1 ELSE (al - b) / (al + ah - b) / (1 - c / (al + ah - b)) END AS low, CASE WHEN n = 1 THEN h1 ELSE (ah - b) / (al + ah - b) / (1 - c / (al + ah - b)) END AS high
  FROM (SELECT company, {node} AS node, product(weight * low + 1 - weight * (low + high)) AS al, product(weight * high + 1 - weight * (low + high)) AS ah, product(1 - weight * (low + high)) AS b, product(1 - weight) AS c,
        count(*) AS n, max(low) AS l1, max(high) AS h1 FROM ({source}) GROUP BY 1, 2))"""


_DOMAINS = er_sql("SELECT company, parent, weight, low, high FROM member JOIN edges ON child = code", "parent")
_ALL = f"""SELECT company, node, 2 AS level, low, high, unknown FROM domains UNION ALL
SELECT company, node, 1 AS level, low, high, unknown FROM ({er_sql("SELECT company, parent, weight, low, high FROM domains JOIN edges ON child = node", "parent")})"""
EXTRA["domains"] = (["member", "edges"], _DOMAINS)
EXTRA["nodes"] = (["domains"], _ALL)

#: All eleven variables of a company: financial ones of customers; governance ones of the supplier and user with the same number.
EXTRA["vals11"] = (
    ["facts", "obligations", "directors", "opens", "controllers"],
    " UNION ALL ".join(
        f"SELECT company, code, value FROM ({q})"
        for q in [
            *(ratio_sql(c) for c in ("F1.1", "F2.2", "F2.3", "F3.1")), _TREND_SQL, _late_sql("ACCOUNTS", "G1.1"), _late_sql("CONFIRMATION", "G1.2"), _tenure_sql("customer", "c_custkey"),
            _TURNOVER_SQL.replace("supplier", "customer").replace("s_suppkey", "c_custkey"), _CONCENTRATION_SQL.replace("supplier", "customer").replace("s_suppkey", "c_custkey"),
            "SELECT c_custkey AS company, 'G3.1' AS code, CASE WHEN NOT coalesce(unclear, false) THEN CAST(coalesce(exits, 0) AS DOUBLE) END AS value FROM customer LEFT JOIN control ON c_custkey = company",
        ]
    ),
)
_CONTROL_DAY = "DATE '2024-01-25'"
EXTRA["control"] = (
    ["controllers"],
    f"""SELECT company, bool_or(unclear OR two) AS unclear, CAST(sum(exits) AS BIGINT) AS exits FROM (
  SELECT company, identity, count(DISTINCT coalesce(CAST(notified AS VARCHAR), '') || '/' || coalesce(CAST(ceased AS VARCHAR), '')) > 1 AS two, count(DISTINCT ceased) FILTER (ceased BETWEEN W AND {_CONTROL_DAY}) AS exits,
         bool_or(statement OR identity IS NULL OR notified IS NULL OR notified BETWEEN W AND {_CONTROL_DAY} OR (ceased IS NULL AND cessation <> 'NOT_APPLICABLE')) AS unclear FROM controllers GROUP BY 1, 2) GROUP BY 1""".replace("W AND", f"({_CONTROL_DAY} - INTERVAL 36 MONTH)::DATE AND"),
)
EXTRA["vals11"][0].append("control")
#: A stand-in reliability for each company: by its market segment.
EXTRA["reliability"] = ([], "SELECT c_custkey AS company, CASE c_mktsegment WHEN 'BUILDING' THEN 0.97 WHEN 'MACHINERY' THEN 0.9 WHEN 'HOUSEHOLD' THEN 0.5 ELSE 0.98 END AS r FROM customer")
EXTRA["leaf"] = (
    ["vals11", "vars", "reliability"],
    """SELECT company, code, value, CASE WHEN value IS NULL THEN 0.0 ELSE r * h END AS high, CASE WHEN value IS NULL THEN 0.0 ELSE r * (1 - h) END AS low, CASE WHEN value IS NULL THEN 1.0 ELSE 1 - r END AS unknown
FROM (SELECT v.company, code, value, CAST(r AS DOUBLE) AS r, least(1.0, greatest(0.0, (value - low_ref) / (high_ref - low_ref))) AS h FROM vals11 v JOIN vars USING (code) JOIN reliability USING (company))""",
)
EXTRA["old3"] = (["leaf", "old_edges"], er_sql("SELECT company, parent, weight, low, high FROM leaf JOIN old_edges ON child = code AND level = 3", "parent"))
EXTRA["old2"] = (["old3"], er_sql("SELECT company, parent, weight, low, high FROM old3 JOIN old_edges ON child = node AND level = 2", "parent"))
EXTRA["old1"] = (["old2"], er_sql("SELECT company, parent, weight, low, high FROM old2 JOIN old_edges ON child = node AND level = 1", "parent"))


def sql(names: list[str], body: str) -> str:
    return with_ctes(names, body, EXTRA)


# -- Spark side -------------------------------------------------------------------------------

def suppliers(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "supplier").select(F.col("s_suppkey").alias("company"))


def users(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "events").select(F.col("user_id").alias("company")).distinct()


def control_day():
    return F.lit("2024-01-25").cast("date")


def reliability(spark: SparkSession, d: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    r = F.when(seg == "BUILDING", 0.97).when(seg == "MACHINERY", 0.9).when(seg == "HOUSEHOLD", 0.5).otherwise(0.98)
    return adapters.table(spark, d, "customer").select(F.col("c_custkey").alias("company"), r.alias("r"))


def eleven_values(spark: SparkSession, d: str) -> DataFrame:
    """The eleven values, from lines that are joined with their orders twice: by order, and as directors. Both lie in buckets by company."""
    who, day = flagship.companies(spark, d), adapters.as_of()
    n = leaf_partitions(spark, d)
    people = bucketed(adapters.directors(spark, d), "company", n, "directors")
    orders = bucketed(adapters.orders_with_lines(spark, d), "company", n, "orders")
    return variables.together(
        who,
        variables.financial_part(adapters.facts(spark, d, orders), (*variables.RATIOS, variables.TREND)),
        variables.lateness_part(adapters.obligations(spark, d, orders), {"ACCOUNTS": "G1.1", "CONFIRMATION": "G1.2"}, day),
        variables.turnover_part(people, day), variables.tenure_part(people, day), variables.concentration_part(people, day),
        variables.control_part(adapters.controllers(spark, d), control_day()),
    ).select("company", "code", "value")


def leaf_partitions(spark: SparkSession, d: str) -> int:
    return buckets(spark, adapters.table(spark, d, "lineitem").count())


def discounted_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Written once, in a number of partitions that grows with the lines, so that no task's sorts and aggregates do."""
    with shuffled_in(spark, leaf_partitions(spark, d)):
        values = eleven_values(spark, d).join(reliability(spark, d), "company")
        return materialize(beliefs.leaves(flagship.companies(spark, d), values, model.variables(spark, "1")), "leaves")


def _value_query(frame, extra: tuple[str, ...] = ()):
    return lambda s, d: frame(s, d).select("company", "code", r6("value"), "reason", *extra)


def _ratio(code: str, mode: str = "strict"):
    return _value_query(lambda s, d: variables.ratio(flagship.companies(s, d), adapters.facts(s, d), code, mode), ("period_end",))


_R = "SELECT company, code, round(value, 6) AS value, reason"
_B = "round(low, 6) AS low, round(high, 6) AS high, round(unknown, 6) AS unknown"


def _beliefs(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, r6("low"), r6("high"), r6("unknown"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    for name, code in (("V01_equity_ratio", "F1.1"), ("V03_current_ratio", "F2.2"), ("V04_quick_ratio", "F2.3"), ("V05_debt_ratio", "F3.1")):
        q[name] = Query(_ratio(code), sql(["facts"], f"{_R}, period_end FROM ({ratio_sql(code)})"))
    q["V02_net_asset_trend"] = Query(_value_query(lambda s, d: variables.net_asset_trend(flagship.companies(s, d), _dated_currency(s, d), adapters.as_of()), ("period_end",)), sql(["facts"], f"{_R}, period_end FROM ({_TREND_CURRENCY_SQL})"))
    for name, kind, code in (("V06_accounts_lateness", "ACCOUNTS", "G1.1"), ("V07_confirmation_lateness", "CONFIRMATION", "G1.2")):
        q[name] = Query(_value_query(lambda s, d, kind=kind, code=code: variables.lateness(flagship.companies(s, d), adapters.obligations(s, d), kind, code, adapters.as_of())), sql(["obligations"], f"{_R} FROM ({_late_sql(kind, code)})"))
    q["V08_director_turnover"] = Query(_value_query(lambda s, d: variables.turnover(suppliers(s, d), adapters.directors(s, d), adapters.as_of())), sql(["directors"], f"{_R} FROM ({_TURNOVER_SQL})"))
    q["V09_median_tenure"] = Query(_value_query(lambda s, d: variables.median_tenure(suppliers(s, d), adapters.directors(s, d), adapters.as_of())), sql(["directors"], f"{_R} FROM ({_tenure_sql('supplier', 's_suppkey')})"))
    q["V10_change_concentration"] = Query(_value_query(lambda s, d: variables.change_concentration(suppliers(s, d), adapters.directors(s, d), adapters.as_of()), ("window_start",)), sql(["opens", "directors"], f"{_R}, window_start FROM ({_CONCENTRATION_SQL})"))
    q["V11_control_changes"] = Query(
        _value_query(lambda s, d: variables.control_changes(users(s, d), adapters.controllers(s, d), control_day())),
        sql(["control"], "SELECT company, 'G3.1' AS code, CASE WHEN NOT unclear THEN CAST(exits AS DOUBLE) END AS value, CASE WHEN unclear THEN 'AMBIGUOUS' END AS reason FROM control"),
    )
    q["V12_active_at"] = Query(
        lambda s, d: adapters.directors(s, d).groupBy("company").agg(F.count_if(variables.active_at(adapters.as_of())).alias("active"), F.count_if(variables.active_at(F.lit("1998-12-31").cast("date"), True)).alias("just_before")),
        sql(["directors"], f"SELECT company, count(*) FILTER ({_ACTIVE}) AS active, count(*) FILTER (appointed < DATE '1998-12-31' AND (resigned IS NULL OR resigned >= DATE '1998-12-31')) AS just_before FROM directors GROUP BY 1"),
    )
    q["V13_role_gate"] = Query(
        lambda s, d: variables.role_gate(_members(s, d), ("secretary",), ("director", "member")),
        "SELECT company, count(*) AS members, arg_min(failure, subject) FILTER (failure IS NOT NULL) AS reason FROM (SELECT l_suppkey AS company, l_orderkey * 10 + l_linenumber AS subject, "
        "CASE WHEN l_returnflag = 'N' AND l_tax > 0.06 THEN 'UNKNOWN_ROLE' WHEN l_partkey % 50 = 7 THEN 'MISSING_IDENTITY' WHEN l_quantity > 49 THEN 'MISSING_APPOINTMENT' END AS failure FROM lineitem WHERE NOT (l_returnflag = 'R')) GROUP BY 1",
    )
    q["V14_population_gate"] = Query(_population_gate, _POPULATION_SQL)
    q["V15_foundation_values"] = Query(lambda s, d: flagship.foundation_values(s, d).select("company", "code", r6("value"), "reason"), sql(["vals"], f"{_R} FROM vals"))

    q["B01_anchored_belief"] = Query(lambda s, d: flagship.reference_beliefs(s, d).filter("value is not null").select("company", "code", r6("high"), r6("low")), sql(["member"], "SELECT company, code, round(high, 6) AS high, round(low, 6) AS low FROM member WHERE value IS NOT NULL"))
    q["B02_discounted_leaves"] = Query(lambda s, d: _beliefs(discounted_leaves(s, d), "company", "code"), sql(["leaf"], f"SELECT company, code, {_B} FROM leaf"))
    q["B03_reference_membership"] = Query(lambda s, d: _beliefs(flagship.reference_beliefs(s, d), "company", "code"), sql(["member"], f"SELECT company, code, {_B} FROM member"))
    q["B04_belief_sum_check"] = Query(
        lambda s, d: _sum_check(flagship.overall(s, d)),
        sql(["nodes"], "SELECT node, count(*) AS beliefs, count(*) FILTER (abs(low + high + unknown - 1) > 1e-8) AS violations FROM nodes GROUP BY 1"),
    )
    q["B05_versioned_variables"] = Query(_by_version, sql(["vars", "leaf"], " UNION ALL ".join(f"SELECT '{v}' AS model_version, code, count(value) AS known, count(*) AS companies FROM leaf WHERE code IN ({', '.join(repr(c) for c in m)}) GROUP BY code" for v, m in model.MEMBERS.items())))
    q["B06_value_beside_discounted"] = Query(
        lambda s, d: discounted_leaves(s, d).filter("value is not null").select("company", "code", r6("high"), r6("value_high", beliefs.anchored_high(F.col("value"), F.col("low_ref"), F.col("high_ref")))),
        sql(["leaf", "vars"], "SELECT company, code, round(high, 6) AS high, round(least(1.0, greatest(0.0, (value - low_ref) / (high_ref - low_ref))), 6) AS value_high FROM leaf JOIN vars USING (code) WHERE value IS NOT NULL"),
    )
    q["B07_leaf_audit"] = Query(
        _leaf_audit,
        sql(["leaf", "vars", "reliability"], f"""SELECT code, count(*) AS leaves, count(*) FILTER (same) AS reproduced, count(*) FILTER (NOT same) AS differs FROM (
          SELECT code, value IS NULL OR abs(r - CASE WHEN c_mktsegment = 'MACHINERY' THEN 0.95 ELSE r END) <= {beliefs.TOLERANCE} AS same FROM leaf JOIN reliability USING (company) JOIN customer ON c_custkey = company) GROUP BY 1"""),
    )
    q["A01_er_combine"] = Query(
        lambda s, d: _beliefs(beliefs.combine(flagship.reference_beliefs(s, d).join(F.broadcast(model.hierarchy(s)), F.col("code") == F.col("child")).withColumnRenamed("parent", "node"), ["company", "node"]), "company", "node"),
        sql(["domains"], f"SELECT company, node, {_B} FROM domains"),
    )
    q["A02_hierarchical_er"] = Query(lambda s, d: _beliefs(flagship.overall(s, d), "company", "node", F.col("level").cast("long").alias("level")), sql(["nodes"], f"SELECT company, node, CAST(level AS BIGINT) AS level, {_B} FROM nodes"))
    q["A03_historical_hierarchy"] = Query(
        lambda s, d: _beliefs(beliefs.aggregate_tree(discounted_leaves(s, d), model.hierarchy(s, model.HISTORICAL), 3), "company", "node"),
        sql(["old1"], f"SELECT company, node, {_B} FROM old3 UNION ALL SELECT company, node, {_B} FROM old2 UNION ALL SELECT company, node, {_B} FROM old1"),
    )
    q["A04_leaf_reliability"] = Query(
        lambda s, d: adapters.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("leaf")).agg(F.min(F.when(F.col("l_returnflag") != "N", 1 - F.col("l_discount"))).alias("x"), F.count_if(F.col("l_returnflag") != "N").alias("mandatory")).select("leaf", r6("r", "x"), "mandatory"),
        "SELECT l_orderkey AS leaf, round(min(1 - l_discount) FILTER (l_returnflag <> 'N'), 6) AS r, count(*) FILTER (l_returnflag <> 'N') AS mandatory FROM lineitem GROUP BY 1",
    )
    q["W01_latest_observation"] = Query(
        lambda s, d: variables.latest_observation(adapters.obligations(s, d), ["company", "kind"]).select("company", "kind", "obligation_id", "state", "ambiguous"),
        sql(["obligations"], "SELECT company, kind, obligation_id, state, n > 1 AS ambiguous FROM (SELECT *, count(*) OVER (PARTITION BY company, kind) AS n, row_number() OVER (PARTITION BY company, kind ORDER BY obligation_id) AS k FROM (SELECT *, rank() OVER (PARTITION BY company, kind ORDER BY observed_at DESC) AS rk FROM obligations) WHERE rk = 1) WHERE k = 1"),
    )
    c3 = ("CURRENT_ASSETS", "INVENTORY", "CURRENT_LIABILITIES")
    q["W02_latest_compatible_period"] = Query(
        lambda s, d: variables.latest_compatible(_with_currency(s, d), c3).select("company", "period_end", *(F.col(c).cast("double").alias(c.lower()) for c in c3), "ambiguous"),
        sql(["facts"], f"SELECT company, period_end, CAST(v0 AS DOUBLE) AS current_assets, CAST(v1 AS DOUBLE) AS inventory, CAST(v2 AS DOUBLE) AS current_liabilities, ambiguous = 1 AS ambiguous FROM ({periods_sql(c3, signature=_CURRENCY)})"),
    )
    q["W03_previous_period"] = Query(_previous, sql(["statements"], "SELECT company, yr, CAST(na AS DOUBLE) AS na, CAST(lag(ta) OVER (PARTITION BY company ORDER BY yr) AS DOUBLE) AS previous_ta FROM statements"))
    q["W04_closest_year"] = Query(
        lambda s, d: variables.closest(adapters.statements(s, d).select("company", "yr"), ["company"], F.col("yr"), 1998).select("company", "yr"),
        sql(["statements"], "SELECT company, yr FROM (SELECT company, yr, row_number() OVER (PARTITION BY company ORDER BY abs(yr - 1998), -yr) AS k FROM statements) WHERE k = 1"),
    )
    q["W05_statement_period"] = Query(
        lambda s, d: variables.closest(_filings(s, d), ["company"], F.year("made_up"), 1998, then=[F.col("made_up").desc(), F.col("o_orderkey")]).select("company", "made_up"),
        "SELECT company, made_up FROM (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS made_up, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(year(o_orderdate) - 1998), -year(o_orderdate), o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k = 1",
    )
    q["W06_filing_choice"] = Query(
        lambda s, d: variables.closest(_filings(s, d), ["company"], F.when(F.col("o_orderstatus") != "P", F.year("made_up")), 1998, n=3, then=[F.col("made_up").desc(), F.col("o_orderkey")]).select("company", "o_orderkey", F.col("choice").cast("long").alias("choice")),
        "SELECT company, o_orderkey, choice FROM (SELECT o_custkey AS company, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY coalesce(abs(y - 1998), 10000), coalesce(-y, 0), CAST(o_orderdate AS DATE) DESC, o_orderkey) AS choice FROM (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS y FROM orders)) WHERE choice <= 3",
    )
    q["W07_newest_first_proof"] = Query(
        lambda s, d: variables.not_newest_first(adapters.table(s, d, "orders"), ["o_custkey"], "o_orderkey", "o_orderdate").select(F.col("o_custkey").alias("company"), "breaks", (F.col("breaks") == 0).alias("proved")),
        "SELECT company, CAST(sum(wrong) AS BIGINT) AS breaks, sum(wrong) = 0 AS proved FROM (SELECT o_custkey AS company, CASE WHEN o_orderdate > lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 1 ELSE 0 END AS wrong FROM orders) GROUP BY 1",
    )
    q["W11_cumulative_angle"] = Query(_angles, sql(["nodes"], "SELECT company, part, round(360 * (running - share), 4) AS start_angle, round(360 * running, 4) AS end_angle FROM (SELECT company, part, share, sum(share) OVER (PARTITION BY company ORDER BY k ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT company, unnest(['High', 'Low', 'Unknown']) AS part, unnest([high, low, unknown]) AS share, unnest([1, 2, 3]) AS k FROM nodes WHERE node = 'OVERALL'))"))
    q["S09_model_config"] = Query(_config_use, sql(["edges", "leaf"], "SELECT parent, child, round(weight, 6) AS weight, (SELECT count(*) FROM leaf WHERE code = child AND value IS NOT NULL) AS known FROM edges WHERE level = 2"))
    q["U03_partition_check"] = Query(_partition_check, sql(["leaf"], "SELECT code, count(*) AS leaves, code IN ('G2.1', 'G2.3', 'G3.1', 'F1.2', 'F3.1') AS outside_model FROM leaf GROUP BY 1"))
    return q


def _members(s: SparkSession, d: str) -> DataFrame:
    t = adapters.table(s, d, "lineitem")
    role = F.when(F.col("l_returnflag") == "R", "secretary").when((F.col("l_returnflag") == "N") & (F.col("l_tax") > 0.06), "observer").otherwise("director")
    return t.select(F.col("l_suppkey").alias("company"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("subject"), role.alias("role"), F.when(F.col("l_partkey") % 50 != 7, F.col("l_partkey")).alias("person"), F.when(F.col("l_quantity") <= 49, F.col("l_shipdate")).alias("appointed"))


def population_gate(members: DataFrame, start, end) -> DataFrame:
    """Per company whether its population can be used, or why not: window not covered, not admissible, not available."""
    n = members.groupBy("company").agg(F.min("covered_from").alias("a"), F.max("covered_to").alias("b"), F.bool_and("admissible").alias("ok"), F.bool_and(F.col("availability") == "AVAILABLE").alias("there"))
    return n.select("company", F.when((F.col("a") > start) | (F.col("b") < end), "WINDOW_NOT_COVERED").when(~F.col("ok"), "NOT_ADMISSIBLE").when(~F.col("there"), "NOT_AVAILABLE").alias("reason"))


def _population_gate(s: SparkSession, d: str) -> DataFrame:
    o = adapters.table(s, d, "orders")
    m = o.select(F.col("o_custkey").alias("company"), F.col("o_orderdate").cast("date").alias("covered_from"), F.col("o_orderdate").cast("date").alias("covered_to"), (F.col("o_totalprice") > 5000).alias("admissible"), F.when(F.col("o_orderpriority") == "5-LOW", "NOT_DISCLOSED").otherwise("AVAILABLE").alias("availability"))
    return population_gate(m, F.lit("1997-06-30").cast("date"), F.lit("1999-06-30").cast("date"))


_POPULATION_SQL = """SELECT o_custkey AS company, CASE WHEN min(CAST(o_orderdate AS DATE)) > DATE '1997-06-30' OR max(CAST(o_orderdate AS DATE)) < DATE '1999-06-30' THEN 'WINDOW_NOT_COVERED'
  WHEN NOT bool_and(o_totalprice > 5000) THEN 'NOT_ADMISSIBLE' WHEN NOT bool_and(o_orderpriority <> '5-LOW') THEN 'NOT_AVAILABLE' END AS reason FROM orders GROUP BY 1"""


def _sum_check(nodes: DataFrame) -> DataFrame:
    bad = beliefs.belief_violations(nodes).groupBy("node").agg(F.count("*").alias("violations"))
    return nodes.groupBy("node").agg(F.count("*").alias("beliefs")).join(bad, "node", "left").select("node", "beliefs", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def _by_version(s: SparkSession, d: str) -> DataFrame:
    members = model.variables(s, "1")
    for v in ("1.1", "1.2"):
        members = members.unionByName(model.variables(s, v))
    return discounted_leaves(s, d).join(F.broadcast(members.select("model_version", "code")), "code").groupBy("model_version", "code").agg(F.count("value").alias("known"), F.count("*").alias("companies"))


def _leaf_audit(s: SparkSession, d: str) -> DataFrame:
    """The leaves of the whole model, stored with their inputs; the reliability of one segment's companies was revised since."""
    segment = adapters.table(s, d, "customer").select(F.col("c_custkey").alias("company"), "c_mktsegment")
    stored = materialize(discounted_leaves(s, d).join(segment, "company"), "leaves").withColumn("r", F.when(F.col("c_mktsegment") == "MACHINERY", 0.95).otherwise(F.col("r")))
    told = beliefs.reproduced(stored.select("company", "code", "value", "r", "low", "high", "unknown"), model.variables(s, "1"))
    return told.groupBy("code").agg(F.count("*").alias("leaves"), F.count_if("same").alias("reproduced"), F.count_if(~F.col("same")).alias("differs"))


def _previous(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("company").orderBy("yr")
    return adapters.statements(s, d).select("company", "yr", F.col("na").cast("double").alias("na"), F.lag("ta").over(w).cast("double").alias("previous_ta"))


def _filings(s: SparkSession, d: str) -> DataFrame:
    return adapters.table(s, d, "orders").select(F.col("o_custkey").alias("company"), "o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("made_up"))


def _angles(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    parts = F.array(*(F.struct(F.lit(n).alias("part"), F.col(c).alias("share"), F.lit(k).alias("k")) for k, (n, c) in enumerate((("High", "high"), ("Low", "low"), ("Unknown", "unknown")))))
    long = flagship.overall(s, d).filter("node = 'OVERALL'").select("company", F.inline(parts))
    running = F.sum("share").over(Window.partitionBy("company").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return long.select("company", "part", F.round(360 * (running - F.col("share")), 4).alias("start_angle"), F.round(360 * running, 4).alias("end_angle"))


def _config_use(s: SparkSession, d: str) -> DataFrame:
    known = discounted_leaves(s, d).groupBy("code").agg(F.count("value").alias("known"))
    return model.hierarchy(s).filter("level = 2").join(known, F.col("child") == F.col("code")).select("parent", "child", r6("weight"), "known")


def _partition_check(s: SparkSession, d: str) -> DataFrame:
    codes = discounted_leaves(s, d).groupBy("code").agg(F.count("*").alias("leaves"))
    outside = model.variables(s, "1").select("code").exceptAll(model.hierarchy(s).filter("level = 2").select("child")).withColumn("outside_model", F.lit(True))
    return codes.join(F.broadcast(outside), "code", "left").select("code", "leaves", F.coalesce("outside_model", F.lit(False)).alias("outside_model"))
