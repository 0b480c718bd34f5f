"""Queries for the column functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.adapters import table
from .base import Query


def _orders(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").withColumn("whole", F.floor("l_extendedprice").cast("long"))


def _p01(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, F.concat(F.lit("  "), k.cast("string"), F.lit(" "))).when(k % 5 == 1, F.concat(F.lit("sc"), F.lpad(k.cast("string"), 6, "0"))).when(k % 5 == 2, F.col("c_name")).when(k % 5 == 3, k.cast("string")).otherwise(F.lit(None))
    return table(s, d, "customer").select("c_custkey", S.company_number(raw).alias("company_number"))


def _p02(s: SparkSession, d: str) -> DataFrame:
    """Wide registry items to typed observations, by an allow-list of (path, kind)."""
    o = _orders(s, d)
    item = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.col("day").cast("string").alias("made_on")).alias("filing"), F.col("o_totalprice").alias("total"), (F.col("o_orderstatus") == "F").alias("final"), F.lit("x").alias("unlisted")))
    return observations(o.select(F.col("o_orderkey").alias("subject"), item.alias("item")), (("filing.status", "TEXT"), ("filing.made_on", "DATE"), ("total", "NUMERIC"), ("final", "BOOLEAN"), ("ceased_on", "DATE"))).select("subject", "path", "kind", F.col("v_num").cast("double").alias("v_num"), "v_date", "v_text", "v_bool", "availability")


def observations(items: DataFrame, spec: tuple[tuple[str, str], ...]) -> DataFrame:
    """``subject, path, kind``, one typed value column and the availability, for each item and listed path."""
    rows = F.array(*(F.struct(F.lit(p).alias("path"), F.lit(k).alias("kind"), F.get_json_object("item", f"$.{p}").alias("raw")) for p, k in spec))
    long = items.select("subject", F.inline(rows))
    of = lambda k, c: F.when(F.col("kind") == k, c)
    return long.select(
        "subject", "path", "kind",
        of("NUMERIC", F.col("raw").try_cast("decimal(20,4)")).alias("v_num"), of("DATE", S.strict_date(F.col("raw"))).alias("v_date"), of("TEXT", F.col("raw")).alias("v_text"), of("BOOLEAN", F.col("raw").try_cast("boolean")).alias("v_bool"),
        S.availability(F.col("path"), F.col("raw").isNotNull(), F.lit(False), F.lit("")).alias("availability"),
    )


_P02 = "SELECT o_orderkey AS subject, path, kind, CASE WHEN path = 'total' THEN o_totalprice END AS v_num, CASE WHEN path = 'filing.made_on' THEN CAST(o_orderdate AS DATE) END AS v_date, CASE WHEN path = 'filing.status' THEN o_orderstatus END AS v_text, CASE WHEN path = 'final' THEN o_orderstatus = 'F' END AS v_bool, CASE WHEN path = 'ceased_on' THEN 'NOT_APPLICABLE' ELSE 'AVAILABLE' END AS availability FROM orders, (VALUES ('filing.status', 'TEXT'), ('filing.made_on', 'DATE'), ('total', 'NUMERIC'), ('final', 'BOOLEAN'), ('ceased_on', 'DATE')) t(path, kind)"


def _p03(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    path = F.element_at(F.array(*map(F.lit, ("resigned_on", "ceased_on", "identification", "name"))), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", S.availability(path, F.col("value") > 50, F.col("event_type") == "error", F.when(F.col("event_type") == "click", "individual").otherwise("corporate")).alias("availability"))


_P03 = "SELECT event_id, CASE WHEN value > 50 THEN 'AVAILABLE' WHEN event_id % 4 < 2 AND event_type = 'error' THEN 'NOT_DISCLOSED' WHEN event_id % 4 < 2 THEN 'NOT_APPLICABLE' WHEN event_id % 4 = 2 AND event_type = 'click' THEN 'NOT_APPLICABLE' ELSE 'NOT_DISCLOSED' END AS availability FROM events"


def _p04(s: SparkSession, d: str) -> DataFrame:
    li = _lines(s, d)
    k = F.col("l_linenumber")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", S.subject_identity(F.when(k % 3 == 0, F.concat(F.lit("r"), F.col("l_partkey").cast("string"))), F.when(k % 3 == 1, F.concat(F.lit("/o/"), F.col("l_orderkey").cast("string"))), F.col("l_suppkey"), F.col("l_returnflag"), F.when(k != 5, F.col("l_shipdate").cast("date"))).alias("subject"))


_P04 = "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 = 0 THEN 'r' || l_partkey WHEN l_linenumber % 3 = 1 THEN '/o/' || l_orderkey WHEN l_linenumber <> 5 THEN sha256(CAST(to_json([CAST(l_suppkey AS VARCHAR), l_returnflag, CAST(CAST(l_shipdate AS DATE) AS VARCHAR)]) AS VARCHAR)) END AS subject FROM lineitem"


def _dates(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey"), F.col("o_orderdate")
    return _orders(s, d).withColumn("shown", F.when(k % 4 == 0, F.date_format(t, "yyyy-MM-dd")).when(k % 4 == 1, F.date_format(t, "yyyy-M-d")).when(k % 4 == 2, F.date_format(t, "dd/MM/yyyy")).otherwise(F.concat(F.date_format(t, "yyyy-MM"), F.lit("-31"))))


_P05 = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 4 = 1 AND month(o_orderdate) > 9 AND day(o_orderdate) > 9 THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 4 = 3 AND month(o_orderdate) IN (1, 3, 5, 7, 8, 10, 12) THEN make_date(year(o_orderdate), month(o_orderdate), 31) END AS day FROM orders"


def _p07(s: SparkSession, d: str) -> DataFrame:
    k, n = F.col("l_orderkey") % 7, F.format_number("whole", 0)
    raw = F.when(k == 0, F.concat(F.lit("£"), n)).when(k == 1, F.concat(F.lit("("), n, F.lit(")"))).when(k == 2, F.concat(F.lit("GBP "), F.col("whole").cast("string"), F.lit(" "))).when(k == 3, F.lit("-")).when(k == 4, F.concat(F.lit("USD "), n)).when(k == 5, F.concat(F.lit("−"), n)).otherwise(F.concat(n, F.lit("x")))
    unit = F.element_at(F.array(*map(F.lit, ("GBP units", "£'000s", "GBP millions", "bushels"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    a = S.printed_amount(raw, unit)
    return _lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", a["value"].cast("double").alias("value"), a["reason"].alias("reason"))


_P07 = """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k IN (0, 1, 2, 5) AND u <> 3 THEN CAST(w * CASE WHEN k IN (1, 5) THEN -1 ELSE 1 END * CASE u WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 1000000 END AS DOUBLE) END AS value,
  CASE WHEN k = 4 THEN 'FOREIGN_CURRENCY' WHEN k = 3 THEN 'NO_AMOUNT' WHEN u = 3 THEN 'UNKNOWN_UNIT' WHEN k = 6 THEN 'NOT_A_NUMBER' END AS reason
FROM (SELECT *, l_orderkey % 7 AS k, l_linenumber % 4 AS u, CAST(floor(l_extendedprice) AS BIGINT) AS w FROM lineitem)"""


def _p08(s: SparkSession, d: str) -> DataFrame:
    """Tokens of several spellings at every scale from -19 to 18; the value in full, as text."""
    k = F.col("l_orderkey") % 5
    token = F.when(k == 0, F.format_number("whole", 0)).when(k == 1, F.col("whole").cast("string")).when(k == 2, F.lit("-")).when(k == 3, F.concat(F.lit("1,2"), F.col("whole").cast("string"))).otherwise(F.concat(F.col("whole").cast("string"), F.lit(".5")))
    scale = (F.pmod(F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(38)) - 19).cast("int")
    v = S.tagged_amount(token, scale, F.when(F.col("l_returnflag") == "R", "-").otherwise(""), F.col("l_partkey") % 2 == 0)
    return _lines(s, d).select("l_orderkey", "l_linenumber", "l_partkey", F.regexp_replace(v["value"].cast("string"), r"^0E-18$", "0.000000000000000000").alias("value"), v["reason"].alias("reason"))


# digits d with f of them after the point are moved by e = scale - f places
_P08 = """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, (l_partkey * 7 + l_linenumber) % 38 - 19 AS scale, CASE WHEN k IN (0, 1) THEN w::VARCHAR WHEN k = 2 AND l_partkey % 2 = 0 THEN '0' WHEN k = 3 AND w BETWEEN 10 AND 99 THEN '12' || w WHEN k = 4 THEN w || '5' END AS d, CASE k WHEN 4 THEN 1 ELSE 0 END AS f
  FROM (SELECT *, l_orderkey % 5 AS k, CAST(floor(l_extendedprice) AS BIGINT) AS w FROM lineitem)),
m AS (SELECT *, scale - f AS e, CASE WHEN scale >= f THEN d || repeat('0', CAST(scale - f AS BIGINT)) ELSE lpad(d, CAST(greatest(length(d), f - scale + 1) AS INTEGER), '0') END AS p FROM t),
n AS (SELECT *, ltrim(CASE WHEN e >= 0 THEN p ELSE left(p, CAST(length(p) + e AS BIGINT)) END, '0') AS a, rtrim(CASE WHEN e >= 0 THEN '' ELSE right(p, CAST(-e AS BIGINT)) END, '0') AS b FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN reason IS NULL THEN CASE WHEN l_returnflag = 'R' AND a || b <> '' THEN '-' ELSE '' END || CASE WHEN a = '' THEN '0' ELSE a END || '.' || rpad(b, 18, '0') END AS value, reason
FROM (SELECT *, CASE WHEN d IS NULL THEN 'NOT_A_NUMBER' WHEN scale NOT BETWEEN -18 AND 18 THEN 'UNSUPPORTED_SCALE' WHEN length(a) > 20 OR length(b) > 18 THEN 'OUT_OF_RANGE' END AS reason FROM n)"""


def _p09(s: SparkSession, d: str) -> DataFrame:
    k, t = F.col("o_orderkey") % 4, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.concat(F.lit("Year ended "), F.date_format(t, "yyyy"))).when(k == 2, F.concat(F.lit("At 31 March "), F.lit("1998"))).otherwise(F.lit("not stated"))
    return _orders(s, d).select("o_orderkey", S.displayed_period(shown, F.col("day")).alias("period"))


_P09 = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderdate AS DATE) WHEN 1 THEN CAST(o_orderdate AS DATE) WHEN 2 THEN CASE WHEN year(o_orderdate) = 1998 THEN CAST(o_orderdate AS DATE) ELSE DATE '1998-12-31' END END AS period FROM orders"


def _normal(s: SparkSession, d: str) -> DataFrame:
    c = F.col("c_acctbal").cast("decimal(20,4)")
    k = F.col("c_custkey") % 4
    concept = F.when(k == 0, "CURRENT_LIABILITIES").when(k == 1, "NET_ASSETS").when(k == 2, "TOTAL_ASSETS").otherwise("NON_CURRENT_LIABILITIES")
    label = F.when(F.col("c_nationkey") % 2 == 0, "Net liabilities").otherwise("Net assets")
    printed = F.when(c < 0, F.concat(F.lit("("), (-c).cast("string"), F.lit(")"))).otherwise(c.cast("string"))
    df = table(s, d, "customer").select("c_custkey", concept.alias("concept"), label.alias("label"), printed.alias("printed"), c.alias("value"))
    return df.withColumn("normal", S.normalized_amount(F.col("concept"), F.col("label"), F.col("printed"), F.col("value")))


_NORMAL = """(SELECT c_custkey, concept, value, CASE WHEN concept LIKE '%LIABILITIES' AND value < 0 THEN abs(value) WHEN concept = 'NET_ASSETS' AND c_nationkey % 2 = 0 THEN -abs(value) ELSE value END AS normal
FROM (SELECT c_custkey, c_nationkey, CASE c_custkey % 4 WHEN 0 THEN 'CURRENT_LIABILITIES' WHEN 1 THEN 'NET_ASSETS' WHEN 2 THEN 'TOTAL_ASSETS' ELSE 'NON_CURRENT_LIABILITIES' END AS concept, CAST(c_acctbal AS DECIMAL(20,4)) AS value FROM customer))"""


def _p13(s: SparkSession, d: str) -> DataFrame:
    texts = ("Consolidated balance sheet", "Company balance sheet\n", "Balance sheet", "Group and company statement", "Company\nGroup", "Group statement")
    return table(s, d, "part").select("p_partkey", S.scope_of_heading(F.element_at(F.array(*map(F.lit, texts)), (F.col("p_partkey") % 6 + 1).cast("int"))).alias("scope"))


def _p14(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    k = F.col("event_type")
    packed = e.select("event_id", k.alias("fact_type"), F.when(k == "click", F.col("value").cast("string")).when(k == "error", F.to_date("ts").cast("string")).when(k == "view", F.col("props")).when(k == "signup", (F.col("value") > 50).cast("string")).otherwise(F.concat(F.lit("a,"), F.col("user_id").cast("string"))).alias("raw"))
    return packed.select(
        "event_id",
        F.when(F.col("fact_type") == "click", F.col("raw").try_cast("double")).alias("v_num"),
        F.when(F.col("fact_type") == "error", S.strict_date(F.col("raw"))).alias("v_date"),
        F.when(F.col("fact_type") == "view", F.col("raw")).alias("v_text"),
        F.when(F.col("fact_type") == "signup", F.col("raw").try_cast("boolean")).alias("v_bool"),
        F.when(F.col("fact_type") == "purchase", F.size(F.split("raw", ","))).cast("long").alias("n_codes"),
    )


_P14 = "SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS v_num, CASE WHEN event_type = 'error' THEN CAST(ts AS DATE) END AS v_date, CASE WHEN event_type = 'view' THEN props END AS v_text, CASE WHEN event_type = 'signup' THEN value > 50 END AS v_bool, CASE WHEN event_type = 'purchase' THEN CAST(2 AS BIGINT) END AS n_codes FROM events"


def _p15(s: SparkSession, d: str) -> DataFrame:
    """Ids of parts that hold separators, quotes, nothing or null; rows whose parts read alike when joined must not meet."""
    k = F.col("o_orderkey") % 4
    bar = F.concat(F.col("o_orderstatus"), F.lit("|"), F.col("o_orderpriority"))
    first = F.when(k == 0, bar).when(k == 1, F.col("o_orderstatus")).when(k == 2, F.lit("")).otherwise(F.lit(None))
    second = F.when(k == 0, F.col("day").cast("string")).when(k == 1, F.concat(F.col("o_orderpriority"), F.lit("|"), F.col("day").cast("string"))).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('",')))
    return _orders(s, d).select("o_orderkey", S.identity(F.col("o_custkey"), first, second).alias("id"))


_P15 = """SELECT o_orderkey, sha256(CAST(to_json([CAST(o_custkey AS VARCHAR), CASE k WHEN 0 THEN o_orderstatus || '|' || o_orderpriority WHEN 1 THEN o_orderstatus WHEN 2 THEN '' END,
  CASE k WHEN 0 THEN day WHEN 1 THEN o_orderpriority || '|' || day ELSE '"' || o_orderpriority || '",' END]) AS VARCHAR)) AS id FROM (SELECT *, o_orderkey % 4 AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders)"""


def _p16(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    js = F.when(k == 0, F.concat(F.lit('{"made_up_date": "'), F.col("day").cast("string"), F.lit('"}'))).when(k == 1, F.lit('{"other": 1}')).otherwise(F.lit("not json"))
    return _orders(s, d).select("o_orderkey", S.strict_date(F.get_json_object(js, "$.made_up_date")).alias("made_up"))


def _p17(s: SparkSession, d: str) -> DataFrame:
    """JSON objects with a repeated key, or with numbers that are not finite, are refused."""
    k = F.col("event_id") % 3
    v = F.col("value").cast("string")
    js = F.when(k == 0, F.concat(F.lit('{"a": '), v, F.lit("}"))).when(k == 1, F.concat(F.lit('{"a": '), v, F.lit(', "a": 1}'))).otherwise(F.lit('{"a": NaN}'))
    return table(s, d, "events").select("event_id", F.try_parse_json(js).isNotNull().alias("accepted"))


def queries() -> dict[str, Query]:
    return {
        "P01_company_number": Query(_p01, "SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN lpad(c_custkey::VARCHAR, 8, '0') WHEN 1 THEN CASE WHEN c_custkey < 1000000 THEN 'SC' || lpad(c_custkey::VARCHAR, 6, '0') END WHEN 3 THEN lpad(c_custkey::VARCHAR, 8, '0') END AS company_number FROM customer"),
        "P02_observations": Query(_p02, _P02),
        "P03_availability": Query(_p03, _P03),
        "P04_subject_identity": Query(_p04, _P04),
        "P05_strict_date": Query(lambda s, d: _dates(s, d).select("o_orderkey", S.strict_date(F.col("shown")).alias("day")), _P05),
        "P06_months_before": Query(
            lambda s, d: _orders(s, d).select("o_orderkey", *(S.months_before(F.col("day"), n).alias(f"m{n}") for n in (3, 24, 36))),
            "SELECT o_orderkey, (CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH)::DATE AS m3, (CAST(o_orderdate AS DATE) - INTERVAL 24 MONTH)::DATE AS m24, (CAST(o_orderdate AS DATE) - INTERVAL 36 MONTH)::DATE AS m36 FROM orders",
        ),
        "P07_printed_amount": Query(_p07, _P07),
        "P08_tagged_amount": Query(_p08, _P08),
        "P09_displayed_period": Query(_p09, _P09),
        "P10_normalize_source": Query(lambda s, d: _normal(s, d).select("c_custkey", "concept", F.col("normal").cast("double").alias("normal")), f"SELECT c_custkey, concept, CAST(normal AS DOUBLE) AS normal FROM {_NORMAL}"),
        "P11_canonical_guard": Query(
            lambda s, d: _normal(s, d).select("c_custkey", F.when(F.col("value") == F.col("normal"), F.col("c_custkey").cast("string")).otherwise(S.identity(F.col("c_custkey"), F.col("normal"))).alias("fact_id")),
            f"SELECT c_custkey, CASE WHEN value = normal THEN c_custkey::VARCHAR ELSE sha256(CAST(to_json([CAST(c_custkey AS VARCHAR), CAST(normal AS VARCHAR)]) AS VARCHAR)) END AS fact_id FROM {_NORMAL}",
        ),
        "P12_normalization_rule": Query(
            lambda s, d: _normal(s, d).groupBy(S.normalization_rule(F.col("value"), F.col("normal"), F.col("concept")).alias("rule")).agg(F.count("*").alias("n")),
            f"SELECT CASE WHEN value = normal THEN 'unchanged' WHEN concept = 'NET_ASSETS' THEN 'net liabilities read as negative net assets' ELSE 'parenthesised creditors read as a positive liability' END AS rule, count(*) AS n FROM {_NORMAL} GROUP BY 1",
        ),
        "P13_heading_scope": Query(_p13, "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'GROUP' WHEN 1 THEN 'COMPANY' WHEN 5 THEN 'GROUP' ELSE 'UNRESOLVED' END AS scope FROM part"),
        "P14_value_codec": Query(_p14, _P14),
        "P15_identity": Query(_p15, _P15),
        "P16_made_up_date": Query(_p16, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS made_up FROM orders"),
        "P17_strict_json": Query(_p17, "SELECT event_id, event_id % 3 = 0 AS accepted FROM events"),
        "P18_two_places": Query(
            lambda s, d: table(s, d, "customer").select("c_custkey", S.two_places(F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal").cast("decimal(12,2)") / 8)).alias("shown")),
            "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN CAST(CAST(round(CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 125 / 1000 AS DECIMAL(24,6)), 2) AS DECIMAL(20,2)) AS VARCHAR) ELSE 'Unavailable' END AS shown FROM customer",
        ),
    }
