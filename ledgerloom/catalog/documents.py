"""Queries for document jobs and explanations (D, W08-W10, T, U04, X), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import two_places
from ..operators import documents as D
from ..plans import flagship, model
from ..sources import adapters
from ..sources.adapters import table
from .assessment import sql
from .base import Query
from .validation import _QUALITY, _quality


# ---------------------------------------------------------------- documents

def tagged_documents(s: SparkSession, d: str) -> DataFrame:
    """Each order as an inline-tagged document with one tag per line of it.

    Open lines are of the order's day, others of the year before, in a context with a dimension that unspecified orders
    lack; urgent pending orders say their first context twice; lines of kind N are in shares.
    """
    li = table(s, d, "lineitem").withColumn("tag", F.concat(
        F.lit('<p><ix:nonFraction name="uk:'), F.col("l_returnflag"), F.lit('" contextRef="'), F.when(F.col("l_linestatus") == "O", "c0").otherwise("c1"), F.lit('" unitRef="'), F.when(F.col("l_returnflag") == "N", "s").otherwise("u"), F.lit('" scale="'), F.round(F.col("l_tax") * 100).cast("int").cast("string"),
        F.when(F.col("l_returnflag") == "R", '" sign="-').otherwise(""), F.lit('"><span>'), F.format_number(F.floor("l_extendedprice"), 0), F.lit("</span></ix:nonFraction></p>")))
    body = li.groupBy("l_orderkey").agg(F.array_join(F.collect_list("tag"), "\n").alias("body"))
    o = table(s, d, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"))
    end = F.col("o_orderdate").cast("date")
    context = lambda k, day, more="": F.concat(F.lit(f"<xbrli:context id='c{k}'><xbrli:entity><xbrli:identifier scheme='uk'>"), F.col("o_custkey").cast("string"), F.lit(f"</xbrli:identifier>{more}</xbrli:entity><xbrli:period><xbrli:instant>"), day.cast("string"), F.lit("</xbrli:instant></xbrli:period></xbrli:context>"))
    member = '<xbrli:segment><xbrldi:explicitMember dimension="uk:Scope">uk:Company</xbrldi:explicitMember></xbrli:segment>'
    second = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", context(1, F.add_months(end, -12), member)).otherwise(F.lit(""))
    twice = F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), context(0, end)).otherwise(F.lit(""))
    units = '<xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit><xbrli:unit id="s"><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unit>'
    return o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("number"), F.concat(F.lit("<html>"), context(0, end), twice, second, F.lit(units), F.col("body"), F.lit("</html>")).alias("content"))


_TAGGED = """tagged AS (SELECT *, CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'DUPLICATE_CONTEXT' WHEN o_orderpriority = '4-NOT SPECIFIED' AND bool_or(l_linestatus = 'F') OVER (PARTITION BY o_orderkey) THEN 'UNRESOLVED_REFERENCE' END AS failure
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""
TAGGED_SQL = f"""WITH {_TAGGED} SELECT o_orderkey AS document_id, l_returnflag AS name, CASE WHEN l_linestatus = 'O' THEN CAST(o_orderdate AS DATE) ELSE (CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH)::DATE END AS period_end, 'GBP' AS currency, CAST(o_custkey AS VARCHAR) AS entity,
  CASE WHEN l_linestatus = 'O' THEN '' ELSE 'uk:Scope=uk:Company' END AS dimensions, CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * floor(l_extendedprice) * pow(10, round(l_tax * 100)) AS DOUBLE) AS value, NULL AS failure
FROM tagged WHERE failure IS NULL AND l_returnflag <> 'N' UNION ALL SELECT DISTINCT o_orderkey, NULL, NULL::DATE, NULL, NULL, NULL, NULL, failure FROM tagged WHERE failure IS NOT NULL"""


def _d01(s: SparkSession, d: str) -> DataFrame:
    f = D.tagged_facts(tagged_documents(s, d))
    dimensions = F.array_join(F.transform("dimensions", lambda x: F.concat(x["dimension"], F.lit("="), x["member"])), ",")
    return f.select("document_id", F.substring_index("name", ":", -1).alias("name"), "period_end", "currency", "entity", dimensions.alias("dimensions"), F.col("value").cast("double").alias("value"), "failure")


def _words(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 2).alias("page"), (F.floor("l_extendedprice") % 40).cast("double").alias("y"), F.col("l_quantity").alias("x"), F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"))


_WORDS = "words AS (SELECT l_orderkey AS document_id, l_partkey % 2 AS page, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 40 AS DOUBLE) AS y, l_quantity AS x, 'w' || l_partkey AS word FROM lineitem)"
_W09 = f"""WITH RECURSIVE {_WORDS}, n AS (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY y, x, word) AS k FROM words),
f AS (SELECT document_id, page, k, x, word, y AS anchor, CAST(0 AS BIGINT) AS line FROM n WHERE k = 1
  UNION ALL SELECT n.document_id, n.page, n.k, n.x, n.word, CASE WHEN n.y - f.anchor > 3 THEN n.y ELSE f.anchor END, CASE WHEN n.y - f.anchor > 3 THEN f.line + 1 ELSE f.line END FROM f JOIN n ON n.document_id = f.document_id AND n.page = f.page AND n.k = f.k + 1)
SELECT document_id, page, line, string_agg(word, ' ' ORDER BY x, word) AS text FROM f GROUP BY 1, 2, 3"""


def _w10(s: SparkSession, d: str) -> DataFrame:
    bands = table(s, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.lit(r).alias("right")) for b, r in ((2000, 20.0), (1999, 42.0))))).alias("b"))
    bands = bands.select("document_id", "b.band", "b.right", F.lit(20.0).alias("spacing"))
    return D.banded(_words(s, d).select("document_id", "x", "word"), bands, ["document_id"], slack=3.0).select("document_id", F.col("band").cast("long").alias("band"), "n", "word")


_W10 = f"""WITH {_WORDS} SELECT o_orderkey AS document_id, CAST(band AS BIGINT) AS band, count(word) AS n, CASE WHEN count(word) = 1 THEN max(word) END AS word
FROM orders CROSS JOIN (VALUES (2000, 20.0), (1999, 42.0)) b(band, r) LEFT JOIN words ON document_id = o_orderkey AND x > r - 15 AND x <= r + 3 GROUP BY 1, 2"""


def _lines(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))


def _w08(s: SparkSession, d: str) -> DataFrame:
    c = D.heading_context(_lines(s, d), ["doc_id"], "k", F.length("line") < 40)
    return c.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("heading").alias("under_heading"), F.count_distinct("heading").alias("headings"))


_W08 = """SELECT doc_id, count(*) AS lines, count(heading) AS under_heading, count(DISTINCT heading) AS headings FROM (
  SELECT doc_id, last_value(CASE WHEN length(line) < 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) GROUP BY 1"""


def _t01(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").select("conv_id", F.col("turn").alias("page"), F.length("text").cast("long").alias("size"), F.when(F.col("role") == "assistant", 0).when(F.col("role") == "user", 1).otherwise(2).alias("rank"))
    return D.greedy_fit(c, "conv_id", 900, 4)


_T01 = """WITH RECURSIVE n AS (SELECT conv_id, turn AS page, CAST(length(text) AS BIGINT) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn) AS k, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
f AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS pages FROM (SELECT DISTINCT conv_id FROM n)
  UNION ALL SELECT f.conv_id, n.k, CASE WHEN len(f.pages) < 4 AND used + size <= 900 THEN used + size ELSE used END, CASE WHEN len(f.pages) < 4 AND used + size <= 900 THEN list_append(f.pages, n.page) ELSE f.pages END FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1)
SELECT f.conv_id, used, array_to_string(pages, ',') AS pages FROM f JOIN (SELECT conv_id, max(k) AS k FROM n GROUP BY 1) USING (conv_id, k)"""


def _d04(s: SparkSession, d: str) -> DataFrame:
    """Rows of label and year columns: the two largest columns of an order's lines by flag."""
    li = table(s, d, "lineitem").withColumn("p", F.floor("l_extendedprice"))
    text = F.concat_ws(" ", F.col("l_returnflag"), F.format_number("p", 0), F.concat(F.lit("("), F.col("l_linenumber").cast("string"), F.lit(")")))
    lines = li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    labels = s.createDataFrame([("A", "ACCEPTED"), ("R", "RETURNED")], "label string, concept string")
    r = D.line_columns(lines, labels)
    return r.select("l_orderkey", "l_partkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "concept", F.get("numbers", F.lit(0)).alias("this_year"), F.get("numbers", F.lit(1)).alias("last_year"))


_D04 = "SELECT l_orderkey, l_partkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CASE l_returnflag WHEN 'A' THEN 'ACCEPTED' ELSE 'RETURNED' END AS concept, format('{:,}', CAST(floor(l_extendedprice) AS BIGINT)) AS this_year, '(' || l_linenumber || ')' AS last_year FROM lineitem WHERE l_returnflag IN ('A', 'R')"


def _d05(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").select("l_orderkey", F.lit("ITEM").alias("kind"), F.col("l_linenumber").alias("position"), F.col("l_quantity").alias("amount"), (F.col("l_partkey") % 20 != 3).alias("known"))
    sums = li.groupBy("l_orderkey").agg(F.sum("amount").alias("total"))
    o = sums.select("l_orderkey", F.lit("SUBTOTAL").alias("kind"), F.when(F.col("l_orderkey") % 6 == 1, 0).otherwise(9).alias("position"), F.when(F.col("l_orderkey") % 5 == 2, F.col("total") + 1).otherwise(F.col("total")).alias("amount"), F.lit(True).alias("known"))
    return D.asset_side(li.unionByName(o.filter("l_orderkey % 11 <> 4")), ["l_orderkey"])


_D05 = "SELECT l_orderkey, CASE WHEN l_orderkey % 11 = 4 THEN 'NO_SINGLE_SUBTOTAL' WHEN NOT bool_and(l_partkey % 20 <> 3) THEN 'UNKNOWN_ROW' WHEN l_orderkey % 6 = 1 THEN 'ROW_AFTER_SUBTOTAL' WHEN l_orderkey % 5 = 2 THEN 'SUM_DIFFERS' ELSE 'COMPLETE' END AS verdict FROM lineitem GROUP BY 1"

PATTERNS = (("loans", "the "), ("leases", "der "), ("bonds", "de la "))


def _d06(s: SparkSession, d: str) -> DataFrame:
    """Evidence turns per keyword category of each conversation."""
    patterns = s.createDataFrame(list(PATTERNS), "category string, pattern string")
    c = table(s, d, "conversations").crossJoin(F.broadcast(patterns)).filter(F.expr("contains(lower(text), pattern)"))  # three patterns
    return c.groupBy("conv_id", "category").agg(F.array_join(F.array_sort(F.collect_set("turn")), ",").alias("turns"))


_D06 = f"SELECT conv_id, category, string_agg(turn::VARCHAR, ',' ORDER BY turn) AS turns FROM conversations, (VALUES {', '.join(map(str, PATTERNS))}) p(category, pattern) WHERE contains(lower(text), pattern) GROUP BY 1, 2"


def _d07(s: SparkSession, d: str) -> DataFrame:
    doc = table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return doc.groupBy("sha").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


# -------------------------------------------------------------- explanations

def _reference(s: SparkSession, d: str) -> DataFrame:
    v = flagship.reference_beliefs(s, d)
    return v.join(F.broadcast(model.variables(s).select("code", "unit", "domain")), "code")


def _x01(s: SparkSession, d: str) -> DataFrame:
    v = _reference(s, d).filter("value is not null")
    descending = F.col("low_ref") > F.col("high_ref")
    beyond_high = F.when(descending, F.col("value") <= F.col("high_ref")).otherwise(F.col("value") >= F.col("high_ref"))
    beyond_low = F.when(descending, F.col("value") >= F.col("low_ref")).otherwise(F.col("value") <= F.col("low_ref"))
    side = F.when(beyond_high, "at or beyond the high-risk level").when(beyond_low, "at or beyond the low-risk level").otherwise("between the two levels")
    return v.groupBy("code", side.alias("side")).agg(F.count("*").alias("companies"))


_X01 = """SELECT code, CASE WHEN (low_ref > high_ref AND value <= high_ref) OR (low_ref < high_ref AND value >= high_ref) THEN 'at or beyond the high-risk level'
  WHEN (low_ref > high_ref AND value >= low_ref) OR (low_ref < high_ref AND value <= low_ref) THEN 'at or beyond the low-risk level' ELSE 'between the two levels' END AS side, count(*) AS companies
FROM member JOIN vars USING (code) WHERE value IS NOT NULL GROUP BY 1, 2"""


def _x02(s: SparkSession, d: str) -> DataFrame:
    reason = (
        F.when(F.col("reason") == "ZERO_DENOMINATOR", "The denominator is zero.")
        .when(F.col("reason") == "INCOMPLETE_FILING_HISTORY", "The filing history is incomplete.")
        .when(F.col("reason") == "AMBIGUOUS", "Observations conflict.")
        .when(F.col("reason") == "EMPTY_DIRECTOR_POPULATION", "No usable appointment dates were found.")
        .otherwise("Inputs are missing.")
    )
    return _reference(s, d).filter("value is null").select("company", "code", reason.alias("unknown_reason"))


_X02 = """SELECT company, code, CASE reason WHEN 'ZERO_DENOMINATOR' THEN 'The denominator is zero.' WHEN 'INCOMPLETE_FILING_HISTORY' THEN 'The filing history is incomplete.' WHEN 'AMBIGUOUS' THEN 'Observations conflict.'
  WHEN 'EMPTY_DIRECTOR_POPULATION' THEN 'No usable appointment dates were found.' ELSE 'Inputs are missing.' END AS unknown_reason FROM member WHERE value IS NULL"""


def _x03(s: SparkSession, d: str) -> DataFrame:
    v = _reference(s, d)
    pick = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("code")))), ",")
    n = v.groupBy("company", "domain").agg(pick(F.col("high") > F.col("low")).alias("lean_high"), pick(F.col("low") > F.col("high")).alias("lean_low"), pick(F.col("unknown") > 0).alias("carry_unknown"))
    return n.withColumn("disagree", (F.col("lean_high") != "") & (F.col("lean_low") != ""))


_X03 = """SELECT *, lean_high <> '' AND lean_low <> '' AS disagree FROM (SELECT company, domain, coalesce(string_agg(code, ',' ORDER BY code) FILTER (high > low), '') AS lean_high, coalesce(string_agg(code, ',' ORDER BY code) FILTER (low > high), '') AS lean_low,
  coalesce(string_agg(code, ',' ORDER BY code) FILTER (unknown > 0), '') AS carry_unknown FROM member GROUP BY 1, 2)"""


def _x04(s: SparkSession, d: str) -> DataFrame:
    return _reference(s, d).select("company", "code", F.initcap("domain").alias("domain"), "unit", F.when(F.col("value").isNull(), "Unknown").otherwise(two_places(F.round("value", 4))).alias("shown"))


_X04 = "SELECT company, code, CASE domain WHEN 'FINANCIAL' THEN 'Financial' ELSE 'Governance' END AS domain, unit, CASE WHEN value IS NULL THEN 'Unknown' ELSE CAST(CAST(round(CAST(round(value, 4) AS DECIMAL(24,6)), 2) AS DECIMAL(20,2)) AS VARCHAR) END AS shown FROM member"


def _x05(s: SparkSession, d: str) -> DataFrame:
    """Reference levels with the direction of risk, and how many companies each variable is known for."""
    v = _reference(s, d)
    direction = F.when(F.col("low_ref") < F.col("high_ref"), "higher values mean higher risk").otherwise("lower values mean higher risk")
    return v.groupBy("code", "low_ref", "high_ref", direction.alias("direction")).agg(F.count("value").alias("known"))


def _x06(s: SparkSession, d: str) -> DataFrame:
    h = F.broadcast(model.hierarchy(s))
    v = _reference(s, d).join(h, F.col("code") == F.col("child"))
    return v.select("company", "parent", "child", F.round("weight", 6).alias("weight"), F.round("high", 6).alias("high"))


def _x07(s: SparkSession, d: str) -> DataFrame:
    """The source inputs behind each ratio of the latest year."""
    f = adapters.facts(s, d)
    last = f.groupBy("company").agg(F.max("yr").alias("yr"))
    needs = s.createDataFrame([("F1.1", "NET_ASSETS"), ("F1.1", "TOTAL_ASSETS"), ("F2.2", "CURRENT_ASSETS"), ("F2.2", "CURRENT_LIABILITIES")], "code string, concept string")
    return f.join(last, ["company", "yr"]).join(F.broadcast(needs), "concept").select("company", "code", "concept", "yr", F.col("value").cast("double").alias("value"))


def _x08(s: SparkSession, d: str) -> DataFrame:
    v = _reference(s, d)
    say = F.when(F.col("value").isNull(), "could not be assessed").when(F.col("unknown") >= F.greatest("low", "high"), "uncertain").when(F.abs(F.col("low") - F.col("high")) < 1e-12, "equal support").when(F.col("high") > F.col("low"), "mainly high-risk").otherwise("mainly low-risk")
    return v.select("company", "code", say.alias("sentence"))


_X08 = "SELECT company, code, CASE WHEN value IS NULL THEN 'could not be assessed' WHEN unknown >= greatest(low, high) THEN 'uncertain' WHEN abs(low - high) < 1e-12 THEN 'equal support' WHEN high > low THEN 'mainly high-risk' ELSE 'mainly low-risk' END AS sentence FROM member"


def _x09(s: SparkSession, d: str) -> DataFrame:
    q = _quality(s, d)
    failures = F.concat_ws(",", F.when(F.col("failed"), "HARD_RULE"), F.when(F.col("s").isNull(), "UNMAPPED_SOURCE"))
    return q.select("c_custkey", *(F.col(c).cast("double").alias(c) for c in "sevc"), failures.alias("failures"))


def _x10(s: SparkSession, d: str) -> DataFrame:
    """Standards as each user saw them last against the newest of their kind: how many have drifted."""
    e = table(s, d, "events")
    stored = e.groupBy("user_id", "event_type").agg(F.max_by(F.floor("value"), "event_id").alias("seen"))
    current = e.groupBy("event_type").agg(F.max_by(F.floor("value"), "event_id").alias("now"))
    j = stored.join(F.broadcast(current), "event_type")  # one row for each kind of event
    return j.groupBy("user_id").agg(F.count_if(F.col("seen") != F.col("now")).alias("drifted"), F.count("*").alias("standards"))


_X10 = """SELECT user_id, count(*) FILTER (seen <> now) AS drifted, count(*) AS standards FROM (SELECT user_id, event_type, arg_max(floor(value), event_id) AS seen FROM events GROUP BY 1, 2)
JOIN (SELECT event_type, arg_max(floor(value), event_id) AS now FROM events GROUP BY 1) USING (event_type) GROUP BY 1"""


def _u04(s: SparkSession, d: str) -> DataFrame:
    """Documents of one source, language and length: each tells the lines of the first of them, in whatever order."""
    doc = table(s, d, "documents").select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), "lang", F.length("text")).alias("name"))
    first = doc.groupBy("name").agg(F.min_by("text", "doc_id").alias("plan"))
    lines = lambda c: F.explode(F.split(c, "\n")).alias("line")
    return D.permuted(doc.join(first, "name").select("doc_id", lines("plan")), doc.select("doc_id", lines("text")), "doc_id", "line")


_U04 = """WITH doc AS (SELECT doc_id, text, coalesce(source, '') || '/' || lang || '/' || length(text) AS name FROM documents), first AS (SELECT name, arg_min(text, doc_id) AS plan FROM doc GROUP BY 1),
each AS (SELECT doc_id, line, sum(x) AS x FROM (SELECT doc_id, unnest(string_split(plan, chr(10))) AS line, 1 AS x FROM doc JOIN first USING (name) UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))), -1 FROM doc) GROUP BY 1, 2)
SELECT doc_id, bool_and(x = 0) AS keeps_every_part_once, CAST(sum(greatest(x, 0)) AS BIGINT) AS lost, CAST(sum(greatest(-x, 0)) AS BIGINT) AS added FROM each GROUP BY 1"""


def queries() -> dict[str, Query]:
    return {
        "W08_heading_context": Query(_w08, _W08),
        "W09_line_assembly": Query(lambda s, d: D.assembled_lines(_words(s, d), ["document_id", "page"]), _W09),
        "W10_year_bands": Query(_w10, _W10),
        "T01_page_selection": Query(_t01, _T01),
        "T02_newest_first": Query(lambda s, d: table(s, d, "orders").orderBy(F.col("o_orderdate").desc(), "o_orderkey").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("day")), "SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey"),
        "T03_company_list": Query(lambda s, d: table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name").orderBy("c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') ORDER BY c_name"),
        "D01_tagged_facts": Query(_d01, TAGGED_SQL),
        "D02_visible_text": Query(
            lambda s, d: table(s, d, "pages").select("page_id", F.sha2(D.visible_text(F.col("html")).cast("binary"), 256).alias("text_sha256")),
            r"SELECT page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS text_sha256 FROM pages",
        ),
        "D03_period_role": Query(
            lambda s, d: D.period_roles(D.tagged_facts(tagged_documents(s, d)).filter("not failed")).groupBy("document_id", "role").agg(F.count("*").alias("facts")),
            f"SELECT document_id, CASE WHEN period_end = latest THEN 'CURRENT' ELSE 'COMPARATIVE' END AS role, count(*) AS facts FROM (SELECT *, max(period_end) OVER (PARTITION BY document_id) AS latest FROM ({TAGGED_SQL}) WHERE failure IS NULL) GROUP BY 1, 2",
        ),
        "D04_labelled_columns": Query(_d04, _D04),
        "D05_asset_side": Query(_d05, _D05),
        "D06_keyword_pages": Query(_d06, _D06),
        "D07_duplicate_evidence": Query(_d07, "SELECT sha256(text) AS sha, min(doc_id) AS kept, count(*) AS copies FROM documents GROUP BY 1"),
        "X01_variable_side": Query(_x01, sql(["member"], _X01)),
        "X02_unknown_reason": Query(_x02, sql(["member"], _X02)),
        "X03_node_explanation": Query(_x03, sql(["member"], _X03)),
        "X04_summary_rows": Query(_x04, sql(["member"], _X04)),
        "X05_standards_rows": Query(_x05, sql(["member"], "SELECT code, low_ref, high_ref, CASE WHEN low_ref < high_ref THEN 'higher values mean higher risk' ELSE 'lower values mean higher risk' END AS direction, count(value) AS known FROM member JOIN (SELECT code, low_ref, high_ref FROM vars) USING (code) GROUP BY 1, 2, 3, 4")),
        "X06_domain_rows": Query(_x06, sql(["member", "edges"], "SELECT company, parent, child, round(weight, 6) AS weight, round(CAST(high AS DOUBLE), 6) AS high FROM member JOIN edges ON child = code")),
        "X07_source_inputs": Query(_x07, sql(["facts"], "SELECT f.company, code, f.concept, yr, CAST(value AS DOUBLE) AS value FROM (SELECT *, max(yr) OVER (PARTITION BY company) AS latest FROM facts) f JOIN (VALUES ('F1.1', 'NET_ASSETS'), ('F1.1', 'TOTAL_ASSETS'), ('F2.2', 'CURRENT_ASSETS'), ('F2.2', 'CURRENT_LIABILITIES')) n(code, concept) ON n.concept = f.concept WHERE yr = latest")),
        "X08_dominance": Query(_x08, sql(["member"], _X08)),
        "X09_reliability_rows": Query(_x09, f"WITH {_QUALITY} SELECT c_custkey, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e, CAST(v AS DOUBLE) AS v, CAST(c AS DOUBLE) AS c, concat_ws(',', CASE WHEN failed THEN 'HARD_RULE' END, CASE WHEN s IS NULL THEN 'UNMAPPED_SOURCE' END) AS failures FROM quality"),
        "X10_reference_drift": Query(_x10, _X10),
        "U04_permutation_check": Query(_u04, _U04),
    }
