"""Queries for sources, stores and joins, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import identity
from ..operators import evidence as E
from ..operators import grounding, variables
from ..operators.documents import tagged_facts
from ..sources import adapters, published
from ..sources.adapters import table, with_ctes
from ..sources.shared import materialize, shared_dir
from .assessment import periods_sql, ratio_sql
from .base import Query, r6
from .documents import TAGGED_SQL, tagged_documents

DAY = "DATE '2000-12-31'"


def _day(x: str):
    return F.lit(x).cast("date")


def _order_pages(s: SparkSession, d: str) -> DataFrame:
    """A registry page per customer: its orders as JSON items."""
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("date"))
    o = table(s, d, "orders").withColumn("item", item)
    return o.groupBy(F.col("o_custkey").alias("company")).agg(F.to_json(F.struct(F.sort_array(F.collect_list("item")).alias("items"))).alias("body"))


def _s01(s: SparkSession, d: str) -> DataFrame:
    items = E.page_items(_order_pages(s, d), "struct<id: bigint, status: string, date: string>")
    return items.select("company", "json_path", F.col("item.id").alias("id"), F.col("item.status").alias("status"), F.to_date("item.date").alias("day"))


def _s02(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "conversations").withColumn("total", F.count("*").over(Window.partitionBy("conv_id")))
    pages = c.filter((F.col("conv_id") % 5 != 0) | (F.col("turn") != 1)).select("conv_id", F.col("turn").alias("start_index"), F.lit(1).alias("n_items"), F.when((F.col("conv_id") % 7 == 3) & (F.col("turn") == 1), F.col("total") + 1).otherwise(F.col("total")).alias("total"))
    return E.page_sequence(pages, ["conv_id"])


_S02 = """SELECT conv_id, items, issue IS NULL AS complete, issue FROM (SELECT conv_id, CAST(sum(n) AS BIGINT) AS items,
  CASE WHEN bool_or(before <> turn) THEN 'GAP' WHEN min(total) <> max(total) THEN 'TOTAL_CHANGED' WHEN sum(n) <> max(total) THEN 'INCOMPLETE' END AS issue
  FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
    SELECT conv_id, turn, 1 AS n, CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN t + 1 ELSE t END AS total FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS t FROM conversations)
    WHERE conv_id % 5 <> 0 OR turn <> 1)) GROUP BY 1)"""


def _s03(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("company"), "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return E.horizon(o, ["company"], "day", F.add_months(_day(adapters.AS_OF), -36), _day(adapters.AS_OF)).select("company", "o_orderkey", "covered")


def _documents(s: SparkSession, d: str) -> DataFrame:
    media = F.element_at(F.array(*map(F.lit, (*E.MEDIA, "image/png"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("filing"), media.alias("media"), F.col("l_shipdate").alias("received"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("document_id"))


_S04 = """SELECT filing, document_id, media FROM (SELECT *, row_number() OVER (PARTITION BY filing ORDER BY m, received DESC, document_id) AS k FROM (
  SELECT l_orderkey AS filing, l_linenumber % 5 AS m, l_shipdate AS received, l_partkey * 100 + l_linenumber AS document_id,
         CASE l_linenumber % 5 WHEN 0 THEN 'application/xhtml+xml' WHEN 1 THEN 'application/xml' WHEN 2 THEN 'text/xml' ELSE 'application/pdf' END AS media FROM lineitem WHERE l_linenumber % 5 < 4)) WHERE k = 1"""


def _s05(s: SparkSession, d: str) -> DataFrame:
    """Documents of one source, language and length are taken for one document: each against the checksum of the first of them, where that has 200 characters."""
    doc = table(s, d, "documents").select("doc_id", "text", F.concat_ws("/", F.coalesce("source", F.lit("")), "lang", F.length("text")).alias("name"))
    first = doc.groupBy("name").agg(F.min_by("text", "doc_id").alias("text")).filter("length(text) >= 200").select("name", F.sha2(F.col("text").cast("binary"), 256).alias("checksum"))
    named = doc.select("name", "doc_id").join(first, "name").select("doc_id", "checksum")
    return E.verified(doc, named, "doc_id", "text")


_S05 = """WITH doc AS (SELECT doc_id, text, coalesce(source, '') || '/' || lang || '/' || length(text) AS name FROM documents)
SELECT doc_id, sha256(d.text) AS checksum, CASE WHEN length(f.text) < 200 THEN 'UNRECORDED' WHEN d.text = f.text THEN 'VERIFIED' ELSE 'CHANGED' END AS verdict FROM doc d JOIN (SELECT name, arg_min(text, doc_id) AS text FROM doc GROUP BY 1) f USING (name)"""


def _s06(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_id", E.object_key(F.lpad(F.col("user_id").cast("string"), 8, "0"), F.upper("event_type"), F.col("ts"), F.col("event_id"), F.sha2("props", 256), F.lit("json")).alias("object_key"))


def _s07(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem").withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber")).select("id", "l_partkey", "l_suppkey", "l_returnflag")
    return E.immutable_append(li.filter("id % 3 = 0"), li, "id").groupBy("verdict").agg(F.count("*").alias("n"))


_S07 = """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN id % 3 = 0 THEN CASE WHEN c = m THEN 'UNCHANGED' ELSE 'CONFLICT' END WHEN c = m THEN 'NEW' ELSE 'CONFLICT' END AS verdict
FROM (SELECT *, min(c) OVER (PARTITION BY id) AS m FROM (SELECT l_orderkey * 10 + l_linenumber AS id, {'a': l_partkey, 'b': l_suppkey, 'c': l_returnflag} AS c FROM lineitem))) GROUP BY 1"""


def _s08(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    facts = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact_id"), F.col("l_orderkey").alias("evidence_id"), (F.col("l_suppkey") % 5).alias("source_id"))
    known = table(s, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("evidence_id"), (F.col("o_custkey") % 5).alias("source_id"))
    return E.page_fact_append(facts, known).groupBy("verdict").agg(F.count("*").alias("n"))


_S08 = """SELECT CASE WHEN n > 1 THEN 'DUPLICATE_ID' WHEN o_orderkey IS NULL THEN 'UNKNOWN_EVIDENCE' WHEN o_custkey % 5 <> l_suppkey % 5 THEN 'OTHER_SOURCE' ELSE 'ACCEPTED' END AS verdict, count(*) AS n
FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey GROUP BY 1"""


CONFIG = "model-1.2"


def _payloads(s: SparkSession, d: str, until: str, config=None) -> DataFrame:
    """What is published of a company by a day: runs (its newest filing, and its newest one that was accepted), totals, open issues."""
    o = table(s, d, "orders").filter(F.col("o_orderdate") <= F.lit(until).cast("timestamp"))
    status = F.col("o_orderstatus")
    n = o.groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("accounts_run"), F.max(F.when(status == "F", F.col("o_orderkey"))).alias("control_run"), F.count("*").alias("filings"),
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("pence"), F.bool_or(status == "P").alias("pending"),
    )
    issues = F.array_compact(F.array(F.when(F.col("control_run").isNull(), "NO_ACCEPTED_FILING"), F.when(F.col("pending"), "PENDING_FILING")))
    c = table(s, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey")).withColumn("issues", issues)
    body = F.to_json(F.struct("c_custkey", "c_name", "accounts_run", "control_run", "filings", "pence", "issues"))
    return c.select("c_custkey", body.alias("payload"), (F.lit(CONFIG) if config is None else config).alias("config"), "accounts_run", "control_run")


def _payload_sql(until: str) -> str:
    return f"""SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","accounts_run":' || accounts_run || coalesce(',"control_run":' || control_run, '') || ',"filings":' || filings || ',"pence":' || pence || ',"issues":['
  || concat_ws(',', CASE WHEN control_run IS NULL THEN '"NO_ACCEPTED_FILING"' END, CASE WHEN pending THEN '"PENDING_FILING"' END) || ']}}' AS payload, accounts_run, control_run, c_mktsegment, c_acctbal
FROM customer JOIN (SELECT o_custkey, max(o_orderkey) AS accounts_run, max(o_orderkey) FILTER (o_orderstatus = 'F') AS control_run, count(*) AS filings, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS pence, bool_or(o_orderstatus = 'P') AS pending
  FROM orders WHERE o_orderdate <= TIMESTAMP '{until}' GROUP BY 1) ON o_custkey = c_custkey"""


def _s10(s: SparkSession, d: str) -> DataFrame:
    """Published at the end of 1999 and again at the end of 2000: rows that did not change keep their version."""
    folder = f"{shared_dir(s)}/published-{uuid.uuid4().hex}"
    for until in ("1999-12-31", "2000-12-31"):
        published.publish(_payloads(s, d, until), folder, "c_custkey")
    return published.read(s, folder, "c_custkey").select("c_custkey", "payload_hash", "config", "accounts_run", "control_run", "version")


_S10 = f"""SELECT c_custkey, sha256(n.payload) AS payload_hash, '{CONFIG}' AS config, n.accounts_run, n.control_run, CAST(CASE WHEN o.payload = n.payload THEN 1 ELSE 2 END AS BIGINT) AS version
FROM ({_payload_sql("2000-12-31")}) n LEFT JOIN (SELECT c_custkey, payload FROM ({_payload_sql("1999-12-31")})) o USING (c_custkey)"""


def _s11(s: SparkSession, d: str) -> DataFrame:
    """What was published at the end of 1999, read with the evidence of the end of 2000; payloads of some companies were changed by hand."""
    folder = f"{shared_dir(s)}/published-{uuid.uuid4().hex}"
    who = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    old = _payloads(s, d, "1999-12-31").join(who, "c_custkey").withColumn("config", F.when(F.col("c_mktsegment") == "HOUSEHOLD", "model-1.1").otherwise(F.col("config")))
    published.publish(old, folder, "c_custkey")
    seen = published.read(s, folder, "c_custkey").join(who, "c_custkey").withColumn("payload", F.when(F.col("c_acctbal") < 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload")))
    latest = who.select("c_custkey").join(_payloads(s, d, "2000-12-31"), "c_custkey", "left")
    return published.status(seen, latest, "c_custkey", CONFIG)


_S11 = f"""SELECT c_custkey, status = 'CURRENT' AS shown, status FROM (SELECT c.c_custkey, CASE WHEN o.payload IS NULL THEN 'MISSING' WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'OLD_CONFIG'
  WHEN o.accounts_run IS DISTINCT FROM n.accounts_run OR o.control_run IS DISTINCT FROM n.control_run THEN 'NEWER_EVIDENCE' WHEN c.c_acctbal < 0 THEN 'HASH_MISMATCH' ELSE 'CURRENT' END AS status
FROM customer c LEFT JOIN ({_payload_sql("1999-12-31")}) o ON o.c_custkey = c.c_custkey LEFT JOIN ({_payload_sql("2000-12-31")}) n ON n.c_custkey = c.c_custkey)"""


def _j01(s: SparkSession, d: str) -> DataFrame:
    """Link, category and date facts of one subject, joined into filings of one category."""
    o = table(s, d, "orders")
    f = lambda c, v: o.select(F.col("o_orderkey").alias("subject"), F.lit(c).alias("concept"), v.cast("string").alias("v"))
    eav = f("link", F.col("o_custkey")).union(f("category", F.when(F.col("o_orderstatus") == "F", "accounts").otherwise("other"))).union(f("date", F.col("o_orderdate").cast("date")))
    wide = eav.groupBy("subject").pivot("concept", ["link", "category", "date"]).agg(F.first("v"))
    return wide.filter("category = 'accounts'").select("subject", F.col("link").cast("long").alias("company"), F.to_date("date").alias("day"))


def _reuse(s: SparkSession, d: str) -> DataFrame:
    """Each event as a snapshot that reuses its user's event before; purchases of one price may name others, or none that exists."""
    e = table(s, d, "events").withColumn("before", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")))
    odd = (F.col("event_type") == "purchase") & (F.col("value") < 1)
    reused = F.when(odd & (F.col("event_id") % 2 == 0), F.col("event_id") - 1).when(odd, -F.col("event_id") - 1).otherwise(F.col("before"))
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("company"), reused.alias("reused"))


def _j02(s: SparkSession, d: str) -> DataFrame:
    return E.origin_snapshots(_reuse(s, d), ("company",))


_J02 = """WITH RECURSIVE snap AS (SELECT event_id AS id, user_id AS company, CASE WHEN event_type = 'purchase' AND value < 1 THEN CASE WHEN event_id % 2 = 0 THEN event_id - 1 ELSE -event_id - 1 END ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS reused FROM events),
link AS (SELECT s.*, CASE WHEN s.reused IS NULL THEN NULL WHEN t.id IS NULL THEN 'MISSING_LINK' WHEN t.company <> s.company THEN 'OTHER_OWNER' END AS issue FROM snap s LEFT JOIN snap t ON t.id = s.reused),
walk AS (SELECT id AS snapshot_id, id AS cur, CAST(0 AS BIGINT) AS depth FROM link UNION ALL SELECT snapshot_id, reused, depth + 1 FROM walk JOIN link ON id = cur WHERE reused IS NOT NULL AND issue IS NULL)
SELECT snapshot_id, CASE WHEN issue IS NULL THEN cur END AS origin, CASE WHEN issue IS NULL THEN depth END AS depth, issue FROM walk JOIN link ON id = cur WHERE reused IS NULL OR issue IS NOT NULL"""


def _j03(s: SparkSession, d: str) -> DataFrame:
    li, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).select("c_custkey", "l_suppkey", "l_returnflag").distinct()


def _j04(s: SparkSession, d: str) -> DataFrame:
    duties = table(s, d, "orders").select(F.col("o_orderkey").alias("duty"), (F.col("o_orderkey") % 7).alias("category"))
    filings = table(s, d, "lineitem").filter(F.col("l_shipdate") <= F.lit(adapters.AS_OF)).select(F.col("l_orderkey").alias("duty"), F.col("l_linenumber").cast("long").alias("category"))
    counts = duties.join(filings.withColumn("one", F.lit(1)), ["duty", "category"], "left").groupBy("duty").agg(F.count("one").alias("matches"))
    return counts.select("duty", F.when(F.col("matches") == 0, "OUTSTANDING").when(F.col("matches") == 1, "FILED").otherwise("UNRESOLVED").alias("state"))


#: Names of tags and the dimensions that they have to have.
MAPPING = (("uk:A", (), "TOTAL_ASSETS", 1), ("uk:A", (("uk:Scope", "uk:Company"),), "COMPANY_ASSETS", 1), ("uk:R", (("uk:Scope", "uk:Company"),), "CREDITORS", -1))


def _j05(s: SparkSession, d: str) -> DataFrame:
    """The tagged facts of all documents under canonical concepts."""
    mapping = s.createDataFrame([(n, list(x), c, sign) for n, x, c, sign in MAPPING], "source_concept string, dimensions array<struct<dimension: string, member: string>>, concept string, sign int")
    m = E.mapped_facts(tagged_facts(tagged_documents(s, d)).filter("not failed"), mapping)
    return m.groupBy("concept", "mapping_status").agg(F.count("*").alias("n"), r6("total", F.sum("mapped_value")))


_J05 = f"""SELECT concept, CASE WHEN concept IS NULL THEN 'UNMAPPED' ELSE 'MAPPED' END AS mapping_status, count(*) AS n, CASE WHEN concept IS NOT NULL THEN round(sum(value) * CASE concept WHEN 'CREDITORS' THEN -1 ELSE 1 END, 6) END AS total
FROM (SELECT *, CASE WHEN name = 'A' AND dimensions = '' THEN 'TOTAL_ASSETS' WHEN name = 'A' THEN 'COMPANY_ASSETS' WHEN name = 'R' AND dimensions <> '' THEN 'CREDITORS' END AS concept FROM ({TAGGED_SQL}) WHERE failure IS NULL) GROUP BY 1, 2"""


def _j06(s: SparkSession, d: str) -> DataFrame:
    """Facts (a supplier's parts) through their evidence (order lines) to source (order) and document owner (customer), each level counted."""
    claims = table(s, d, "lineitem").select(F.col("l_suppkey").alias("fact"), "l_orderkey").distinct()
    sources = table(s, d, "orders").filter("o_orderpriority <> '4-NOT SPECIFIED'").select("o_orderkey", "o_custkey")
    owners = table(s, d, "customer").filter("c_acctbal >= 0").select("c_custkey")
    each = claims.join(sources, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(owners, F.col("o_custkey") == F.col("c_custkey"), "left")
    n = each.groupBy("fact").agg(F.count("*").alias("claimed"), F.count("o_orderkey").alias("resolved"), F.count("c_custkey").alias("grounded"), F.max("l_orderkey").alias("last_id"))
    return n.withColumn("status", F.when(F.col("resolved") < F.col("claimed"), "SOURCE_MISSING").when(F.col("grounded") < F.col("claimed"), "OWNER_MISSING").otherwise("GROUNDED"))


_J06 = """SELECT *, CASE WHEN resolved < claimed THEN 'SOURCE_MISSING' WHEN grounded < claimed THEN 'OWNER_MISSING' ELSE 'GROUNDED' END AS status FROM (
  SELECT l_suppkey AS fact, count(DISTINCT l_orderkey) AS claimed, count(DISTINCT o_orderkey) AS resolved, count(DISTINCT CASE WHEN c_custkey IS NOT NULL THEN o_orderkey END) AS grounded, max(l_orderkey) AS last_id
  FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED') ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON o_custkey = c_custkey GROUP BY 1)"""


def _j07(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    n = li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("rows"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    return n.filter("rows > 1").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "rows", F.coalesce(F.col("least") != F.col("most"), F.lit(False)).alias("competing"))


def _j08(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    latest = lambda p: E.latest_by(o.filter(p), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey")
    a = latest(F.col("o_orderstatus").isin("F", "O")).withColumnRenamed("o_orderkey", "accounts_run")
    g = latest(F.col("o_orderpriority") == "1-URGENT").withColumnRenamed("o_orderkey", "governance_run")
    return a.join(g, "o_custkey", "left").select("o_custkey", "accounts_run", "governance_run", F.col("governance_run").isNotNull().alias("paired"))


def _j09(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("resource"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("checked_at"), (F.col("o_orderstatus") != "P").alias("complete"), F.add_months(F.col("o_orderdate").cast("date"), -30).alias("coverage_start"), F.col("o_orderdate").cast("date").alias("coverage_end"))
    return E.reusable(o, ["company", "resource"], F.lit("2000-12-31").cast("timestamp"), 24 * 700, _day("1999-01-01"), _day("1999-06-30"))


_J09 = """SELECT company, resource, attempt_id, complete AND age >= 0 AND age < 700 * 86400 AND a <= DATE '1999-01-01' AND b >= DATE '1999-06-30' AS usable FROM (
  SELECT o_custkey AS company, o_orderpriority AS resource, o_orderkey AS attempt_id, o_orderstatus <> 'P' AS complete, epoch(TIMESTAMP '2000-12-31') - epoch(o_orderdate) AS age, (CAST(o_orderdate AS DATE) - INTERVAL 30 MONTH)::DATE AS a, CAST(o_orderdate AS DATE) AS b,
  row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1"""


def _j10(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("resource")).agg(F.min("o_orderdate").cast("date").alias("coverage_start"), F.max("o_orderdate").cast("date").alias("coverage_end"))
    return E.covers(o, ("1-URGENT", "2-HIGH"), _day("1998-01-01"), _day("1998-12-31"))


_J10 = """SELECT company, count(*) = 2 AND bool_and(a <= DATE '1998-01-01' AND b >= DATE '1998-12-31') AS covered FROM (
  SELECT o_custkey AS company, o_orderpriority, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2) GROUP BY 1"""


def _j11(s: SparkSession, d: str) -> DataFrame:
    """Dangling links and links to another company's document."""
    lab, doc = table(s, d, "labels"), table(s, d, "documents")
    o, c, li = table(s, d, "orders"), table(s, d, "customer"), table(s, d, "lineitem")
    dangling = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select(F.lit("ORDER_WITHOUT_LINES").alias("issue"), F.col("o_orderkey").alias("subject"))
    lost = lab.join(doc, "doc_id", "left_anti").select(F.lit("LABEL_WITHOUT_DOCUMENT"), "doc_id")
    cross = o.join(c, F.col("o_custkey") == F.col("c_custkey")).filter((F.col("c_nationkey") == 3) & (F.col("o_orderstatus") == "P")).select(F.lit("CROSS_COMPANY"), "o_orderkey")
    return dangling.union(lost).union(cross)


_J11 = """SELECT 'ORDER_WITHOUT_LINES' AS issue, o_orderkey AS subject FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'LABEL_WITHOUT_DOCUMENT', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'CROSS_COMPANY', o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3 AND o_orderstatus = 'P'"""


def _edges(s: SparkSession, d: str) -> DataFrame:
    name = lambda k, c: F.concat(F.lit(k), F.col(c).cast("string"))
    o, li, su, na = (table(s, d, t) for t in ("orders", "lineitem", "supplier", "nation"))
    return (
        o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
        .union(li.select(name("o", "l_orderkey"), name("s", "l_suppkey")))
        .union(su.select(name("s", "s_suppkey"), name("n", "s_nationkey")))
        .union(na.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .union(_reuse(s, d).filter("reused is not null").select(name("e", "snapshot_id"), name("e", "reused")))
    )


_EDGES = """edges AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 's' || l_suppkey FROM lineitem
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
UNION ALL SELECT 'e' || event_id, 'e' || reused FROM (SELECT event_id, CASE WHEN event_type = 'purchase' AND value < 1 THEN CASE WHEN event_id % 2 = 0 THEN event_id - 1 ELSE -event_id - 1 END ELSE lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS reused FROM events) WHERE reused IS NOT NULL)"""


def _j12(s: SparkSession, d: str) -> DataFrame:
    """Retention: what the chosen companies need is kept, all other nodes could go."""
    edges = materialize(_edges(s, d), "edges")
    start = table(s, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    start = start.union(table(s, d, "events").filter("value > 99").select(F.concat(F.lit("e"), F.col("event_id").cast("string"))))
    kept = E.reachable(edges, start)
    # one aggregate finds the nodes of all edges and which of them are kept
    there = edges.select(F.explode(F.array("src", "dst")).alias("node"), F.lit(True).alias("linked"), F.lit(False).alias("kept"))
    nodes = there.unionByName(kept.select("node", F.lit(False).alias("linked"), F.lit(True).alias("kept"))).groupBy("node").agg(F.max("linked").alias("linked"), F.max("kept").alias("kept")).filter("linked")
    return nodes.groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("could_go"))


_J12 = f"""WITH RECURSIVE {_EDGES}, seen AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION SELECT 'e' || event_id FROM events WHERE value > 99 UNION SELECT dst FROM seen JOIN edges ON node = src)
SELECT substr(n.node, 1, 1) AS kind, count(s.node) AS kept, count(*) FILTER (s.node IS NULL) AS could_go FROM (SELECT src AS node FROM edges UNION SELECT dst FROM edges) n LEFT JOIN seen s ON s.node = n.node GROUP BY 1"""


def _j13(s: SparkSession, d: str) -> DataFrame:
    """The tree company - filing - fact with its sizes at each level, and its broken edges counted."""
    li, o, c = table(s, d, "lineitem"), table(s, d, "orders"), table(s, d, "customer")
    per_filing = li.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    filings = o.join(per_filing, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("filings"), F.sum("n").alias("facts"), F.count_if(F.col("n").isNull()).alias("broken"))
    t = c.join(filings, F.col("c_custkey") == F.col("o_custkey"), "left")
    return t.select(F.col("c_custkey").alias("company"), *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("filings", "facts", "broken")))


_J13 = """SELECT c_custkey AS company, count(o_orderkey) AS filings, CAST(coalesce(sum(n), 0) AS BIGINT) AS facts, count(*) FILTER (o_orderkey IS NOT NULL AND n IS NULL) AS broken
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1"""


def _j15(s: SparkSession, d: str) -> DataFrame:
    """Citations: allowed, not repeated, and prose without digits."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_suppkey").alias("cited"))
    o = table(s, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    allowed = F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))
    return o.select("o_orderkey", (F.size(F.array_except("cited", allowed)) == 0).alias("allowed"), (F.size(F.array_distinct("cited")) == F.size("cited")).alias("no_repeat"), (~F.col("o_orderpriority").rlike(r"[0-3]")).alias("no_digits"))


_J15 = "SELECT o_orderkey, bool_and(l_suppkey < 90) AS allowed, count(DISTINCT l_suppkey) = count(*) AS no_repeat, NOT regexp_matches(any_value(o_orderpriority), '[0-3]') AS no_digits FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"


def _j14(s: SparkSession, d: str) -> DataFrame:
    """Every sentence of the benchmark's texts as a quote from the documents: in how many, and how often, it stands."""
    sentences = table(s, d, "benchmark").select("item_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sentence", "quote"))
    claims = sentences.withColumn("claim", F.concat_ws("#", "item_id", "sentence"))
    found = grounding.grounded(claims.select("claim", "quote"), table(s, d, "documents").select("doc_id", "text"))
    return found.select("claim", "words", "documents", "status")


_J14 = """WITH claims AS (SELECT item_id || '#' || k AS claim, regexp_extract_all(quote, '[\\p{L}\\p{N}]+') AS words FROM (SELECT item_id, unnest(q) AS quote, unnest(range(len(q))) AS k FROM (SELECT item_id, regexp_split_to_array(text, '[.!?\\n]+') AS q FROM benchmark))),
docs AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(text, '[\\p{L}\\p{N}]+'), ' ') || ' ' AS said FROM documents),
met AS (SELECT claim, count(*) AS n FROM claims JOIN docs ON len(words) > 0 AND contains(said, ' ' || array_to_string(words, ' ') || ' ') GROUP BY 1)
SELECT claim, len(words) AS words, coalesce(n, 0) AS documents, CASE WHEN len(words) = 0 THEN 'EMPTY' WHEN n IS NULL THEN 'ABSENT' WHEN n = 1 THEN 'GROUNDED' ELSE 'AMBIGUOUS' END AS status FROM claims LEFT JOIN met USING (claim)"""


def _j16(s: SparkSession, d: str) -> DataFrame:
    """Per company the year with most of the six concepts; of equal ones the newest."""
    n = adapters.facts(s, d).groupBy("company", "yr").agg(F.count_distinct("concept").alias("covered"))
    return n.groupBy("company").agg(F.max(F.struct("covered", "yr")).alias("b")).select("company", F.col("b.yr").alias("yr"), F.col("b.covered").alias("covered"))


def _j17(s: SparkSession, d: str) -> DataFrame:
    doc = table(s, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), F.lit("v1").alias("version"))
    m = F.col("doc_id") % 4
    ledger = doc.filter(m != 0).select(identity(F.col("sha"), F.col("version")).alias("fingerprint"), F.when(m == 1, "COMPLETE").when(m == 2, "FAILED").otherwise("RUNNING").alias("state"))
    ledger = ledger.groupBy("fingerprint").agg(F.min("state").alias("state"))
    return E.ledger_verdict(doc, ledger, ["sha", "version"]).select("doc_id", "verdict")


_J17 = """SELECT d.doc_id, CASE coalesce(state, '') WHEN '' THEN 'PROCESS' WHEN 'COMPLETE' THEN 'REUSE' WHEN 'FAILED' THEN 'REFUSE' ELSE 'RECOVER' END AS verdict
FROM documents d LEFT JOIN (SELECT text, min(CASE doc_id % 4 WHEN 1 THEN 'COMPLETE' WHEN 2 THEN 'FAILED' ELSE 'RUNNING' END) AS state FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1) l ON l.text = d.text"""


AUDITED = ("F1.1", "F2.2", "F2.3", "F3.1")


def _s12(s: SparkSession, d: str) -> DataFrame:
    """The audit of every company's ratios, written as JSON and read back: inputs, formula, issue."""
    who = table(s, d, "customer").select(F.col("c_custkey").alias("company"))
    rows = variables.export_audit(variables.audit_rows(who, adapters.facts(s, d), AUDITED), f"{shared_dir(s)}/audit-{uuid.uuid4().hex}")
    text = F.transform("inputs", lambda x: F.concat_ws(" ", x["concept"], x["period_end"].cast("string"), x["amount"].cast("string")))
    return rows.select("company", "code", F.array_join(text, "; ").alias("inputs"), "trace", "issue")


def _s12_sql() -> str:
    parts = []
    for code in AUDITED:
        top, less, bottom, _ = variables.RATIOS[code]
        concepts = tuple(c for c in (top, less, bottom) if c)
        inputs = " || '; ' || ".join(f"'{c} ' || period_end || ' ' || v{k}" for k, c in enumerate(concepts))
        trace = f"({top} - {less}) / {bottom}" if less else f"{top} / {bottom}"
        parts.append(f"SELECT r.company, '{code}' AS code, coalesce({inputs}, '') AS inputs, '{trace}' AS trace, reason AS issue FROM ({ratio_sql(code)}) r LEFT JOIN ({periods_sql(concepts)}) p ON p.company = r.company AND p.period_end = r.period_end".replace("' || period_end ||", "' || p.period_end ||"))
    return with_ctes(["facts"], " UNION ALL ".join(parts))


def queries() -> dict[str, Query]:
    q = {
        "S01_page_scan": Query(_s01, "SELECT o_custkey AS company, '$.items[' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || ']' AS json_path, o_orderkey AS id, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS day FROM orders"),
        "S02_page_sequence": Query(_s02, _S02),
        "S03_horizon_filter": Query(_s03, f"SELECT o_custkey AS company, o_orderkey, covered FROM (SELECT *, bool_or(CAST(o_orderdate AS DATE) < ({DAY} - INTERVAL 36 MONTH)::DATE) OVER (PARTITION BY o_custkey) AS covered FROM orders) WHERE CAST(o_orderdate AS DATE) BETWEEN ({DAY} - INTERVAL 36 MONTH)::DATE AND {DAY}"),
        "S04_representation": Query(lambda s, d: E.preferred_representation(_documents(s, d)).select("filing", "document_id", "media"), _S04),
        "S05_checksum": Query(_s05, _S05),
        "S06_object_key": Query(_s06, "SELECT event_id, lpad(user_id::VARCHAR, 8, '0') || '/' || lower(event_type) || '/' || strftime(ts, '%Y%m%dT%H%M%SZ') || '/' || event_id || '/' || sha256(props) || '.json' AS object_key FROM events"),
        "S07_immutable_append": Query(_s07, _S07),
        "S08_page_fact_append": Query(_s08, _S08),
        "S10_snapshot_sink": Query(_s10, _S10),
        "S11_snapshot_status": Query(_s11, _S11),
        "S12_audit_export": Query(_s12, _s12_sql()),
        "J01_eav_filings": Query(_j01, "SELECT o_orderkey AS subject, o_custkey AS company, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderstatus = 'F'"),
        "J02_origin_snapshot": Query(_j02, _J02),
        "J03_snapshot_members": Query(_j03, "SELECT DISTINCT o_custkey AS c_custkey, l_suppkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"),
        "J04_obligation_match": Query(_j04, f"SELECT o_orderkey AS duty, CASE count(l_orderkey) WHEN 0 THEN 'OUTSTANDING' WHEN 1 THEN 'FILED' ELSE 'UNRESOLVED' END AS state FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = o_orderkey % 7 AND l_shipdate <= {DAY} GROUP BY 1"),
        "J05_concept_mapping": Query(_j05, _J05),
        "J06_provenance": Query(_j06, _J06),
        "J07_competing_observations": Query(_j07, "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS rows, count(DISTINCT l_extendedprice) > 1 AS competing FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"),
        "J08_run_pairing": Query(_j08, """SELECT a.o_custkey, a.o_orderkey AS accounts_run, g.o_orderkey AS governance_run, g.o_orderkey IS NOT NULL AS paired
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE k = 1) a
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderpriority = '1-URGENT') WHERE k = 1) g ON a.o_custkey = g.o_custkey"""),
        "J09_freshness": Query(_j09, _J09),
        "J10_interval_containment": Query(_j10, _J10),
        "J11_integrity_audit": Query(_j11, _J11),
        "J12_retention_plan": Query(_j12, _J12),
        "J13_explanation_tree": Query(_j13, _J13),
        "J14_claim_grounding": Query(_j14, _J14),
        "J15_citation_check": Query(_j15, _J15),
        "J16_best_representation": Query(_j16, with_ctes(["facts"], "SELECT company, yr, covered FROM (SELECT company, yr, count(DISTINCT concept) AS covered, row_number() OVER (PARTITION BY company ORDER BY count(DISTINCT concept) DESC, yr DESC) AS k FROM facts GROUP BY 1, 2) WHERE k = 1")),
        "J17_ledger_verdict": Query(_j17, _J17),
    }
    return q
