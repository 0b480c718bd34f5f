"""The roles that the star-schema tables play in the assessment, as DataFrames and as SQL.

Each ``frame`` has an equal ``CTES`` entry, so that oracles can be written over the same roles.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2000-12-31"
DUE_DAYS = 720
CONCEPTS = ("TOTAL_ASSETS", "CURRENT_ASSETS", "INVENTORY", "CURRENT_LIABILITIES", "NET_ASSETS", "INTEREST_BEARING_DEBT")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.lit(AS_OF).cast("date")


def orders_with_lines(spark: SparkSession, sf_dir: str, amounts: bool = True, state: bool = True) -> DataFrame:
    """Each order (``company``: its customer) with what statements need of its lines (``amounts``) and what obligations do (``state``); null without lines."""
    hundredths = lambda c, digits: (F.col(c).cast(f"decimal({digits},2)") * 100).cast("long").alias(c)
    ext = F.col("l_extendedprice")
    lines, orders, sums = ["l_orderkey"], ["o_orderkey", F.col("o_custkey").alias("company"), "o_orderdate"], []
    if amounts:
        # exact in whole pence and ten-thousandths: sums of longs take a fraction of the memory of decimals, and too large ones are refused
        lines += [hundredths("l_extendedprice", 12), hundredths("l_discount", 4), hundredths("l_tax", 4), "l_returnflag"]
        orders.append("o_totalprice")
        sums += [F.sum(ext).alias("ca"), F.sum(ext * F.col("l_discount")).alias("inv"), F.sum(ext * F.col("l_tax")).alias("cl"), F.sum(F.when(F.col("l_returnflag") == "R", ext)).alias("debt")]
    if state:
        lines.append("l_shipdate")
        orders += ["o_orderstatus", "o_orderpriority"]
        sums.append(F.max("l_shipdate").cast("date").alias("shipped"))
    per_order = table(spark, sf_dir, "lineitem").select(*lines).groupBy("l_orderkey").agg(*sums)
    return table(spark, sf_dir, "orders").select(*orders).join(per_order, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")


def statements(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """One row per company and year with the six amounts; ``orders``: :func:`orders_with_lines`, if kept."""
    joined = orders_with_lines(spark, sf_dir, state=False) if orders is None else orders
    yearly = joined.groupBy("company", F.year("o_orderdate").alias("yr")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(20,4)")).alias("ta"), F.sum("ca").alias("ca"), F.sum("inv").alias("inv"), F.sum("cl").alias("cl"), F.sum("debt").alias("debt")
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal").cast("decimal(12,2)") * 5).alias("na"))
    d = "decimal(20,4)"
    units = lambda c, unit, times=1: (F.col(c).cast("decimal(19,0)") * F.lit(Decimal(unit)) * times).cast(d).alias(c)
    return yearly.join(customer, yearly["company"] == customer["c_custkey"]).select(
        "company", F.col("yr").cast("long").alias("yr"), F.col("ta").cast(d).alias("ta"), units("ca", "0.01"), units("inv", "0.0001", 5), units("cl", "0.0001", 20), F.col("na").cast(d).alias("na"), units("debt", "0.01")
    )


def facts(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """The amounts as facts: ``company, yr, period_end, concept, value``; absent ones have no row."""
    wide = statements(spark, sf_dir, orders)
    pairs = F.array(*(F.struct(F.lit(c).alias("concept"), F.col(x).alias("value")) for c, x in zip(CONCEPTS, ("ta", "ca", "inv", "cl", "na", "debt"), strict=True)))
    return wide.select("company", "yr", F.make_date(F.col("yr").cast("int"), F.lit(12), F.lit(31)).alias("period_end"), F.inline(pairs)).filter("value is not null")


def obligations(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """``company, kind, obligation_id, period, due, filed, state, observed_at``; some have no due date, some filed ones no filing date."""
    o = orders_with_lines(spark, sf_dir, amounts=False) if orders is None else orders
    status = F.col("o_orderstatus")
    state = F.when(status == "F", "FILED").when(status == "O", "OUTSTANDING").otherwise("UNRESOLVED")
    due = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.date_add(F.col("o_orderdate").cast("date"), DUE_DAYS))
    return o.select(
        "company",
        F.when(F.col("o_orderkey") % 2 == 0, "ACCOUNTS").otherwise("CONFIRMATION").alias("kind"),
        F.col("o_orderkey").alias("obligation_id"),
        F.col("o_orderdate").cast("date").alias("period"),
        due.alias("due"),
        F.when(state == "FILED", F.col("shipped")).alias("filed"),
        state.alias("state"),
        F.col("o_orderdate").alias("observed_at"),
    )


def directors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company, person, appointed, resigned``: one row per appointment, in chronological order only."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("appointed"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("company"), "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 10).alias("person"), F.col("l_shipdate").cast("date").alias("resigned"))
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).filter("appointed <= resigned").select("company", "person", "appointed", "resigned")


def controllers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``company, identity, notified, ceased, cessation, statement``: one row per observed controller.

    A user's events of one day are a controller: known by its first one, notified four years before, ceased on the day if
    one of them is an error. A signup that stands alone does not say whether it ended; several are a statement.
    """
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id")
    n = e.groupBy(F.col("user_id").alias("company"), "day").agg(F.min("event_id").alias("identity"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    ceased = F.when(F.col("errors") > 0, F.col("day"))
    cessation = F.when(F.col("errors") > 0, "AVAILABLE").when((F.col("n") == 1) & (F.col("signups") == 1), "NOT_DISCLOSED").otherwise("NOT_APPLICABLE")
    return n.select("company", "identity", F.add_months("day", -48).alias("notified"), ceased.alias("ceased"), cessation.alias("cessation"), ((F.col("signups") == F.col("n")) & (F.col("n") > 1)).alias("statement"))


CTES = {
    "statements": (
        [],
        """SELECT y.company, CAST(y.yr AS BIGINT) AS yr, CAST(ta AS DECIMAL(20,4)) AS ta, CAST(ca AS DECIMAL(20,4)) AS ca, CAST(inv * 5 AS DECIMAL(20,4)) AS inv,
       CAST(cl * 20 AS DECIMAL(20,4)) AS cl, CAST(CAST(c_acctbal AS DECIMAL(12,2)) * 5 AS DECIMAL(20,4)) AS na, CAST(debt AS DECIMAL(20,4)) AS debt
FROM (SELECT o_custkey AS company, year(o_orderdate) AS yr, sum(CAST(o_totalprice AS DECIMAL(20,4))) AS ta, sum(ca) AS ca, sum(inv) AS inv, sum(cl) AS cl, sum(debt) AS debt
      FROM orders LEFT JOIN (
        SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS ca, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(4,2))) AS inv,
               sum(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2))) AS cl, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(12,2)) END) AS debt
        FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey GROUP BY 1, 2) y JOIN customer ON company = c_custkey""",
    ),
    "facts": (
        ["statements"],
        "SELECT * FROM (" + " UNION ALL ".join(f"SELECT company, yr, make_date(yr, 12, 31) AS period_end, '{c}' AS concept, {x} AS value FROM statements" for c, x in zip(CONCEPTS, ("ta", "ca", "inv", "cl", "na", "debt"), strict=True)) + ") WHERE value IS NOT NULL",
    ),
    "obligations": (
        [],
        f"""SELECT o_custkey AS company, CASE WHEN o_orderkey % 2 = 0 THEN 'ACCOUNTS' ELSE 'CONFIRMATION' END AS kind, o_orderkey AS obligation_id, CAST(o_orderdate AS DATE) AS period,
       CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST(o_orderdate AS DATE) + {DUE_DAYS} END AS due, CASE WHEN o_orderstatus = 'F' THEN shipped END AS filed,
       CASE WHEN o_orderstatus = 'F' THEN 'FILED' WHEN o_orderstatus = 'O' THEN 'OUTSTANDING' ELSE 'UNRESOLVED' END AS state, o_orderdate AS observed_at
FROM orders LEFT JOIN (SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS shipped FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""",
    ),
    "directors": (
        [],
        """SELECT l_suppkey AS company, l_orderkey * 10 + l_linenumber % 10 AS person, CAST(o_orderdate AS DATE) AS appointed, CAST(l_shipdate AS DATE) AS resigned
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) <= CAST(l_shipdate AS DATE)""",
    ),
    "controllers": (
        [],
        """SELECT company, identity, CAST(day - INTERVAL 48 MONTH AS DATE) AS notified, CASE WHEN errors > 0 THEN day END AS ceased,
       CASE WHEN errors > 0 THEN 'AVAILABLE' WHEN n = 1 AND signups = 1 THEN 'NOT_DISCLOSED' ELSE 'NOT_APPLICABLE' END AS cessation, signups = n AND n > 1 AS statement
FROM (SELECT user_id AS company, CAST(ts AS DATE) AS day, min(event_id) AS identity, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, count(*) FILTER (event_type = 'signup') AS signups FROM events GROUP BY 1, 2)""",
    ),
}


def with_ctes(names: list[str], body: str, extra: dict[str, tuple[list[str], str]] | None = None) -> str:
    """``body`` under a WITH clause of the named roles and what they need, in order."""
    known = CTES | (extra or {})
    order: list[str] = []

    def visit(n: str) -> None:
        for x in known[n][0]:
            visit(x)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    return "WITH " + ",\n".join(f"{n} AS ({known[n][1]})" for n in order) + "\n" + body
