"""Queries that run the streaming jobs over ``events``, against the same result in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.adapters import table
from ..streaming import jobs
from .base import Query


def _events(s: SparkSession, d: str) -> DataFrame:
    return jobs.table_stream(s, f"{d}/events.parquet", table(s, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))  # event time needs an instant


def _delay(s: SparkSession, d: str, least_days: int) -> str:
    return jobs.whole_span(table(s, d, "events"), "ts", least_days)


def _st1(s: SparkSession, d: str) -> DataFrame:
    once = jobs.process_once(_events(s, d), [F.col("event_type"), F.col("props")], "ts", _delay(s, d, 60), jobs.work_folder(s, "once"))
    return once.select("fingerprint", "event_type")


def _st2(s: SparkSession, d: str) -> DataFrame:
    n = jobs.rolling_counts(_events(s, d).filter("event_type = 'error'"), ["user_id"], "ts", "7 days", "1 day", _delay(s, d, 1), jobs.work_folder(s, "rolling"))
    return n.select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), F.col("count").alias("n"))


def _st2_departures(s: SparkSession, d: str) -> DataFrame:
    """Directors' departures per company in windows of 90 days, one every 30 days."""
    li = table(s, d, "lineitem")
    new = jobs.table_stream(s, f"{d}/lineitem.parquet", li.schema).select(F.col("l_suppkey").alias("company"), F.col("l_shipdate").cast("timestamp").alias("resigned"))
    n = jobs.rolling_counts(new, ["company"], "resigned", "90 days", "30 days", jobs.whole_span(li, "l_shipdate", 1), jobs.work_folder(s, "departures"))
    return n.select("company", F.col("window.start").cast("date").alias("start"), F.col("count").alias("n"))


def _st2_sessions(s: SparkSession, d: str) -> DataFrame:
    """Closed sessions of users: events less than 6 hours apart; what may still go on within a day is not closed."""
    new = jobs.table_stream(s, f"{d}/events.parquet", table(s, d, "events").schema, files_per_batch=None).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found, _ = jobs.sessions(new, ["user_id"], "ts", "6 hours", "1 day", jobs.work_folder(s, "sessions"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), F.col("session_window.end").cast("timestamp_ntz").alias("stop"), F.col("count").alias("n"))


_SESSIONS = """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS stop, count(*) AS n FROM (
  SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (
    SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, true) AS fresh FROM events))
GROUP BY user_id, session HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


def _st3(s: SparkSession, d: str) -> DataFrame:
    return jobs.latest_state(_events(s, d), ["user_id"], ["ts", "event_id"], jobs.work_folder(s, "latest")).select("user_id", "event_id", "event_type")


def queries() -> dict[str, Query]:
    return {
        "ST1_process_once": Query(_st1, "SELECT DISTINCT sha256(CAST(to_json([event_type, props]) AS VARCHAR)) AS fingerprint, event_type FROM events"),
        "ST2_rolling_counts": Query(_st2, "SELECT user_id, start, count(*) AS n FROM (SELECT user_id, date_trunc('day', ts) - INTERVAL 1 DAY * unnest(range(0, 7)) AS start FROM events WHERE event_type = 'error') GROUP BY 1, 2"),
        "ST2_departures_90_days": Query(
            _st2_departures,
            "SELECT company, DATE '1970-01-01' + CAST(30 * (floor((CAST(l_shipdate AS DATE) - DATE '1970-01-01') / 30) - k) AS INTEGER) AS start, count(*) AS n FROM (SELECT l_suppkey AS company, l_shipdate, unnest(range(0, 3)) AS k FROM lineitem) GROUP BY 1, 2",
        ),
        "ST2_sessions": Query(_st2_sessions, _SESSIONS),
        "ST3_latest_state": Query(_st3, "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1"),
    }
