"""Event backlogs: overlapping slices, open and overdue events, reminders with cool-down, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.backlog import due_reminders, in_flight, overdue, quiet, sliced
from plumbline.sources.tables import table

#: The moment that the queries take as now; a parameter.
NOW = "2024-01-20 06:00:00"


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def _now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW))


def sliced_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events per slice of 12 hours that overlaps the next by ten minutes, and distinct events."""
    s = sliced(_events(spark, sf), "ts", "12 hours", "12 hours 10 minutes")
    return s.groupBy(F.date_format("slice.start", "yyyy-MM-dd HH:mm").alias("slice_start")).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("n_distinct"))


def events_once(spark: SparkSession, sf: str) -> DataFrame:
    """Every event once, however many slices it fell into, by type."""
    s = sliced(_events(spark, sf), "ts", "12 hours", "12 hours 10 minutes").select("event_id", "event_type").dropDuplicates(["event_id"])
    return s.groupBy("event_type").agg(F.count("*").alias("n"))


def overdue_events(spark: SparkSession, sf: str) -> DataFrame:
    """Open events of the last week that are more than 8 hours old, oldest first, with their age in whole hours."""
    o = overdue(in_flight(_events(spark, sf), F.col("event_type"), ["click", "view"]), "ts", _now(), hours=8, look_back="7 days")
    return o.orderBy("ts", "event_id").select("event_id", "event_type", "age_hours")


def reminders(spark: SparkSession, sf: str) -> DataFrame:
    """Overdue events whose user was not reminded within 8 hours; a user's purchases stand for reminders sent."""
    e = _events(spark, sf)
    state = e.where((F.col("event_type") == "purchase") & (F.col("ts") <= _now())).groupBy("user_id").agg(F.max("ts").alias("last_reminded"))
    o = overdue(in_flight(e, F.col("event_type"), ["click", "view"]), "ts", _now(), hours=8, look_back="7 days")
    return due_reminders(o, state, "user_id", _now(), hours=8).select("event_id", "user_id", quiet(_now()).alias("quiet"))


def backlog_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Events, open ones, overdue ones and reminders due."""
    e = _events(spark, sf)
    opened = in_flight(e, F.col("event_type"), ["click", "view"])
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    return one("events", e).unionByName(one("open", opened)).unionByName(one("overdue", overdue_events(spark, sf))).unionByName(one("due", reminders(spark, sf)))


def event_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The value under k of each event's JSON, by type."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf).groupBy("event_type").agg(F.sum(k).alias("sum_k"), F.count_if(k.isNull()).alias("without_k"))


def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions of a user that end after 30 minutes without event (an extension)."""
    s = _events(spark, sf).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_OPEN = "SELECT * FROM events WHERE event_type IN ('click', 'view')"
_OVERDUE = f"SELECT * FROM ({_OPEN}) WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{NOW}' - INTERVAL 8 HOUR"
_SLICES = """SELECT event_id, event_type, time_bucket(INTERVAL 12 HOUR, ts) AS s FROM events
UNION ALL SELECT event_id, event_type, time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR FROM events WHERE ts < time_bucket(INTERVAL 12 HOUR, ts) + INTERVAL 10 MINUTE"""
_REMIND = f"SELECT event_id, user_id, false AS quiet FROM ({_OVERDUE}) o WHERE NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = o.user_id AND p.event_type = 'purchase' AND p.ts <= TIMESTAMP '{NOW}' AND p.ts > TIMESTAMP '{NOW}' - INTERVAL 8 HOUR)"
SQL = {
    "sliced_events": f"SELECT strftime(s, '%Y-%m-%d %H:%M') AS slice_start, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM ({_SLICES}) GROUP BY 1",
    "events_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "overdue_events": f"SELECT event_id, event_type, CAST(floor(epoch(TIMESTAMP '{NOW}' - ts) / 3600) AS BIGINT) AS age_hours FROM ({_OVERDUE})",
    "reminders": _REMIND,
    "backlog_counts": f"SELECT 'events' AS counter, count(*) AS n FROM events UNION ALL SELECT 'open', count(*) FROM ({_OPEN}) UNION ALL SELECT 'overdue', count(*) FROM ({_OVERDUE}) UNION ALL SELECT 'due', count(*) FROM ({_REMIND})",
    "event_keys": "SELECT event_type, CAST(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) FILTER (try_cast(json_extract_string(props, '$.k') AS BIGINT) IS NULL) AS without_k FROM events GROUP BY 1",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT user_id, sum(starts) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL)
      SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (sliced_events, events_once, overdue_events, reminders, backlog_counts, event_keys, user_sessions)}
