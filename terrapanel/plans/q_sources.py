"""Registered queries: stream batch twins and time rules over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.plans.catalog import Ctx, query
from terrapanel.sources.files import STAMP_SPARK
from terrapanel.streaming.refresh import hourly_rollup

AS_OF_DATE = "2024-02-15"   # fixed "today" so results are stable (F9)
FRESH_DAYS = 365


@query("events_hourly", ("ST4",), """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total_value
FROM events GROUP BY 1, 2
""")
def events_hourly(spark, d):
    ev = Ctx(spark, d).t.events.select("ts", "event_type", "value")
    return hourly_rollup(ev, "ts", ["event_type"], "value", watermark=None)


@query("events_freshness", ("D8", "F9", "ST5"), f"""
SELECT event_type, max(ts) AS newest, CAST(date_diff('day', CAST(max(ts) AS DATE), DATE '{AS_OF_DATE}') AS INT) AS age_days,
       date_diff('day', CAST(max(ts) AS DATE), DATE '{AS_OF_DATE}') < {FRESH_DAYS} AS fresh
FROM events GROUP BY event_type
""")
def events_freshness(spark, d):
    ev = Ctx(spark, d).t.events
    g = ev.groupBy("event_type").agg(F.max("ts").alias("newest"))
    age = F.datediff(F.lit(AS_OF_DATE).cast("date"), F.col("newest").cast("date"))
    return g.select("event_type", "newest", age.cast("int").alias("age_days"), (age < FRESH_DAYS).alias("fresh"))


@query("stamp_check", ("D13", "F9"), """
WITH s AS (SELECT event_type, strftime(ts, '%Y%m%dT%H%M%SZ') AS stamp FROM events),
p AS (SELECT event_type, stamp, try_strptime(stamp, '%Y%m%dT%H%M%SZ') AS parsed FROM s)
SELECT event_type, count(*) AS stamps, CAST(SUM(CASE WHEN parsed IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS parsed_ok,
       CAST(SUM(CASE WHEN parsed IS NOT NULL AND year(parsed) >= 2020 THEN 1 ELSE 0 END) AS BIGINT) AS recent_ok
FROM p GROUP BY event_type
""")
def stamp_check(spark, d):
    ev = Ctx(spark, d).t.events
    s = ev.select("event_type", F.date_format("ts", STAMP_SPARK).alias("stamp"))
    p = s.withColumn("parsed", F.try_to_timestamp("stamp", F.lit(STAMP_SPARK)))
    return p.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("stamps"),
        F.sum(F.col("parsed").isNotNull().cast("long")).alias("parsed_ok"),
        F.sum((F.col("parsed").isNotNull() & (F.year("parsed") >= 2020)).cast("long")).alias("recent_ok"))
