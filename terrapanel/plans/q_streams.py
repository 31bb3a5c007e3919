"""Registered queries: Structured Streaming jobs over the event, customer and supplier tables.

Each query lands its table in two parts below the shared checkpoint folder and
runs the job once after each, so the second run starts from the checkpoint of the
first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrapanel.plans.catalog import Ctx, query
from terrapanel.registry import Dataset
from terrapanel.session import checkpoint_dir
from terrapanel.sources import publish as P
from terrapanel.streaming import refresh as ST
from terrapanel.streaming.rollup import Rollup, rollup
from terrapanel.streaming.seen import dedupe_across_runs

PARTIES = Dataset(name="parties", key=("party_id",), entity="nation_key")


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


def _halves(ev: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events up to the middle of their days, those after, and those of the first day (sent again with the second half)."""
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    middle = (first + (last - first) / 2).replace(hour=0, minute=0, second=0, microsecond=0)
    day = F.date_trunc("day", F.lit(first))
    return ev.where(F.col("ts") < F.lit(middle)), ev.where(F.col("ts") >= F.lit(middle)), ev.where(F.date_trunc("day", "ts") == day)


def _stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(f"{folder}/land/*")


def _rolled(spark, d) -> Rollup:
    ev = Ctx(spark, d).t.events.select("event_id", "ts", "event_type", "value")
    folder = _folder(spark)
    job = rollup(f"{folder}/out", "ts", ["event_type"], "value")
    before, after, again = _halves(ev)
    for n, part in enumerate((before, after.unionByName(again))):
        part.write.parquet(f"{folder}/land/part={n}")
        job.start(_stream(spark, folder, ev), folder.rsplit("/", 1)[-1]).awaitTermination()
    return job


@query("stream_rollup", ("ST4",), """
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total_value
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY 1, 2
""", views=False)
def stream_rollup(spark, d):
    """Closed hourly windows after two runs; the second also gets the first day's events again, which come too late."""
    return _rolled(spark, d).windows(spark)


@query("stream_late_rows", ("ST4",), """
SELECT event_id, ts, event_type, value FROM events WHERE date_trunc('day', ts) = (SELECT date_trunc('day', min(ts)) FROM events)
""", views=False)
def stream_late_rows(spark, d):
    return _rolled(spark, d).late(spark)


@query("stream_dedupe", ("ST3",), """
SELECT event_id, ts, event_type, value FROM events
""", views=False)
def stream_dedupe(spark, d):
    """All events once, though the second run sends the first day's again, two weeks behind any watermark."""
    ev = Ctx(spark, d).t.events.select("event_id", "ts", "event_type", "value")
    folder = _folder(spark)

    def sink(new: DataFrame, batch_id: int) -> None:
        new.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    before, after, again = _halves(ev)
    for n, part in enumerate((before, after.unionByName(again))):
        part.write.parquet(f"{folder}/land/part={n}")
        dedupe_across_runs(_stream(spark, folder, ev), f"{folder}/seen", ["event_id"], sink, folder.rsplit("/", 1)[-1], "ts").awaitTermination()
    return spark.read.schema(ev.schema).parquet(f"{folder}/out").select(*ev.columns)


def _parties(spark, d) -> str:
    t, folder = Ctx(spark, d).t, _folder(spark)
    customer = t.customer.select(F.col("c_custkey").alias("party_id"), F.col("c_nationkey").alias("nation_key"), F.col("c_acctbal").alias("balance"))
    supplier = t.supplier.select(F.col("s_suppkey").alias("form"), F.col("s_nationkey").alias("nation_key"))
    rich = F.col("balance") > 0
    for n, (main, sub) in enumerate(((customer.where(rich), supplier), (customer.where(~rich), supplier))):
        main.write.parquet(f"{folder}/main/part={n}")
        sub.write.parquet(f"{folder}/sub/part={n}")
        ST.collect_sources(spark.readStream.schema(customer.schema).parquet(f"{folder}/main/*"), spark.readStream.schema(supplier.schema).parquet(f"{folder}/sub/*"),
                           f"{folder}/out", PARTIES, id_from="form", name=folder.rsplit("/", 1)[-1]).awaitTermination()
    return f"{folder}/out"


@query("stream_submissions", ("ST6", "P21"), """
SELECT c_custkey::VARCHAR AS party_id, c_nationkey AS nation_key, c_acctbal AS balance, 'official' AS data_quality FROM customer
UNION ALL
SELECT 'USR-' || sha256(s_suppkey::VARCHAR), s_nationkey, NULL, 'user_input' FROM supplier
""", views=False)
def stream_submissions(spark, d):
    """Customers in two parts and suppliers' forms, sent twice, through one query into one table."""
    return P.read_current(spark, _parties(spark, d), PARTIES).select("party_id", "nation_key", "balance", "data_quality")


@query("stream_sources", ("ST5", "ST6"), """
SELECT batch_id::BIGINT AS batch_id, source, "rows" FROM (
  SELECT 0 AS batch_id, 'official' AS source, count(*) AS "rows" FROM customer WHERE c_acctbal > 0
  UNION ALL SELECT 1, 'official', count(*) FROM customer WHERE NOT c_acctbal > 0
  UNION ALL SELECT 0, 'user_input', count(*) FROM supplier
  UNION ALL SELECT 1, 'user_input', count(*) FROM supplier) WHERE "rows" > 0
""", views=False)
def stream_sources(spark, d):
    fresh = spark.read.parquet(f"{_parties(spark, d)}/_sources")
    return fresh.select("batch_id", "source", "rows")
