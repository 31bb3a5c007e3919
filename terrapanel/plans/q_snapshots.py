"""Registered queries: publishing through the bucketed snapshot store.

Each query publishes into a fresh folder of the shared checkpoint directory and
returns what a reader of the store then sees.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from terrapanel.plans.catalog import Ctx, query
from terrapanel.registry import NONNEG, TOL_FIRMS, Bound, Dataset
from terrapanel.session import checkpoint_dir
from terrapanel.sources import publish as P

ORDERS = Dataset(name="orders", key=("o_orderkey",), entity="o_custkey")
#: Running totals of each customer: a table whose values move from load to load.
ACCOUNTS = Dataset(name="accounts", key=("custkey",), entity="custkey", required=("spend", "orders"), int_cols=("orders",),
                   bounds={"spend": NONNEG, "orders": NONNEG}, check_cols=("spend", "orders"), tolerance=TOL_FIRMS)
#: Single purchases under the customer's key: several rows a key, and a bound that the largest break.
PURCHASES = Dataset(name="purchases", key=("custkey",), entity="custkey", required=("spend", "status"),
                    bounds={"spend": Bound(0.0, 490_000.0)})


def _root(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/published/{uuid.uuid4().hex}"


@query("snapshot_upsert", ("ST2", "S13", "S14"), """
WITH m AS (SELECT date_trunc('month', max(o_orderdate)) AS newest FROM orders)
SELECT o_orderkey, o_custkey, CASE WHEN o_orderdate >= newest - INTERVAL 1 MONTH THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
       o_totalprice, o_orderpriority
FROM orders, m
""", views=False)
def snapshot_upsert(spark, d):
    """All orders before the newest month are published; the last two months, pulled again as finished, are upserted."""
    o = Ctx(spark, d).t.orders
    newest = F.date_trunc("month", F.lit(o.agg(F.max("o_orderdate")).first()[0]))
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    root = _root(spark)
    P.write_snapshot(o.where(F.col("o_orderdate") < newest).select(*cols), root, ORDERS, "first")
    pulled = o.where(F.col("o_orderdate") >= newest - F.expr("INTERVAL 1 MONTH")).withColumn("o_orderstatus", F.lit("F"))
    P.upsert_snapshot(pulled.select(*cols), root, ORDERS, "again")
    return P.read_current(spark, root, ORDERS)


def _accounts(o, years_back: int):
    last = F.lit(o.agg(F.max(F.year("o_orderdate"))).first()[0] - years_back)
    return (o.where(F.year("o_orderdate") <= last).groupBy(F.col("o_custkey").alias("custkey"))
             .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("spend"), F.count(F.lit(1)).alias("orders")))


ACCOUNTS_SQL = """
WITH y AS (SELECT max(year(o_orderdate)) AS last FROM orders),
now AS (SELECT o_custkey AS custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend, count(*) AS orders FROM orders GROUP BY 1),
before AS (SELECT o_custkey AS custkey, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS spend, count(*) AS orders
           FROM orders, y WHERE year(o_orderdate) < last GROUP BY 1),
j AS (SELECT n.*, b.spend AS b_spend, b.orders AS b_orders,
             coalesce(b.spend <> 0 AND abs(n.spend - b.spend) / abs(b.spend) > 0.3, false) AS f_spend,
             coalesce(abs(n.orders - b.orders) / abs(b.orders) > 0.3, false) AS f_orders
      FROM now n LEFT JOIN before b USING (custkey))
"""


def _published_accounts(spark, d) -> str:
    o, root = Ctx(spark, d).t.orders, _root(spark)
    P.write_snapshot(_accounts(o, 1), root, ACCOUNTS, "before")
    P.publish(_accounts(o, 0), root, ACCOUNTS, "now")
    return root


@query("snapshot_reconcile", ("V3", "J3", "J5", "V4", "S13"), f"""{ACCOUNTS_SQL.strip()}
SELECT custkey, CASE WHEN f_spend OR f_orders THEN b_spend ELSE spend END AS spend,
       CASE WHEN f_spend OR f_orders THEN b_orders ELSE orders END AS orders FROM j
""", views=False)
def snapshot_reconcile(spark, d):
    return P.read_current(spark, _published_accounts(spark, d), ACCOUNTS)


@query("snapshot_withheld", ("V4", "O3", "D17"), f"""{ACCOUNTS_SQL.strip()}
SELECT custkey, spend, orders, 'withheld:' || array_to_string(list_filter([CASE WHEN f_spend THEN 'spend' END, CASE WHEN f_orders THEN 'orders' END],
       lambda x: x IS NOT NULL), ',') AS reason, 1::BIGINT AS copies
FROM j WHERE f_spend OR f_orders
""", views=False)
def snapshot_withheld(spark, d):
    out = P.read_rejects(spark, _published_accounts(spark, d), ACCOUNTS)
    return out.select(F.from_json("row", "custkey long, spend double, orders long").alias("r"), "reason", "copies").select("r.*", "reason", "copies")


@query("snapshot_rejects", ("D17", "V1", "S13"), """
WITH p AS (SELECT o_custkey AS custkey, o_totalprice AS spend, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL),
v AS (SELECT *, row_number() OVER (PARTITION BY custkey ORDER BY spend DESC, status DESC) AS r FROM p WHERE spend <= 490000)
SELECT custkey, spend, status, 'duplicate_key' AS reason, CASE WHEN r = 1 THEN n - 1 ELSE n END AS copies FROM v WHERE r > 1 OR n > 1
UNION ALL
SELECT custkey, spend, status, 'contract:spend:above_max', n FROM p WHERE spend > 490000
""", views=False)
def snapshot_rejects(spark, d):
    o, root = Ctx(spark, d).t.orders, _root(spark)
    load = o.select(F.col("o_custkey").alias("custkey"), F.col("o_totalprice").alias("spend"), F.col("o_orderstatus").alias("status"))
    P.publish(load, root, PURCHASES, "first")
    out = P.read_rejects(spark, root, PURCHASES)
    r = out.select(F.from_json("row", "custkey long, spend double, status string").alias("r"), "reason", "copies")
    return r.groupBy("r.custkey", "r.spend", "r.status", "reason").agg(F.sum("copies").alias("copies"))
