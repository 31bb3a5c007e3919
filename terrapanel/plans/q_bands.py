"""Registered queries: membership filters, banding, null defaults, left-join-and-drop."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.bands import READINESS_CUT, gauge_band, risk_band, traffic_light
from terrapanel.plans.catalog import Ctx, query

# Fixed parameter of the membership query (the allowed-entity list a caller passes).
MEMBER_ENTITIES = ["NATION_0", "NATION_7", "NATION_24"]


@query("entity_membership", ("P10",), """
SELECT * FROM panel WHERE entity IN ('NATION_0', 'NATION_7', 'NATION_24')
""")
def entity_membership(spark, d):
    # a literal IN list: pushed to the orders scan's join side as a filter on the
    # small nation dimension, so the big fact scan is pruned by the join itself
    return Ctx(spark, d).panel.where(F.col("entity").isin(MEMBER_ENTITIES))


@query("site_bands", ("P17", "P18"), """
SELECT entity, site, composite_score,
  CASE WHEN composite_score IS NULL THEN NULL WHEN composite_score < 4 THEN 'Low'
       WHEN composite_score < 7 THEN 'Medium' ELSE 'High' END AS risk_level,
  CASE WHEN composite_score IS NULL THEN NULL WHEN composite_score > 7 THEN 'red'
       WHEN composite_score > 4 THEN 'amber' ELSE 'green' END AS light
FROM sites
""")
def site_bands(spark, d):
    s = Ctx(spark, d).sites
    return s.select("entity", "site", "composite_score",
                    risk_band("composite_score", right_closed=False).alias("risk_level"),
                    traffic_light("composite_score").alias("light"))


@query("firm_gauge", ("P18", "F10"), f"""
WITH g AS (
  SELECT f.firm_id, f.entity, f.readiness_score,
         CASE WHEN f.readiness_score IS NULL THEN NULL WHEN f.readiness_score < 40 THEN 'low'
              WHEN f.readiness_score < 70 THEN 'medium' ELSE 'high' END AS gauge
  FROM firms f)
SELECT firm_id, entity, coalesce(gauge, 'n/a') AS gauge,
       CASE WHEN readiness_score < {READINESS_CUT} THEN 'act' ELSE 'ok' END AS advice,
       coalesce(readiness_score, 0.0) AS readiness_or_zero
FROM g
""")
def firm_gauge(spark, d):
    f = Ctx(spark, d).firms
    return f.select("firm_id", "entity",
                    F.coalesce(gauge_band("readiness_score"), F.lit("n/a")).alias("gauge"),
                    F.when(F.col("readiness_score") < READINESS_CUT, "act").otherwise("ok").alias("advice"),
                    F.coalesce(F.col("readiness_score"), F.lit(0.0)).alias("readiness_or_zero"))


@query("firms_with_orders", ("J4",), """
WITH t AS (SELECT o_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY o_custkey)
SELECT c.c_custkey AS firm_id, c.c_mktsegment AS sector, t.total
FROM customer c LEFT JOIN t ON t.o_custkey = c.c_custkey
WHERE t.total IS NOT NULL
""", views=False)
def firms_with_orders(spark, d):
    t = Ctx(spark, d).t
    totals = (t.orders.groupBy("o_custkey")
               .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")))
    c = t.customer.select("c_custkey", "c_mktsegment")
    # left join then drop the unmatched: Catalyst turns this into an inner join,
    # and the per-customer totals are aggregated (map-side) before the join
    j = c.join(totals, c.c_custkey == totals.o_custkey, "left").na.drop(subset=["total"])
    return j.select(F.col("c_custkey").alias("firm_id"), F.col("c_mktsegment").alias("sector"), "total")


@query("table_row_counts", ("A8",), """
SELECT 'orders' AS tbl, CAST(count(*) AS BIGINT) AS n FROM orders
UNION ALL SELECT 'lineitem', CAST(count(*) AS BIGINT) FROM lineitem
UNION ALL SELECT 'customer', CAST(count(*) AS BIGINT) FROM customer
UNION ALL SELECT 'supplier', CAST(count(*) AS BIGINT) FROM supplier
""", views=False)
def table_row_counts(spark, d):
    t = Ctx(spark, d).t
    parts = [getattr(t, name).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
             .select(F.lit(name).alias("tbl"), "n")
             for name in ("orders", "lineitem", "customer", "supplier")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
