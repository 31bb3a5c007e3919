"""Driver views: the three reporting datasets re-derived from the base tables.

* ``panel``  (entity, period) yearly measures      ~ country CO2/energy panel
* ``sites``  (entity, site) 0..10 scores            ~ regional climate risk
* ``firms``  (firm_id) scope totals and readiness   ~ company disclosures

Plan shapes: ``panel`` joins orders to its dimensions and aggregates once into
(entity, period); ``firms`` aggregates orders per customer *before* the
customer join (ten orders per customer collapse map-side, and the aggregate is
already partitioned on the join key).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrapanel.sources.tables import Tables

DEC = "decimal(18,2)"


def _years(lo: int | None, hi: int | None):
    """Order dates of the years ``lo`` to ``hi`` (None or 0: open), as bounds the scan can use."""
    cond = F.lit(True)
    if lo:
        cond = cond & (F.col("o_orderdate") >= F.lit(f"{lo:04d}-01-01").cast("date"))
    if hi:
        cond = cond & (F.col("o_orderdate") < F.lit(f"{hi + 1:04d}-01-01").cast("date"))
    return cond


def panel(t: Tables, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """orders ⋈ customer ⋈ nation, then one aggregate to (entity, period).

    The dimension joins are planned by size: below the broadcast threshold the
    whole view is one stage (scan → two hash joins → partial aggregate) and only
    the 175-group partial states are exchanged; above it, orders ⋈ customer is a
    sort-merge join on the customer key where AQE splits a hot customer.  A range
    of years becomes bounds on the order date, which the scan prunes by.
    """
    o = t.orders.where(_years(lo, hi)).select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    cust = t.customer.select("c_custkey", "c_nationkey")
    nat = t.nation.select("n_nationkey", F.col("n_name").alias("entity"))
    j = (o.join(cust, o.o_custkey == cust.c_custkey)
          .join(nat, F.col("c_nationkey") == nat.n_nationkey))
    g = j.groupBy("entity", F.year("o_orderdate").cast("int").alias("period")).agg(
        F.sum(F.col("o_totalprice").cast(DEC)).alias("amount"),
        F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("n_f"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("n_o"),
        F.sum(F.when(F.col("o_orderstatus") == "P", 1).otherwise(0)).alias("n_p"),
        F.count(F.lit(1)).alias("n"))
    return g.select(
        "entity", "period",
        (F.col("amount").cast("double") / F.lit(1e6)).alias("level_mt"),
        (F.lit(100.0) * F.col("n_f") / F.col("n")).alias("share_a_pct"),
        (F.lit(100.0) * F.col("n_o") / F.col("n")).alias("share_b_pct"),
        (F.lit(100.0) * F.col("n_p") / F.col("n")).alias("share_c_pct"),
        F.col("n").cast("bigint").alias("volume"))


def sites(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    nat = t.nation.select("n_nationkey", F.col("n_name").alias("entity"))
    phys = F.least(F.greatest(F.col("s_acctbal") / F.lit(1000.0), F.lit(0.0)), F.lit(10.0))
    trans = (F.col("s_suppkey") % 101) / F.lit(10.1)
    return (s.join(nat, s.s_nationkey == nat.n_nationkey)
             .select("entity", F.col("s_name").alias("site"),
                     phys.alias("physical_score"), trans.alias("transition_score"),
                     ((F.col("s_suppkey") % 37) / F.lit(3.7)).alias("flood_score"),
                     ((F.col("s_suppkey") % 53) / F.lit(5.3)).alias("heat_score"),
                     F.round((phys + trans) / 2, 1).alias("composite_score")))


def firms(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    amt = F.col("o_totalprice").cast(DEC)
    zero = F.lit(0).cast(DEC)
    p1 = F.col("o_orderpriority").startswith("1")
    p2 = F.col("o_orderpriority").startswith("2")
    per_cust = o.groupBy("o_custkey").agg(
        F.sum(F.when(p1, amt).otherwise(zero)).alias("s1"),
        F.sum(F.when(p2, amt).otherwise(zero)).alias("s2"),
        F.sum(F.when(~p1 & ~p2, amt).otherwise(zero)).alias("s3"),
        F.sum(F.when(F.col("o_orderstatus") == "O", 1).otherwise(0)).alias("gaps"))
    cust = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    nat = t.nation.select("n_nationkey", F.col("n_name").alias("entity"))
    j = (cust.join(nat, cust.c_nationkey == nat.n_nationkey)
             .join(per_cust, cust.c_custkey == per_cust.o_custkey, "left"))
    return j.select(
        F.col("c_custkey").alias("firm_id"), F.col("c_name").alias("firm_name"), "entity",
        F.col("c_mktsegment").alias("sector"),
        F.coalesce(F.col("s1"), zero).cast("double").alias("scope1"),
        F.coalesce(F.col("s2"), zero).cast("double").alias("scope2"),
        F.coalesce(F.col("s3"), zero).cast("double").alias("scope3"),
        F.least(F.greatest((F.col("c_acctbal") + 1000) / F.lit(110.0), F.lit(0.0)), F.lit(100.0))
         .alias("readiness_score"),
        F.coalesce(F.col("gaps"), F.lit(0)).cast("int").alias("gaps_count"))


# DuckDB text of the same views; every oracle query is built on these CTEs.
PANEL_SQL = """
SELECT n.n_name AS entity, CAST(year(o.o_orderdate) AS INT) AS period,
  CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / 1e6 AS level_mt,
  100.0 * SUM(CASE WHEN o.o_orderstatus='F' THEN 1 ELSE 0 END) / COUNT(*) AS share_a_pct,
  100.0 * SUM(CASE WHEN o.o_orderstatus='O' THEN 1 ELSE 0 END) / COUNT(*) AS share_b_pct,
  100.0 * SUM(CASE WHEN o.o_orderstatus='P' THEN 1 ELSE 0 END) / COUNT(*) AS share_c_pct,
  CAST(COUNT(*) AS BIGINT) AS volume
FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey
GROUP BY n.n_name, year(o.o_orderdate)"""

SITES_SQL = """
SELECT n.n_name AS entity, s.s_name AS site,
  least(greatest(s.s_acctbal/1000.0,0.0),10.0) AS physical_score,
  (s.s_suppkey % 101)/10.1 AS transition_score, (s.s_suppkey % 37)/3.7 AS flood_score,
  (s.s_suppkey % 53)/5.3 AS heat_score,
  round((least(greatest(s.s_acctbal/1000.0,0.0),10.0)+(s.s_suppkey % 101)/10.1)/2,1) AS composite_score
FROM supplier s JOIN nation n ON s.s_nationkey=n.n_nationkey"""

FIRMS_SQL = """
SELECT c.c_custkey AS firm_id, c.c_name AS firm_name, n.n_name AS entity, c.c_mktsegment AS sector,
  CAST(SUM(CASE WHEN o.o_orderpriority LIKE '1%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS scope1,
  CAST(SUM(CASE WHEN o.o_orderpriority LIKE '2%' THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS scope2,
  CAST(SUM(CASE WHEN o.o_orderpriority NOT LIKE '1%' AND o.o_orderpriority NOT LIKE '2%'
           THEN CAST(o.o_totalprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS scope3,
  least(greatest((c.c_acctbal+1000)/110.0,0.0),100.0) AS readiness_score,
  CAST(SUM(CASE WHEN o.o_orderstatus='O' THEN 1 ELSE 0 END) AS INT) AS gaps_count
FROM customer c JOIN nation n ON c.c_nationkey=n.n_nationkey LEFT JOIN orders o ON o.o_custkey=c.c_custkey
GROUP BY c.c_custkey, c.c_name, n.n_name, c.c_mktsegment, c.c_acctbal"""

VIEWS_SQL = f"panel AS ({PANEL_SQL}),\nsites AS ({SITES_SQL}),\nfirms AS ({FIRMS_SQL})"


def with_views(body: str) -> str:
    """Prefix an oracle query with the three view CTEs (DuckDB)."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {VIEWS_SQL},\n{body[5:]}"
    return f"WITH {VIEWS_SQL}\n{body}"
