"""Registered queries: unions, reshaping, set differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.operators import serve as S
from terrapanel.operators.window import latest_rows
from terrapanel.plans.catalog import Ctx, query


@query("union_submitted", ("U1", "P21", "ST6"), """
SELECT firm_id, firm_name, entity, sector, scope1, scope2, scope3, readiness_score, gaps_count,
       CAST(firm_id AS VARCHAR) AS record_id, 'official' AS data_quality FROM firms
UNION ALL
SELECT NULL, c_name, n_name, c_mktsegment, NULL, NULL, NULL,
       least(greatest((c_acctbal + 1000) / 110.0, 0.0), 100.0), NULL,
       'USR-' || sha256(CAST(c_custkey AS VARCHAR)), 'user_input'
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'HOUSEHOLD'
""")
def union_submitted(spark, d):
    c = Ctx(spark, d)
    base = c.firms.withColumn("record_id", F.col("firm_id").cast("string")).withColumn("data_quality", F.lit("official"))
    cust = c.t.customer.where(F.col("c_mktsegment") == "HOUSEHOLD")
    sub = cust.join(c.t.nation, cust.c_nationkey == F.col("n_nationkey")).select(
        F.col("c_name").alias("firm_name"), F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("sector"),
        F.least(F.greatest((F.col("c_acctbal") + 1000) / F.lit(110.0), F.lit(0.0)), F.lit(100.0)).alias("readiness_score"),
        S.surrogate_id(F.col("c_custkey")).alias("record_id"), F.lit("user_input").alias("data_quality"))
    return base.unionByName(sub, allowMissingColumns=True)


@query("sankey_edges", ("U4", "W5"), """
WITH lt AS (SELECT * FROM panel WHERE period = (SELECT max(period) FROM panel))
SELECT entity, period, 'share_a_pct' AS source, share_a_pct AS value, 'generation' AS target FROM lt UNION ALL
SELECT entity, period, 'share_b_pct', share_b_pct, 'generation' FROM lt UNION ALL
SELECT entity, period, 'share_c_pct', share_c_pct, 'generation' FROM lt
""")
def sankey_edges(spark, d):
    lt = latest_rows(Ctx(spark, d, shared=("panel",)).panel, "period")
    return S.sankey(lt, ["entity", "period"], ["share_a_pct", "share_b_pct", "share_c_pct"], "generation")


@query("code_differences", ("U5", "J6", "D14"), """
SELECT 'regions_without_nations' AS check_name, r_name AS code FROM region
WHERE r_name NOT IN (SELECT DISTINCT r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)
UNION ALL
SELECT 'nations_without_sites', n_name FROM nation WHERE n_name NOT IN (SELECT DISTINCT entity FROM sites)
UNION ALL
SELECT 'firm_entities_not_in_panel', e FROM (SELECT DISTINCT entity AS e FROM firms) WHERE e NOT IN (SELECT DISTINCT entity FROM panel)
""")
def code_differences(spark, d):
    c = Ctx(spark, d)
    t = c.t
    used = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("r_name")
    parts = [
        S.missing_codes(t.region.select("r_name"), used).select(F.lit("regions_without_nations").alias("check_name"), "code"),
        S.missing_codes(t.nation.select("n_name"), c.sites.select("entity")).select(
            F.lit("nations_without_sites").alias("check_name"), "code"),
        S.missing_codes(c.firms.select("entity"), c.panel.select("entity")).select(
            F.lit("firm_entities_not_in_panel").alias("check_name"), "code"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("radar_latest", ("P23", "W5", "U3"), """
WITH m AS (SELECT *, max(period) OVER (PARTITION BY entity) AS last FROM panel)
SELECT entity, period, axis, value FROM (
  SELECT entity, period, share_a_pct, share_b_pct, share_c_pct FROM m WHERE period = last)
UNPIVOT (value FOR axis IN (share_a_pct, share_b_pct, share_c_pct))
""")
def radar_latest(spark, d):
    """One row for each axis of every entity's radar: its shares in its own latest year."""
    p = Ctx(spark, d, shared=("panel",)).panel
    axes = ["share_a_pct", "share_b_pct", "share_c_pct"]
    lt = latest_rows(p, "period", "entity", mode="per_entity")
    return lt.select("entity", "period", *axes).unpivot(["entity", "period"], axes, "axis", "value").where("value IS NOT NULL")
