"""Registered queries: KPI tables, cleaning, rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.bands import risk_band
from terrapanel.operators import clean as C
from terrapanel.operators import kpi as K
from terrapanel.operators.window import latest_rows
from terrapanel.plans.catalog import Ctx, query
from terrapanel.plans.landing import RAW_PANEL_SQL, RAW_SITES_SQL, raw_panel, raw_sites
from terrapanel.registry import PANEL, SITES

FLAGSHIP_SQL = """
WITH latest AS (SELECT max(period) AS p FROM panel),
     r AS (SELECT entity, avg(composite_score) AS avg_risk FROM sites GROUP BY entity),
     f AS (SELECT entity, avg(readiness_score) AS avg_readiness FROM firms GROUP BY entity)
SELECT panel.entity, period, level_mt, share_a_pct, round(avg_risk,6) AS avg_risk,
       round(avg_readiness,6) AS avg_readiness
FROM panel JOIN latest ON period = p JOIN r USING (entity) JOIN f USING (entity)
"""


@query("country_summary", ("J2", "A1", "A2", "W5", "S10"), FLAGSHIP_SQL)
def country_summary(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    return K.country_summary(c.panel, c.sites, c.firms, latest="global")


@query("country_summary_own_latest", ("J2", "W5"), """
WITH latest AS (SELECT entity, max(period) AS p FROM panel GROUP BY entity),
     r AS (SELECT entity, avg(composite_score) AS avg_risk FROM sites GROUP BY entity),
     f AS (SELECT entity, avg(readiness_score) AS avg_readiness FROM firms GROUP BY entity)
SELECT panel.entity, period, level_mt, share_a_pct, round(avg_risk,6) AS avg_risk,
       round(avg_readiness,6) AS avg_readiness
FROM panel JOIN latest ON panel.entity = latest.entity AND period = p
     JOIN r ON r.entity = panel.entity JOIN f ON f.entity = panel.entity
""")
def country_summary_own_latest(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    return K.country_summary(c.panel, c.sites, c.firms, latest="per_entity")


@query("panel_kpi", ("P1", "O1"), """
SELECT entity, period, level_mt, share_a_pct, volume FROM panel
""")
def panel_kpi(spark, d):
    return Ctx(spark, d).panel.select("entity", "period", "level_mt", "share_a_pct", "volume") \
        .orderBy("entity", "period")


@query("firm_scope_totals", ("P1", "P2"), """
SELECT firm_id, entity, sector, scope1, scope2, scope3, scope1 + scope2 + scope3 AS total FROM firms
""")
def firm_scope_totals(spark, d):
    f = Ctx(spark, d).firms
    return f.select("firm_id", "entity", "sector", "scope1", "scope2", "scope3",
                    (F.col("scope1") + F.col("scope2") + F.col("scope3")).alias("total"))


CLEAN_PANEL_SQL = f"""
WITH {RAW_PANEL_SQL.strip()},
c AS (
  SELECT upper(regexp_replace(entity, '^\\s+|\\s+$', '', 'g')) AS entity, period,
         TRY_CAST(level_txt AS DOUBLE) AS level_mt,
         CASE WHEN share_a_pct IS NULL OR isnan(share_a_pct) THEN NULL ELSE least(greatest(share_a_pct, 0.0), 100.0) END AS share_a_pct,
         CASE WHEN share_b_pct IS NULL OR isnan(share_b_pct) THEN NULL ELSE least(greatest(share_b_pct, 0.0), 100.0) END AS share_b_pct,
         CASE WHEN share_c_pct IS NULL OR isnan(share_c_pct) THEN NULL ELSE least(greatest(share_c_pct, 0.0), 100.0) END AS share_c_pct,
         volume, _batch, _row_seq
  FROM raw_panel),
d AS (SELECT * FROM c WHERE entity IS NOT NULL AND period IS NOT NULL AND level_mt IS NOT NULL AND share_a_pct IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY _batch DESC, _row_seq DESC) AS rn FROM d)
SELECT entity, period, level_mt, share_a_pct, share_b_pct, share_c_pct, volume FROM r WHERE rn = 1
"""


@query("panel_clean", ("P4", "P5", "P6", "P9", "P19", "W1", "A16"), CLEAN_PANEL_SQL)
def panel_clean(spark, d):
    raw = raw_panel(Ctx(spark, d, shared=("panel",)).panel)
    return C.clean(raw, PANEL, numeric_text={"level_txt": "level_mt"})


@query("panel_clean_silver", ("P4", "P7", "P9", "W1"), f"""
WITH {RAW_PANEL_SQL.strip()},
c AS (
  SELECT upper(regexp_replace(entity, '^\\s+|\\s+$', '', 'g')) AS entity, period,
         TRY_CAST(level_txt AS DOUBLE) AS level_mt,
         least(greatest(share_a_pct, 0.0), 100.0) AS share_a_pct,
         least(greatest(share_b_pct, 0.0), 100.0) AS share_b_pct,
         least(greatest(share_c_pct, 0.0), 100.0) AS share_c_pct,
         volume, _batch, _row_seq
  FROM raw_panel),
d AS (SELECT * FROM c WHERE entity IS NOT NULL AND period IS NOT NULL AND level_mt IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, period ORDER BY _batch DESC, _row_seq DESC) AS rn FROM d)
SELECT entity, period, level_mt, share_a_pct, share_b_pct, share_c_pct, volume FROM r WHERE rn = 1
""")
def panel_clean_silver(spark, d):
    raw = raw_panel(Ctx(spark, d, shared=("panel",)).panel)
    return C.clean(raw, PANEL, numeric_text={"level_txt": "level_mt"}, null_as_lower=True,
                   dropna=("entity", "period", "level_mt"))


@query("sites_clean", ("P4", "P6", "P8", "P9"), f"""
WITH {RAW_SITES_SQL.strip()}
SELECT upper(regexp_replace(entity, '^\\s+|\\s+$', '', 'g')) AS entity,
       regexp_replace(site, '^\\s+|\\s+$', '', 'g') AS site,
       least(greatest(physical_score, 0.0), 10.0) AS physical_score,
       least(greatest(transition_score, 0.0), 10.0) AS transition_score,
       least(greatest(flood_score, 0.0), 10.0) AS flood_score,
       least(greatest(heat_score, 0.0), 10.0) AS heat_score,
       least(greatest(composite_score, 0.0), 10.0) AS composite_score
FROM raw_sites
""")
def sites_clean(spark, d):
    raw = raw_sites(Ctx(spark, d).sites)
    return C.clean(raw, SITES, order_by=())


@query("scope_by_sector", ("A3",), """
SELECT sector,
  CAST(SUM(CAST(scope1 AS DECIMAL(38,6))) AS DOUBLE) AS sum_scope1,
  CAST(SUM(CAST(scope2 AS DECIMAL(38,6))) AS DOUBLE) AS sum_scope2,
  CAST(SUM(CAST(scope3 AS DECIMAL(38,6))) AS DOUBLE) AS sum_scope3
FROM firms GROUP BY sector
""")
def scope_by_sector(spark, d):
    return K.sum_by(Ctx(spark, d).firms, "sector", ["scope1", "scope2", "scope3"], strict=True)


@query("scope_waterfall", ("A4", "W8", "U3"), """
WITH t AS (SELECT SUM(CAST(scope1 AS DECIMAL(38,6))) AS s1, SUM(CAST(scope2 AS DECIMAL(38,6))) AS s2,
                  SUM(CAST(scope3 AS DECIMAL(38,6))) AS s3 FROM firms),
l AS (SELECT 1 AS step, 'scope1' AS measure, s1 AS amount FROM t UNION ALL
      SELECT 2, 'scope2', s2 FROM t UNION ALL SELECT 3, 'scope3', s3 FROM t)
SELECT step, measure, CAST(amount AS DOUBLE) AS amount,
       CAST(COALESCE(SUM(amount) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS base
FROM l
UNION ALL SELECT 4, 'total', CAST(s1 + s2 + s3 AS DOUBLE), 0.0 FROM t
""")
def scope_waterfall(spark, d):
    return K.waterfall(Ctx(spark, d).firms, ["scope1", "scope2", "scope3"])


@query("scope_treemap", ("A5", "U3"), """
WITH l AS (SELECT sector, 'scope1' AS scope, scope1 AS amount FROM firms UNION ALL
           SELECT sector, 'scope2', scope2 FROM firms UNION ALL SELECT sector, 'scope3', scope3 FROM firms)
SELECT sector, scope, CAST(SUM(CAST(amount AS DECIMAL(38,6))) AS DOUBLE) AS amount,
       CAST(GROUPING(sector, scope) AS INT) AS level
FROM l GROUP BY GROUPING SETS ((sector), (sector, scope))
""")
def scope_treemap(spark, d):
    return K.hierarchy(Ctx(spark, d).firms, "sector", ["scope1", "scope2", "scope3"])


@query("scorecard", ("A6",), f"""
WITH {RAW_PANEL_SQL.strip()},
b AS (SELECT entity, period, TRY_CAST(level_txt AS DOUBLE) AS level_mt, share_a_pct, share_b_pct, share_c_pct
      FROM raw_panel WHERE _batch = 2)
SELECT entity, CAST(count(*) AS BIGINT) AS rows,
  round(100.0 * SUM((level_mt IS NOT NULL)::INT + (share_a_pct IS NOT NULL)::INT + (share_b_pct IS NOT NULL)::INT
        + (share_c_pct IS NOT NULL)::INT) / (count(*) * 4), 1) AS completeness_pct,
  max(period) AS latest_period
FROM b GROUP BY entity
""")
def scorecard(spark, d):
    raw = raw_panel(Ctx(spark, d).panel).where("_batch = 2")
    raw = raw.withColumn("level_mt", F.expr("try_cast(level_txt as double)"))
    return K.scorecard(raw, "entity", "period", ["level_mt", "share_a_pct", "share_b_pct", "share_c_pct"])


@query("null_profile", ("A7", "D11"), f"""
WITH {RAW_PANEL_SQL.strip()},
b AS (SELECT entity, period, TRY_CAST(level_txt AS DOUBLE) AS level_mt, share_a_pct, share_b_pct FROM raw_panel),
a AS (SELECT count(*) AS n, SUM(CASE WHEN entity IS NULL THEN 1 ELSE 0 END) AS entity,
             SUM(CASE WHEN period IS NULL THEN 1 ELSE 0 END) AS period,
             SUM(CASE WHEN level_mt IS NULL THEN 1 ELSE 0 END) AS level_mt,
             SUM(CASE WHEN share_a_pct IS NULL THEN 1 ELSE 0 END) AS share_a_pct,
             SUM(CASE WHEN share_b_pct IS NULL THEN 1 ELSE 0 END) AS share_b_pct FROM b)
SELECT 'entity' AS "column", CAST(entity AS BIGINT) AS nulls, round(entity / n, 6) AS null_rate FROM a UNION ALL
SELECT 'period', CAST(period AS BIGINT), round(period / n, 6) FROM a UNION ALL
SELECT 'level_mt', CAST(level_mt AS BIGINT), round(level_mt / n, 6) FROM a UNION ALL
SELECT 'share_a_pct', CAST(share_a_pct AS BIGINT), round(share_a_pct / n, 6) FROM a UNION ALL
SELECT 'share_b_pct', CAST(share_b_pct AS BIGINT), round(share_b_pct / n, 6) FROM a
""")
def null_profile(spark, d):
    raw = raw_panel(Ctx(spark, d, shared=("panel",)).panel).select(
        "entity", "period", F.expr("try_cast(level_txt as double)").alias("level_mt"), "share_a_pct", "share_b_pct")
    return K.null_profile(raw)


@query("kpi_means", ("A9", "P13"), """
SELECT entity, round(avg(level_mt), 1) AS mean_level_mt, round(avg(share_a_pct), 1) AS mean_share_a_pct
FROM panel WHERE period BETWEEN 1996 AND 2000 GROUP BY entity
""")
def kpi_means(spark, d):
    p = Ctx(spark, d).panel_years(1996, 2000)
    return K.kpi_means(p, ["level_mt", "share_a_pct"], by="entity")


QUALITY_TAG = "CASE WHEN volume < 50 THEN 'sample' WHEN period >= 2001 THEN 'estimated' ELSE 'official' END"


def _tagged(panel):
    return panel.withColumn("data_quality", F.expr(QUALITY_TAG))


@query("audit_trail", ("A10", "P3"), f"""
SELECT DISTINCT entity, {QUALITY_TAG} AS data_quality FROM panel
""")
def audit_trail(spark, d):
    return _tagged(Ctx(spark, d).panel).select("entity", "data_quality").distinct()


@query("provenance_badge", ("P22",), f"""
SELECT entity, bool_or(({QUALITY_TAG}) = 'sample') AS has_sample FROM panel GROUP BY entity
""")
def provenance_badge(spark, d):
    return _tagged(Ctx(spark, d).panel).groupBy("entity").agg(
        F.bool_or(F.col("data_quality") == "sample").alias("has_sample"))


@query("sector_list", ("A11", "O1"), "SELECT DISTINCT sector FROM firms")
def sector_list(spark, d):
    return Ctx(spark, d).firms.select("sector").distinct().orderBy("sector")


@query("avg_total_per_entity", ("A12",), """
SELECT entity, round(CAST(SUM(COALESCE(CAST(scope1 AS DECIMAL(38,6)),0) + COALESCE(CAST(scope2 AS DECIMAL(38,6)),0)
       + COALESCE(CAST(scope3 AS DECIMAL(38,6)),0)) AS DOUBLE) / greatest(count(*), 1), 6) AS avg_total
FROM firms GROUP BY entity
""")
def avg_total_per_entity(spark, d):
    return K.avg_total_per_entity(Ctx(spark, d).firms, "entity", ["scope1", "scope2", "scope3"])


@query("sector_box", ("A13",), """
WITH t AS (SELECT sector, scope1 + scope2 + scope3 AS total FROM firms),
q AS (SELECT sector, quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.5) AS median,
             quantile_cont(total, 0.75) AS q3, min(total) AS mn, max(total) AS mx FROM t GROUP BY sector),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM q)
SELECT f.sector, round(mn, 6) AS "min", round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(mx, 6) AS "max", round(lf, 6) AS lower_fence, round(uf, 6) AS upper_fence,
       CAST(SUM(CASE WHEN total < lf OR total > uf THEN 1 ELSE 0 END) AS BIGINT) AS outliers
FROM f JOIN t ON t.sector = f.sector GROUP BY f.sector, mn, q1, median, q3, mx, lf, uf
""")
def sector_box(spark, d):
    f = Ctx(spark, d, shared=("firms",)).firms.select("sector", (F.col("scope1") + F.col("scope2") + F.col("scope3")).alias("total"))
    return K.box_summary(f, "sector", "total")


@query("report_extract", ("A17", "O2"), """
SELECT entity, max(period) AS latest_period,
       arg_max(level_mt, period) AS latest_level_mt, round(avg(level_mt), 6) AS mean_level_mt,
       arg_max(share_a_pct, period) AS latest_share_a_pct, round(avg(share_a_pct), 6) AS mean_share_a_pct
FROM panel GROUP BY entity
""")
def report_extract(spark, d):
    return K.report_extract(Ctx(spark, d).panel, "entity", "period", ["level_mt", "share_a_pct"])


@query("sector_benchmark", ("A18",), """
SELECT firm_id, sector, readiness_score,
       round(percent_rank() OVER (PARTITION BY sector ORDER BY readiness_score), 6) AS percent_rank,
       round(avg(readiness_score) OVER (PARTITION BY sector), 6) AS sector_mean,
       count(*) OVER (PARTITION BY sector) AS sector_n
FROM firms
""")
def sector_benchmark(spark, d):
    return K.sector_benchmark(Ctx(spark, d).firms, "sector", "readiness_score", "firm_id")


@query("latest_rows_global", ("W5", "A1"), """
SELECT entity, period, level_mt FROM panel WHERE period = (SELECT max(period) FROM panel)
""")
def latest_rows_global(spark, d):
    return latest_rows(Ctx(spark, d, shared=("panel",)).panel, "period").select("entity", "period", "level_mt")


@query("report_summary", ("A17", "O2", "A2"), """
WITH h AS (SELECT entity, max(period) AS latest_period, round(arg_max(level_mt, period), 1) AS latest_level_mt, round(arg_max(share_a_pct, period), 1) AS latest_share_a_pct
           FROM panel GROUP BY entity),
r AS (SELECT entity, round(avg(composite_score), 1) AS mean_composite_score, count(*) AS n_composite_score FROM sites GROUP BY entity),
f AS (SELECT entity, round(avg(readiness_score), 1) AS mean_readiness_score, count(*) AS n_readiness_score FROM firms GROUP BY entity)
SELECT h.*, mean_composite_score, n_composite_score, mean_readiness_score, n_readiness_score
FROM h LEFT JOIN r ON r.entity = h.entity LEFT JOIN f ON f.entity = h.entity
""")
def report_summary(spark, d):
    c = Ctx(spark, d)
    return K.report_summary(c.panel, c.sites, c.firms, "entity", "period", ["level_mt", "share_a_pct"], "composite_score", "readiness_score")


@query("report_sites", ("A17", "P1", "P16"), """
SELECT entity, site, composite_score, CASE WHEN composite_score <= 4 THEN 'Low' WHEN composite_score <= 7 THEN 'Medium' ELSE 'High' END AS risk_level FROM sites
""")
def report_sites(spark, d):
    """The report's table of regions, for every entity."""
    s = Ctx(spark, d).sites.withColumn("risk_level", risk_band("composite_score"))
    return K.report_details(s, "entity", ["site", "composite_score", "risk_level"])


@query("report_firms", ("A17", "P1"), """
SELECT entity, firm_name, sector, round(readiness_score, 6) AS readiness_score, gaps_count FROM firms WHERE entity IN ('NATION_3', 'NATION_7')
""")
def report_firms(spark, d):
    """The report's table of companies, for the entities of two reports."""
    f = Ctx(spark, d).firms.withColumn("readiness_score", F.round("readiness_score", 6))
    return K.report_details(f, "entity", ["firm_name", "sector", "readiness_score", "gaps_count"], ["NATION_3", "NATION_7"])
