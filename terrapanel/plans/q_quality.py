"""Registered queries: row contract, quality rules, reconciliation and publish policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrapanel.functions.clean import code
from terrapanel.operators import quality as Q
from terrapanel.operators import reconcile as R
from terrapanel.plans.catalog import Ctx, query
from terrapanel.plans.landing import PREVIOUS_PANEL_SQL, RAW_PANEL_SQL, previous_panel, raw_panel
from terrapanel.registry import FIRMS, PANEL, SITES, Dataset

AS_OF_YEAR = 2003


def _raw_current(c: Ctx):
    return (raw_panel(c.panel).where("_batch = 2")
            .select("entity", "period", F.expr("try_cast(level_txt as double)").alias("level_mt"),
                    "share_a_pct", "share_b_pct", "share_c_pct", "volume"))


RAW_CURRENT_SQL = f"""{RAW_PANEL_SQL.strip()},
cur AS (SELECT entity, period, TRY_CAST(level_txt AS DOUBLE) AS level_mt, share_a_pct, share_b_pct, share_c_pct, volume
        FROM raw_panel WHERE _batch = 2)"""

FIRST_ERROR_SQL = """COALESCE(
  CASE WHEN entity IS NULL THEN 'entity:missing' END,
  CASE WHEN period IS NULL THEN 'period:missing' END,
  CASE WHEN period < 1990 THEN 'period:below_min' END,
  CASE WHEN period > 2100 THEN 'period:above_max' END,
  CASE WHEN level_mt IS NULL OR isnan(level_mt) THEN 'level_mt:missing' END,
  CASE WHEN level_mt < 0 THEN 'level_mt:below_min' END,
  CASE WHEN share_a_pct IS NULL OR isnan(share_a_pct) THEN 'share_a_pct:missing' END,
  CASE WHEN share_a_pct < 0 THEN 'share_a_pct:below_min' END,
  CASE WHEN share_a_pct > 100 THEN 'share_a_pct:above_max' END,
  CASE WHEN share_b_pct < 0 THEN 'share_b_pct:below_min' END,
  CASE WHEN share_b_pct > 100 THEN 'share_b_pct:above_max' END,
  CASE WHEN share_c_pct < 0 THEN 'share_c_pct:below_min' END,
  CASE WHEN share_c_pct > 100 THEN 'share_c_pct:above_max' END,
  CASE WHEN volume < 0 THEN 'volume:below_min' END)"""


@query("validate_rows", ("V1", "V2", "P19"), f"""
WITH {RAW_CURRENT_SQL}
SELECT entity, period, {FIRST_ERROR_SQL} IS NULL AS is_valid, {FIRST_ERROR_SQL} AS first_error FROM cur
""")
def validate_rows(spark, d):
    v = Q.validate(_raw_current(Ctx(spark, d)), PANEL)
    return v.select("entity", "period", "is_valid", "first_error")


@query("validation_report", ("V1", "A14"), f"""
WITH {RAW_CURRENT_SQL},
v AS (SELECT {FIRST_ERROR_SQL} IS NULL AS ok FROM cur)
SELECT 'panel' AS dataset, count(*) AS total_rows, CAST(SUM(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS valid_rows,
       CAST(SUM(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS invalid_rows,
       round(COALESCE(SUM(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 0.0), 6) AS pass_rate,
       COALESCE(SUM(CASE WHEN ok THEN 1 ELSE 0 END) / count(*), 0.0) >= 0.95 AS passed
FROM v
""")
def validation_report(spark, d):
    v = Q.validate(_raw_current(Ctx(spark, d)), PANEL)
    return Q.validation_report(v, PANEL)


@query("validation_first_errors", ("O3", "V1"), f"""
WITH {RAW_CURRENT_SQL}
SELECT entity, period, {FIRST_ERROR_SQL} AS first_error FROM cur
WHERE {FIRST_ERROR_SQL} IS NOT NULL ORDER BY entity, period LIMIT 20
""")
def validation_first_errors(spark, d):
    v = Q.validate(_raw_current(Ctx(spark, d)), PANEL)
    return Q.first_errors(v, PANEL, 20)


@query("key_null_gate", ("V5", "A7"), f"""
WITH {RAW_PANEL_SQL.strip()},
b AS (SELECT CASE WHEN _batch = 1 AND (period*7+length(entity)) % 2 = 0 THEN NULL ELSE entity END AS entity, period
      FROM raw_panel)
SELECT 'panel' AS dataset, count(*) AS "rows",
       round(greatest(avg(CASE WHEN entity IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN period IS NULL THEN 1.0 ELSE 0.0 END)), 6) AS max_key_null_rate,
       count(*) > 0 AND greatest(avg(CASE WHEN entity IS NULL THEN 1.0 ELSE 0.0 END), avg(CASE WHEN period IS NULL THEN 1.0 ELSE 0.0 END)) <= 0.05 AS passed
FROM b
""")
def key_null_gate(spark, d):
    raw = raw_panel(Ctx(spark, d, shared=("panel",)).panel)
    k = F.col("period") * 7 + F.length("entity")
    raw = raw.withColumn("entity", F.when((F.col("_batch") == 1) & (k % 2 == 0), F.lit(None)).otherwise(F.col("entity")))
    return Q.key_null_gate(raw.select("entity", "period"), PANEL)


def _rules_sql(src: str, extra_rules: str = "") -> str:
    return f"""
v AS (SELECT *, {FIRST_ERROR_SQL} IS NULL AS ok FROM {src}),
r AS (
  SELECT 'row_count_min' AS rule, CAST(count(*) AS DOUBLE) AS observed, 3.0 AS threshold, '>=' AS op FROM v UNION ALL
  SELECT 'row_count_max', CAST(count(*) AS DOUBLE), 900.0, '<=' FROM v UNION ALL
  SELECT 'valid_share', COALESCE(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 0.0), 0.95, '>=' FROM v UNION ALL
  SELECT 'nulls_entity', CAST(SUM(CASE WHEN entity IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_period', CAST(SUM(CASE WHEN period IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_level_mt', CAST(SUM(CASE WHEN level_mt IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_share_a_pct', CAST(SUM(CASE WHEN share_a_pct IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'period_lag', {AS_OF_YEAR}.0 - CAST(max(period) AS DOUBLE), 5.0, '<=' FROM v UNION ALL
  SELECT 'period_out_of_range', CAST(SUM(CASE WHEN period NOT BETWEEN 1990 AND 2100 THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'period_not_integer', CAST(SUM(CASE WHEN CAST(period AS DOUBLE) <> floor(period) THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'duplicate_key_rows', CAST(COALESCE(SUM(n), 0) AS DOUBLE), 0.0, '<='
    FROM (SELECT count(*) AS n FROM v GROUP BY entity, period HAVING count(*) > 1) UNION ALL
  SELECT 'missing_expected', CAST(count(*) AS DOUBLE), 0.0, '<='
    FROM (SELECT DISTINCT n_name FROM nation WHERE n_name NOT IN (SELECT entity FROM v WHERE entity IS NOT NULL))
  {extra_rules})
SELECT 'panel' AS dataset, rule, round(observed, 6) AS observed, CAST(threshold AS DOUBLE) AS threshold,
       COALESCE(CASE WHEN op = '>=' THEN observed >= threshold ELSE observed <= threshold END, false) AS passed
FROM r"""


@query("dq_rules_panel", ("D6", "D7", "D8", "D9", "D10", "D11", "D13", "F9"), f"""
WITH {_rules_sql('panel')}
""")
def dq_rules_panel(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    return Q.rule_table(c.panel, PANEL, AS_OF_YEAR, expected=c.t.nation.select("n_name"))


@query("dq_rules_raw", ("D6", "D7", "D10", "D11", "V1"), f"""
WITH {RAW_PANEL_SQL.strip()},
b AS (SELECT upper(regexp_replace(entity, '^\\s+|\\s+$', '', 'g')) AS entity, period,
             TRY_CAST(level_txt AS DOUBLE) AS level_mt, share_a_pct, share_b_pct, share_c_pct, volume FROM raw_panel),
{_rules_sql('b')}
""")
def dq_rules_raw(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    raw = raw_panel(c.panel).select(code("entity").alias("entity"), "period",
                                    F.expr("try_cast(level_txt as double)").alias("level_mt"),
                                    "share_a_pct", "share_b_pct", "share_c_pct", "volume")
    return Q.rule_table(raw, PANEL, AS_OF_YEAR, expected=c.t.nation.select("n_name"))


@query("dq_rules_firms", ("D7", "D10", "D11", "D14", "J6", "U5"), """
WITH v AS (SELECT *, (firm_id IS NOT NULL AND firm_name IS NOT NULL AND entity IS NOT NULL AND sector IS NOT NULL
                      AND scope1 >= 0 AND scope2 >= 0 AND scope3 >= 0 AND readiness_score BETWEEN 0 AND 100
                      AND gaps_count >= 0 AND scope1 IS NOT NULL AND scope2 IS NOT NULL AND scope3 IS NOT NULL
                      AND readiness_score IS NOT NULL AND gaps_count IS NOT NULL) AS ok FROM firms),
r AS (
  SELECT 'row_count_min' AS rule, CAST(count(*) AS DOUBLE) AS observed, 1.0 AS threshold, '>=' AS op FROM v UNION ALL
  SELECT 'row_count_max', CAST(count(*) AS DOUBLE), 100000.0, '<=' FROM v UNION ALL
  SELECT 'valid_share', COALESCE(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 0.0), 0.95, '>=' FROM v UNION ALL
  SELECT 'nulls_firm_id', CAST(SUM(CASE WHEN firm_id IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_firm_name', CAST(SUM(CASE WHEN firm_name IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_entity', CAST(SUM(CASE WHEN entity IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_sector', CAST(SUM(CASE WHEN sector IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_scope1', CAST(SUM(CASE WHEN scope1 IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_scope2', CAST(SUM(CASE WHEN scope2 IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_scope3', CAST(SUM(CASE WHEN scope3 IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_readiness_score', CAST(SUM(CASE WHEN readiness_score IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'nulls_gaps_count', CAST(SUM(CASE WHEN gaps_count IS NULL THEN 1 ELSE 0 END) AS DOUBLE), 0.0, '<=' FROM v UNION ALL
  SELECT 'duplicate_key_rows', CAST(COALESCE(SUM(n), 0) AS DOUBLE), 0.0, '<='
    FROM (SELECT count(*) AS n FROM v GROUP BY firm_id HAVING count(*) > 1) UNION ALL
  SELECT 'orphan_codes', CAST(count(*) AS DOUBLE), 0.0, '<='
    FROM (SELECT DISTINCT entity FROM v WHERE entity NOT IN (SELECT DISTINCT entity FROM panel)))
SELECT 'firms' AS dataset, rule, round(observed, 6) AS observed, CAST(threshold AS DOUBLE) AS threshold,
       COALESCE(CASE WHEN op = '>=' THEN observed >= threshold ELSE observed <= threshold END, false) AS passed
FROM r
""")
def dq_rules_firms(spark, d):
    c = Ctx(spark, d, shared=("firms",))
    return Q.rule_table(c.firms, FIRMS, AS_OF_YEAR, parent_codes=c.panel.select("entity"))


@query("duplicate_keys", ("D10", "D17"), f"""
WITH {RAW_PANEL_SQL.strip()}
SELECT upper(regexp_replace(entity, '^\\s+|\\s+$', '', 'g')) AS entity, period, count(*) AS copies
FROM raw_panel GROUP BY 1, 2 HAVING count(*) > 1
""")
def duplicate_keys(spark, d):
    raw = raw_panel(Ctx(spark, d, shared=("panel",)).panel).select(code("entity").alias("entity"), "period")
    return Q.duplicate_rows(raw, ["entity", "period"])


RECON_SQL = f"""{PREVIOUS_PANEL_SQL.strip()},
j AS (SELECT p.entity, p.period, p.level_mt, p.share_a_pct, q.level_mt AS pl, q.share_a_pct AS ps
      FROM panel p LEFT JOIN previous_panel q ON p.entity = q.entity AND p.period = q.period),
a AS (SELECT entity, period, 'level_mt' AS "column", pl AS previous_value, level_mt AS new_value,
             abs(level_mt - pl) / abs(pl) AS rc FROM j WHERE pl IS NOT NULL AND level_mt IS NOT NULL AND pl <> 0
      UNION ALL
      SELECT entity, period, 'share_a_pct', ps, share_a_pct, abs(share_a_pct - ps) / abs(ps)
      FROM j WHERE ps IS NOT NULL AND share_a_pct IS NOT NULL AND ps <> 0),
flagged AS (SELECT * FROM a WHERE rc > 0.15)"""


def _compared(c: Ctx):
    return R.compare(c.panel, previous_panel(c.panel), PANEL)


@query("reconcile_anomalies", ("V3", "J3", "F12", "F8"), f"""
WITH {RECON_SQL}
SELECT entity, period, "column", previous_value, new_value, round(rc, 3) AS relative_change,
       CAST(0.15 AS DOUBLE) AS tolerance FROM flagged
""")
def reconcile_anomalies(spark, d):
    return R.anomalies(_compared(Ctx(spark, d, shared=("panel",))), PANEL)


@query("reconcile_summary", ("A15", "V3"), f"""
WITH {RECON_SQL}
SELECT 'panel' AS dataset, (SELECT count(*) FROM j) AS rows_compared, (SELECT count(*) FROM flagged) AS anomaly_count,
       (SELECT count(*) FROM (SELECT DISTINCT entity, period FROM flagged)) AS flagged_rows,
       (SELECT count(*) FROM flagged) = 0 AS clean
""")
def reconcile_summary(spark, d):
    return R.summary(_compared(Ctx(spark, d, shared=("panel",))), PANEL)


@query("reconcile_safe_rows", ("J5", "V3"), f"""
WITH {RECON_SQL}
SELECT p.* FROM panel p WHERE NOT EXISTS (SELECT 1 FROM flagged f WHERE f.entity = p.entity AND f.period = p.period)
""")
def reconcile_safe_rows(spark, d):
    return R.safe_rows(_compared(Ctx(spark, d, shared=("panel",))))


@query("publish_keep_previous", ("V4", "S13"), f"""
WITH {RECON_SQL},
fk AS (SELECT DISTINCT entity, period FROM flagged)
SELECT p.* FROM panel p WHERE NOT EXISTS (SELECT 1 FROM fk WHERE fk.entity = p.entity AND fk.period = p.period)
UNION ALL
SELECT q.* FROM previous_panel q WHERE EXISTS (SELECT 1 FROM fk WHERE fk.entity = q.entity AND fk.period = q.period)
""")
def publish_keep_previous(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    prev = previous_panel(c.panel)
    return R.promote(R.compare(c.panel, prev, PANEL), prev, PANEL, on_flag="keep_previous")


@query("publish_first_run", ("V3", "V4"), """
SELECT 'panel' AS dataset, CAST(0 AS BIGINT) AS rows_compared, CAST(0 AS BIGINT) AS anomaly_count,
       CAST(0 AS BIGINT) AS flagged_rows, true AS clean
""")
def publish_first_run(spark, d):
    cmp = R.compare(Ctx(spark, d).panel, None, PANEL)
    return R.summary(cmp, PANEL, had_previous=False)


SITES_RULES_SQL = """
v AS (SELECT *, entity IS NOT NULL AND site IS NOT NULL AND trim(site) <> '' AND trim(entity) <> '' AND {0} AS ok FROM {1}),
r AS (
  SELECT 'row_count_min' AS rule, count(*)::DOUBLE AS observed, 3.0 AS threshold, '>=' AS op FROM v UNION ALL
  SELECT 'row_count_max', count(*)::DOUBLE, 500.0, '<=' FROM v UNION ALL
  SELECT 'valid_share', coalesce(avg(ok::INT), 0.0), 0.95, '>=' FROM v UNION ALL
  {2} UNION ALL
  SELECT 'blank_site', sum(coalesce(trim(site) = '', false)::INT)::DOUBLE, 0.0, '<=' FROM v UNION ALL
  SELECT 'duplicate_key_rows', coalesce(sum(n), 0)::DOUBLE, 0.0, '<=' FROM (SELECT count(*) AS n FROM v GROUP BY entity, site HAVING count(*) > 1) UNION ALL
  SELECT 'duplicate_rows', coalesce(sum(n), 0)::DOUBLE, 0.0, '<=' FROM (SELECT count(*) AS n FROM v GROUP BY entity, site, physical_score, transition_score, flood_score, heat_score, composite_score, phone HAVING count(*) > 1) UNION ALL
  SELECT 'orphan_codes', count(*)::DOUBLE, 0.0, '<=' FROM (SELECT DISTINCT entity FROM v) WHERE entity NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 4) UNION ALL
  SELECT 'missing_expected', count(*)::DOUBLE, 0.0, '<=' FROM (SELECT n_name FROM nation WHERE n_name NOT IN (SELECT entity FROM v)) UNION ALL
  SELECT 'missing_source_columns', 1.0, 0.0, '<=' UNION ALL
  SELECT 'missing_contract_columns', 0.0, 0.0, '<=' UNION ALL
  SELECT 'personal_column_names', 1.0, 0.0, '<=' UNION ALL
  SELECT 'personal_fields', 1.0, 0.0, '<=')
SELECT 'sites' AS dataset, rule, round(observed, 6) AS observed, threshold::DOUBLE AS threshold,
       coalesce(CASE WHEN op = '>=' THEN observed >= threshold ELSE observed <= threshold END, false) AS passed FROM r
"""
_SCORES = ("physical_score", "transition_score", "flood_score", "heat_score", "composite_score")
_SITE_NULLS = " UNION ALL ".join(f"SELECT 'nulls_{c}', sum(({c} IS NULL)::INT)::DOUBLE, 0.0, '<=' FROM v" for c in ("entity", "site", *_SCORES))


@query("dq_rules_sites", ("D4", "D5", "D7", "D9", "D10", "D11", "D14", "D15a", "D16", "J6", "U5"), f"""
WITH b AS (SELECT entity, CASE WHEN physical_score < 2 THEN ' ' ELSE left(site, 14) END AS site, {', '.join(_SCORES)}, NULL AS phone FROM sites),
{SITES_RULES_SQL.format(' AND '.join(f'{c} BETWEEN 0 AND 10' for c in _SCORES), 'b', _SITE_NULLS).strip()}
""")
def dq_rules_sites(spark, d):
    """All rules in one pass over sites whose names are cut short (keys collide), blank for the safest, with a column of phones."""
    c = Ctx(spark, d)
    site = F.when(F.col("physical_score") < 2, " ").otherwise(F.substring("site", 1, 14))
    df = c.sites.select("entity", site.alias("site"), *_SCORES, F.lit(None).cast("string").alias("phone"))
    return Q.rule_table(df, SITES, AS_OF_YEAR, expected=c.t.nation.select("n_name"), parent_codes=c.t.nation.where("n_regionkey < 4").select("n_name"),
                        complete=True, source_columns=("site", "entity", "elevation"))


@query("dq_rules_files", ("D8", "D13", "D10", "F9"), """
WITH r AS (
  SELECT 'row_count_min' AS rule, count(*)::DOUBLE AS observed, 1.0 AS threshold, '>=' AS op FROM orders UNION ALL
  SELECT 'row_count_max', count(*)::DOUBLE, 100000.0, '<=' FROM orders UNION ALL
  SELECT 'valid_share', 1.0, 0.95, '>=' UNION ALL
  SELECT 'nulls_firm_id', 0.0, 0.0, '<=' UNION ALL
  SELECT 'file_stamp_invalid', sum((month(o_orderdate) = 1 OR year(o_orderdate) < 2020)::INT)::DOUBLE, 0.0, '<=' FROM orders UNION ALL
  SELECT 'file_age_days', date_diff('day', min(date_trunc('month', o_orderdate))::DATE, DATE '2003-01-01')::DOUBLE, 364.0, '<=' FROM orders WHERE month(o_orderdate) <> 1 UNION ALL
  SELECT 'duplicate_key_rows', 0.0, 0.0, '<=' UNION ALL SELECT 'duplicate_rows', 0.0, 0.0, '<=' UNION ALL
  SELECT 'missing_source_columns', 0.0, 0.0, '<=' UNION ALL SELECT 'missing_contract_columns', 0.0, 0.0, '<=' UNION ALL
  SELECT 'personal_column_names', 0.0, 0.0, '<=' UNION ALL SELECT 'personal_fields', 0.0, 0.0, '<=')
SELECT 'orders' AS dataset, rule, round(observed, 6) AS observed, threshold::DOUBLE AS threshold,
       coalesce(CASE WHEN op = '>=' THEN observed >= threshold ELSE observed <= threshold END, false) AS passed FROM r
""", views=False)
def dq_rules_files(spark, d):
    """Landed files named by their pull: one file a month of orders, unstamped where the month is a January."""
    c = Ctx(spark, d)
    o = c.t.orders
    month = F.date_trunc("month", "o_orderdate")
    name = F.when(F.month("o_orderdate") == 1, "pull_latest.csv").otherwise(F.concat(F.lit("pull_"), F.date_format(month, "yyyyMMdd'T'HHmmss'Z'"), F.lit(".csv")))
    df = o.select(F.col("o_orderkey").alias("firm_id"), name.alias("_source_file"))
    ds = Dataset(name="orders", key=("firm_id",), entity="firm_id")
    return Q.rule_table(df, ds, AS_OF_YEAR, complete=True, as_of="2003-01-01")


@query("reconcile_by_volatility", ("V6", "V3", "F12"), f"""
WITH {PREVIOUS_PANEL_SQL.strip()},
m AS (SELECT entity, abs((level_mt - lag(level_mt) OVER w) / nullif(abs(lag(level_mt) OVER w), 0)) AS level_mt,
             abs((share_a_pct - lag(share_a_pct) OVER w) / nullif(abs(lag(share_a_pct) OVER w), 0)) AS share_a_pct
      FROM previous_panel WINDOW w AS (PARTITION BY entity ORDER BY period)),
t AS (SELECT entity, CASE WHEN median(level_mt) > 0.075 THEN 0.4 ELSE 0.15 END AS tl, CASE WHEN median(share_a_pct) > 0.075 THEN 0.4 ELSE 0.15 END AS ts FROM m GROUP BY entity),
j AS (SELECT p.entity, p.period, p.level_mt, p.share_a_pct, q.level_mt AS pl, q.share_a_pct AS ps, tl, ts
      FROM panel p JOIN previous_panel q ON p.entity = q.entity AND p.period = q.period JOIN t ON t.entity = p.entity),
a AS (SELECT entity, period, 'level_mt' AS "column", pl AS previous_value, level_mt AS new_value, abs(level_mt - pl) / abs(pl) AS rc, tl AS tolerance FROM j WHERE pl <> 0
      UNION ALL SELECT entity, period, 'share_a_pct', ps, share_a_pct, abs(share_a_pct - ps) / abs(ps), ts FROM j WHERE ps <> 0)
SELECT entity, period, "column", previous_value, new_value, round(rc, 3) AS relative_change, tolerance::DOUBLE AS tolerance FROM a WHERE rc > tolerance
""")
def reconcile_by_volatility(spark, d):
    """Each series against a tolerance from its own past: 40% where the previous load moved a lot from year to year."""
    p = Ctx(spark, d, shared=("panel",)).panel
    prev = previous_panel(p)
    return R.anomalies(R.compare(p, prev, PANEL, R.volatility_tolerances(prev, PANEL)), PANEL)


@query("logged_anomalies", ("O3", "V3"), f"""
WITH {RECON_SQL}
SELECT entity, period, "column", previous_value, new_value, round(rc, 3) AS relative_change, CAST(0.15 AS DOUBLE) AS tolerance
FROM flagged ORDER BY entity, period, "column" LIMIT 10
""")
def logged_anomalies(spark, d):
    """The ten anomalies that a run logs: the first by key and column (a top-k per task, then of those)."""
    found = R.anomalies(_compared(Ctx(spark, d, shared=("panel",))), PANEL)
    return found.orderBy(*PANEL.key, "column").limit(10)
