"""Registered queries: period changes, splits, layouts, forecasts and scenarios."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from terrapanel.operators import trend as T
from terrapanel.operators.window import chrono_split, extreme_change, hash_split, period_change, ring_layout, running_sum
from terrapanel.plans.catalog import Ctx, query

MEASURES = ["level_mt", "share_a_pct", "share_b_pct"]

LONG_SQL = """long AS (
  SELECT entity, 'level_mt' AS metric, period, level_mt AS value FROM panel WHERE level_mt IS NOT NULL UNION ALL
  SELECT entity, 'share_a_pct', period, share_a_pct FROM panel WHERE share_a_pct IS NOT NULL UNION ALL
  SELECT entity, 'share_b_pct', period, share_b_pct FROM panel WHERE share_b_pct IS NOT NULL)"""

T_SQL = "tt(dof, t975) AS (VALUES " + ", ".join(f"({k}, CAST({v!r} AS DOUBLE))" for k, v in T.t_values()) + ")"

YOY_SQL = """yoy AS (
  SELECT entity, period, level_mt,
         level_mt - lag(level_mt) OVER (PARTITION BY entity ORDER BY period) AS level_diff,
         (level_mt - lag(level_mt) OVER (PARTITION BY entity ORDER BY period))
           / NULLIF(lag(level_mt) OVER (PARTITION BY entity ORDER BY period), 0) * 100.0 AS level_pct
  FROM panel)"""


def _yoy(c: Ctx):
    p = c.panel.select("entity", "period", "level_mt")
    return period_change(p, "entity", "period", "level_mt", prefix="level")


@query("yoy_change", ("W2", "W3"), f"""
WITH {YOY_SQL}
SELECT entity, period, level_mt, round(level_diff, 6) AS level_diff, round(level_pct, 6) AS level_pct FROM yoy
""")
def yoy_change(spark, d):
    y = _yoy(Ctx(spark, d))
    return y.select("entity", "period", "level_mt", F.round("level_diff", 6).alias("level_diff"),
                    F.round("level_pct", 6).alias("level_pct"))


@query("largest_yoy_per_entity", ("W4",), f"""
WITH {YOY_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(level_pct) DESC, period) AS rn
      FROM yoy WHERE level_pct IS NOT NULL)
SELECT entity, period, round(level_pct, 6) AS level_pct FROM r WHERE rn = 1
""")
def largest_yoy_per_entity(spark, d):
    r = extreme_change(_yoy(Ctx(spark, d)), "entity", "period", "level_pct", "per_group")
    return r.select("entity", "period", F.round("level_pct", 6).alias("level_pct"))


@query("largest_yoy_first_by_year", ("W4", "O2"), f"""
WITH {YOY_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(level_pct) DESC, period) AS rn
      FROM yoy WHERE level_pct IS NOT NULL)
SELECT entity, period, round(level_pct, 6) AS level_pct FROM r WHERE rn = 1 ORDER BY period, entity LIMIT 1
""")
def largest_yoy_first_by_year(spark, d):
    r = extreme_change(_yoy(Ctx(spark, d)), "entity", "period", "level_pct", "first_by_year")
    return r.select("entity", "period", F.round("level_pct", 6).alias("level_pct"))


@query("largest_yoy_global", ("W4",), f"""
WITH {YOY_SQL}
SELECT entity, period, round(level_pct, 6) AS level_pct FROM yoy WHERE level_pct IS NOT NULL
ORDER BY abs(level_pct) DESC, period, entity LIMIT 1
""")
def largest_yoy_global(spark, d):
    r = extreme_change(_yoy(Ctx(spark, d)), "entity", "period", "level_pct", "global")
    return r.select("entity", "period", F.round("level_pct", 6).alias("level_pct"))


@query("chrono_split", ("W6",), f"""
WITH {LONG_SQL},
s AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY period) AS rn,
             count(*) OVER (PARTITION BY entity, metric) AS n FROM long)
SELECT entity, metric, period, rn > n - ceil(n * CAST(0.2 AS DOUBLE)) AS is_test FROM s
""")
def chrono_split_q(spark, d):
    long = T.long_panel(Ctx(spark, d).panel, "entity", "period", MEASURES)
    return chrono_split(long, ["entity", "metric"], "period", 0.2).select("entity", "metric", "period", "is_test")


@query("ring_layout", ("W7", "F8"), """
WITH s AS (SELECT entity, site, row_number() OVER (PARTITION BY entity ORDER BY site) AS k,
                  count(*) OVER (PARTITION BY entity) AS n FROM sites)
SELECT entity, site, CAST(k AS INT) AS ring_pos, CAST(n AS INT) AS ring_n,
       round(1.3 * cos(2 * pi() * (k - 1) / n), 6) + 0.0 AS dx, round(1.3 * sin(2 * pi() * (k - 1) / n), 6) + 0.0 AS dy
FROM s
""")
def ring_layout_q(spark, d):
    r = ring_layout(Ctx(spark, d).sites.select("entity", "site"), "entity", "site")
    return r.select("entity", "site", "ring_pos", "ring_n", (F.round("dx", 6) + 0.0).alias("dx"),
                    (F.round("dy", 6) + 0.0).alias("dy"))


@query("energy_stack", ("W8", "U3"), """
WITH l AS (SELECT entity, period, 1 AS pos, 'share_a_pct' AS source, share_a_pct AS share FROM panel UNION ALL
           SELECT entity, period, 2, 'share_b_pct', share_b_pct FROM panel UNION ALL
           SELECT entity, period, 3, 'share_c_pct', share_c_pct FROM panel)
SELECT entity, period, pos, source, round(share, 6) AS share,
       round(SUM(share) OVER (PARTITION BY entity, period ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS stacked
FROM l
""")
def energy_stack(spark, d):
    p = Ctx(spark, d).panel
    long = p.unpivot(["entity", "period"], ["share_a_pct", "share_b_pct", "share_c_pct"], "source", "share")
    pos = F.create_map(F.lit("share_a_pct"), F.lit(1), F.lit("share_b_pct"), F.lit(2), F.lit("share_c_pct"), F.lit(3))
    long = long.withColumn("pos", pos[F.col("source")])
    r = running_sum(long, "share", "pos", ["entity", "period"], "stacked")
    return r.select("entity", "period", "pos", "source", F.round("share", 6).alias("share"),
                    F.round("stacked", 6).alias("stacked"))


@query("holdout_split", ("W9",), """
SELECT firm_id, sector, ((('0x' || substr(md5('42:' || CAST(firm_id AS VARCHAR)), 1, 8))::UBIGINT) % 100) < 25 AS is_test
FROM firms
""")
def holdout_split(spark, d):
    return hash_split(Ctx(spark, d).firms.select("firm_id", "sector"), "firm_id", 25, 42)


FIT_SQL = f"""{LONG_SQL},
s AS (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY period) AS rn,
             count(*) OVER (PARTITION BY entity, metric) AS n FROM long),
s2 AS (SELECT *, rn > n - ceil(n * CAST(0.2 AS DOUBLE)) AS is_test FROM s),
s3 AS (SELECT *,
         regr_slope(CASE WHEN NOT is_test THEN value END, CASE WHEN NOT is_test THEN CAST(period - 2000 AS DOUBLE) END)
           OVER (PARTITION BY entity, metric) AS slope,
         regr_intercept(CASE WHEN NOT is_test THEN value END, CASE WHEN NOT is_test THEN CAST(period - 2000 AS DOUBLE) END)
           OVER (PARTITION BY entity, metric) AS intercept FROM s2),
s4 AS (SELECT *, CASE WHEN is_test THEN value - (intercept + slope * (period - 2000)) END AS err FROM s3),
fit AS (SELECT entity, metric, max(slope) AS slope, max(intercept) AS intercept,
               CAST(SUM(CASE WHEN NOT is_test THEN 1 ELSE 0 END) AS INT) AS n_train,
               CAST(SUM(CASE WHEN is_test THEN 1 ELSE 0 END) AS INT) AS n_test, max(period) AS last_period,
               avg(abs(err)) AS mae, sqrt(avg(err * err)) AS rmse,
               avg(abs(CASE WHEN value = 0 THEN NULL ELSE err / value END)) AS mape
        FROM s4 GROUP BY entity, metric)"""


def _fit(c: Ctx):
    return T.holdout_fit(T.long_panel(c.panel, "entity", "period", MEASURES), "entity", "period")


@query("forecast_holdout", ("M1", "M2", "J8", "U2"), f"""
WITH {FIT_SQL},
steps(h, ty) AS (VALUES (1, NULL), (3, NULL), (5, NULL), (10, NULL), (NULL, 2030), (NULL, 2040), (NULL, 2050)),
x AS (SELECT fit.*, CAST(COALESCE(ty, last_period + h) AS INT) AS target_year FROM fit, steps)
SELECT entity, metric, CAST(target_year - last_period AS INT) AS horizon_years, target_year,
       round(intercept + slope * (target_year - 2000), 4) + 0.0 AS forecast_value,
       round(intercept + slope * (target_year - 2000) - 1.96 * mae, 4) + 0.0 AS ci_lower,
       round(intercept + slope * (target_year - 2000) + 1.96 * mae, 4) + 0.0 AS ci_upper
FROM x
""")
def forecast_holdout(spark, d):
    return T.holdout_forecast(_fit(Ctx(spark, d)), "entity")


@query("model_evaluation", ("M12", "M1", "M19"), f"""
WITH {FIT_SQL}
SELECT entity, metric, 'LinearRegression' AS model_type, n_train, n_test, round(mae, 6) AS mae,
       round(rmse, 6) AS rmse, round(mape, 6) AS mape FROM fit
""")
def model_evaluation(spark, d):
    return T.model_evaluation(_fit(Ctx(spark, d)), "entity")


def _ci_sql(horizon_expr: str) -> str:
    return f"""{LONG_SQL},
{T_SQL},
st AS (SELECT entity, metric, regr_count(value, CAST(period - 2000 AS DOUBLE)) AS n, regr_avgx(value, CAST(period - 2000 AS DOUBLE)) AS xbar,
              regr_sxx(value, CAST(period - 2000 AS DOUBLE)) AS sxx, regr_sxy(value, CAST(period - 2000 AS DOUBLE)) AS sxy,
              regr_syy(value, CAST(period - 2000 AS DOUBLE)) AS syy, regr_slope(value, CAST(period - 2000 AS DOUBLE)) AS slope,
              regr_intercept(value, CAST(period - 2000 AS DOUBLE)) AS intercept, max(period) AS last_period
       FROM long GROUP BY entity, metric HAVING regr_count(value, CAST(period - 2000 AS DOUBLE)) >= 3),
fut AS (SELECT st.*, unnest(generate_series(last_period + 1, last_period + {horizon_expr})) AS fy FROM st),
e AS (SELECT fut.*, tt.t975,
             sqrt(greatest((syy - sxy * sxy / sxx) / (n - 2), 0.0)) * sqrt(1.0 / n + (fy - 2000 - xbar) * (fy - 2000 - xbar) / sxx) AS se,
             intercept + slope * (fy - 2000) AS yhat
      FROM fut LEFT JOIN tt ON tt.dof = fut.n - 2),
raw AS (SELECT entity, metric, CAST(fy AS INT) AS period, yhat AS forecast,
              yhat - t975 * se AS lower, yhat + t975 * se AS upper FROM e),
fc AS (SELECT entity, metric, period,
              -- + 0.0 on rounded forecasts: DuckDB's round keeps the sign of a zero result (-0.0),
              -- Spark's decimal round does not; a forecast near 0 would otherwise differ in sign only
              round(forecast, 4) + 0.0 AS forecast, round(lower, 4) + 0.0 AS lower,
              round(upper, 4) + 0.0 AS upper FROM raw)"""


def _ci(c: Ctx, horizon, digits=T.FC_DIGITS):
    return T.forecast_ci(T.long_panel(c.panel, "entity", "period", MEASURES), "entity", "period", horizon,
                         digits=digits)


@query("forecast_ci", ("M3", "J8"), f"WITH {_ci_sql('5')}\nSELECT * FROM fc")
def forecast_ci(spark, d):
    return _ci(Ctx(spark, d), 5)


@query("forecast_ci_2030", ("M3", "M4"), f"WITH {_ci_sql('greatest(1, 2030 - last_period)')}\nSELECT * FROM fc")
def forecast_ci_2030(spark, d):
    return _ci(Ctx(spark, d), "2030")


@query("scenario_forecasts", ("M5", "M6", "J7", "M11"), f"""
WITH {_ci_sql('5')},
sc(scenario, factor) AS (VALUES ('Baseline', CAST(1.0 AS DOUBLE)), ('Accelerated Transition', CAST(0.85 AS DOUBLE)),
                                ('Delayed Policy Action', CAST(1.12 AS DOUBLE)))
SELECT entity, metric, period, scenario, round(forecast * factor, 4) + 0.0 AS forecast, round(lower * factor, 4) + 0.0 AS lower,
       round(upper * factor, 4) + 0.0 AS upper FROM raw, sc
""")
def scenario_forecasts(spark, d):
    return T.scenarios(_ci(Ctx(spark, d), 5, digits=None))


@query("policy_intensity", ("M7",), f"""
WITH {_ci_sql('10')},
p(intensity) AS (VALUES (0), (25), (50), (75), (100))
SELECT entity, metric, period, round(lower, 4) + 0.0 AS lower, round(upper, 4) + 0.0 AS upper, intensity,
       round(forecast * (1.0 - intensity / 100.0 * 0.30 + (1.0 - intensity / 100.0) * 0.10), 4) + 0.0 AS forecast
FROM raw, p WHERE metric = 'level_mt'
""")
def policy_intensity(spark, d):
    fc = _ci(Ctx(spark, d), 10, digits=None).where(F.col("metric") == "level_mt")
    return T.policy_intensity(fc)


@query("direction_badge", ("M8", "M9"), f"""
WITH {_ci_sql('5')},
la AS (SELECT entity, metric, arg_max(value, period) AS last_actual FROM long GROUP BY entity, metric),
lf AS (SELECT entity, metric, arg_max(forecast, period) AS last_forecast, max(period) AS target_period
       FROM fc GROUP BY entity, metric)
SELECT lf.entity, lf.metric, target_period, CASE WHEN last_forecast > last_actual THEN 'Medium' ELSE 'Low' END AS badge,
       -- + 0.0: DuckDB's round keeps the sign of a zero result (-0.0), Spark's decimal round does not
       round((last_forecast - last_actual) / NULLIF(last_actual, 0) * 100.0, 1) + 0.0 AS change_pct
FROM lf JOIN la ON la.entity = lf.entity AND la.metric = lf.metric
""")
def direction_badge(spark, d):
    c = Ctx(spark, d, shared=("panel",))
    long = T.long_panel(c.panel, "entity", "period", MEASURES)
    return T.direction(long, T.forecast_ci(long, "entity", "period", 5), "entity", "period")


@query("time_view", ("M10", "P16"), """
WITH v(view, base, slope) AS (VALUES ('past', CAST(0.7 AS DOUBLE), CAST(0.0 AS DOUBLE)), ('present', 1.0, 0.0),
                                     ('future', 1.0, CAST(0.015 AS DOUBLE)), ('next_future', 1.0, CAST(0.03 AS DOUBLE))),
y(year) AS (VALUES (2023), (2030), (2050)),
x AS (SELECT entity, site, composite_score, view, year,
             least(10.0, composite_score * (base + greatest(0, year - 2023) * slope)) AS adj FROM sites, v, y)
SELECT entity, site, composite_score, view, year, round(adj, 6) AS adjusted_score,
       CASE WHEN adj IS NULL THEN NULL WHEN adj <= 4 THEN 'Low' WHEN adj <= 7 THEN 'Medium' ELSE 'High' END AS adjusted_level
FROM x
""")
def time_view(spark, d):
    s = Ctx(spark, d).sites.select("entity", "site", "composite_score")
    return T.time_view(s, "composite_score", [2023, 2030, 2050])


CHANGE_SQL = """j AS (SELECT a.entity, a.period, a.level_mt, b.share_a_pct
      FROM (SELECT entity, period, level_mt FROM panel) a
      JOIN (SELECT entity, period, share_a_pct FROM panel) b ON a.entity = b.entity AND a.period = b.period),
f AS (SELECT entity, period, level_mt, share_a_pct,
             (level_mt - lag(level_mt) OVER w) / NULLIF(lag(level_mt) OVER w, 0) * 100.0 AS level_pct,
             level_mt - lag(level_mt) OVER w AS level_diff,
             share_a_pct - lag(share_a_pct) OVER w AS share_a_diff
      FROM j WINDOW w AS (PARTITION BY entity ORDER BY period)),
feat AS (SELECT * FROM f WHERE level_pct IS NOT NULL AND level_diff IS NOT NULL AND share_a_diff IS NOT NULL)"""


def _features(c: Ctx):
    p = c.panel
    j = p.select("entity", "period", "level_mt").join(p.select("entity", "period", "share_a_pct"), ["entity", "period"])
    w = Window.partitionBy("entity").orderBy("period")
    prev = F.lag("level_mt").over(w)
    f = (j.withColumn("level_pct", F.try_divide(F.col("level_mt") - prev, prev) * F.lit(100.0))
          .withColumn("level_diff", F.col("level_mt") - prev)
          .withColumn("share_a_diff", F.col("share_a_pct") - F.lag("share_a_pct").over(w)))
    return f.na.drop(subset=["level_pct", "level_diff", "share_a_diff"])


@query("change_features", ("M13", "J1", "W2", "W3"), f"""
WITH {CHANGE_SQL}
SELECT entity, period, round(level_pct, 6) AS level_pct, round(level_diff, 6) AS level_diff,
       round(share_a_diff, 6) AS share_a_diff FROM feat
""")
def change_features(spark, d):
    f = _features(Ctx(spark, d, shared=("panel",)))
    return f.select("entity", "period", *[F.round(c, 6).alias(c) for c in ("level_pct", "level_diff", "share_a_diff")])


@query("robust_anomaly", ("M15", "A13"), f"""
WITH {CHANGE_SQL},
m AS (SELECT entity, quantile_cont(level_pct, 0.5) AS med FROM feat GROUP BY entity),
a AS (SELECT feat.entity, period, level_pct, med, abs(level_pct - med) AS dev FROM feat JOIN m ON m.entity = feat.entity),
mad AS (SELECT entity, quantile_cont(dev, 0.5) AS mad FROM a GROUP BY entity),
z AS (SELECT a.entity, period, level_pct, 0.6745 * (level_pct - med) / NULLIF(mad, 0) AS rz FROM a JOIN mad ON mad.entity = a.entity)
SELECT entity, period, round(level_pct, 6) AS level_pct, round(rz, 6) AS robust_z, COALESCE(abs(rz) > 3.5, false) AS is_anomaly FROM z
""")
def robust_anomaly(spark, d):
    from terrapanel.operators.anomaly import robust_z
    f = _features(Ctx(spark, d, shared=("panel",))).select("entity", "period", "level_pct")
    z = robust_z(f, "entity", "level_pct")
    return z.select("entity", "period", F.round("level_pct", 6).alias("level_pct"),
                    F.round("robust_z", 6).alias("robust_z"), "is_anomaly")
