"""Trend, forecast and scenario operators.

Every series is a group ``(entity, metric)`` of the *unpivoted* panel, so all
series of all metrics are fitted in one grouped plan (no loop of unions).  The
fits use the algebraic ``regr_*`` aggregates: map-side partials, one small
exchange.  Windows here are partitioned by series, i.e. bounded by the number
of periods of one series.  Horizons and scenarios are generated with
``explode`` of fixed arrays: narrow, no join, no cross product.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from terrapanel.operators.window import chrono_split

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's model settings):
# holdout share 0.2 (last ceil(0.2 n) rows), band = 1.96 * MAE;
# horizons +1, +3, +5, +10 years; target years 2030, 2040, 2050;
# scenarios: Baseline 1.0, Accelerated Transition 0.85, Delayed Policy Action 1.12;
# policy intensity p: factor 1 - 0.30 p/100 + 0.10 (1 - p/100);
# time view: past 0.7, present 1.0, future 1 + 0.015 max(0, y-2023),
#   next_future 1 + 0.03 max(0, y-2023); adjusted score capped at 10.
# ---------------------------------------------------------------------------
TEST_SHARE = 0.2
MAE_Z = 1.96
HORIZON_YEARS = (1, 3, 5, 10)
TARGET_YEARS = (2030, 2040, 2050)
SCENARIOS = (("Baseline", 1.0), ("Accelerated Transition", 0.85), ("Delayed Policy Action", 1.12))
INTENSITIES = (0, 25, 50, 75, 100)
VIEW_BASE_YEAR = 2023
VIEWS = (("past", 0.7, 0.0), ("present", 1.0, 0.0), ("future", 1.0, 0.015), ("next_future", 1.0, 0.03))


# -- Student t quantiles from a rule (no SciPy) ------------------------------------------------
def t_cdf(t: float, dof: int) -> float:
    """Exact for whole degrees of freedom: with the angle whose tangent is t / sqrt(dof),
    the central probability is a finite sum of even (odd dof: odd) powers of its cosine."""
    angle = math.atan2(abs(t), math.sqrt(dof))
    c2, power = math.cos(angle) ** 2, 1.0 if dof % 2 == 0 else math.cos(angle)
    total, weight, k = 0.0, 1.0, 0 if dof % 2 == 0 else 1
    while k <= dof - 2:  # weight: the product of (j - 1) / j over the even (odd) j up to k
        total += weight * power
        weight *= (k + 1) / (k + 2)
        power *= c2
        k += 2
    central = math.sin(angle) * total
    if dof % 2:
        central = (angle + central) * 2 / math.pi
    return 0.5 + math.copysign(central / 2, t)


def t_quantile(p: float, dof: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_cdf(mid, dof) < p:
            new = (mid, hi)
        else:
            new = (lo, mid)
        if new == (lo, hi):  # one ulp apart: every later step repeats this one
            break
        lo, hi = new
    return (lo + hi) / 2


FC_DIGITS = 4  # forecasts are reported to 4 dp
X_ORIGIN = 2000  # the time axis is centred here: same fit, better conditioned sums
T_TABLE_MAX_DF = 200  # tabulated; longer series use the expansion, equal to 9 dp there
Z_975 = 1.959963984540054  # standard normal quantile


@functools.lru_cache(maxsize=None)
def t_values(max_df: int = T_TABLE_MAX_DF, p: float = 0.975) -> tuple[tuple[int, float], ...]:
    """Computed once per process (a pure function of its two parameters)."""
    return tuple((k, round(t_quantile(p, k), 9)) for k in range(1, max_df + 1))


def t_table(spark: SparkSession, max_df: int = T_TABLE_MAX_DF) -> DataFrame:
    """(dof, t975) for dof 1..max_df: a fixed, bounded table (safe to broadcast)."""
    return spark.createDataFrame(list(t_values(max_df)), "dof int, t975 double")


def t975_expansion(dof: Column) -> Column:
    """The quantile in powers of 1/dof around the normal one; from 200 degrees on it agrees to 10 digits."""
    z, v = Z_975, dof.cast("double")
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96,
             (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
             (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    out = F.lit(z)
    for k, t in enumerate(terms, start=1):
        out = out + F.lit(t) / F.pow(v, F.lit(k))
    return F.round(out, 9)


# -- series helpers ----------------------------------------------------------------------------
def long_panel(panel: DataFrame, entity: str, period: str, measures: Sequence[str]) -> DataFrame:
    """(entity, metric, period, value) with missing values dropped."""
    return (panel.unpivot([entity, period], list(measures), "metric", "value")
                 .where(F.col("value").isNotNull() & ~F.isnan("value")))


# -- M1 / M2 / M12: holdout OLS --------------------------------------------------------------------
def holdout_fit(long: DataFrame, entity: str, period: str) -> DataFrame:
    """Per series: fit value ~ period on the first n - ceil(0.2 n) rows, score the
    rest.  One row per series with slope, intercept, n_train, n_test, last
    period, MAE, RMSE and MAPE on the test rows."""
    by = [entity, "metric"]
    s = chrono_split(long, by, period, TEST_SHARE)
    w = Window.partitionBy(*by)
    ty = F.when(~F.col("is_test"), F.col("value"))
    tx = F.when(~F.col("is_test"), (F.col(period) - X_ORIGIN).cast("double"))
    s = (s.withColumn("slope", F.regr_slope(ty, tx).over(w))
          .withColumn("intercept", F.regr_intercept(ty, tx).over(w)))
    err = F.col("value") - (F.col("intercept") + F.col("slope") * (F.col(period) - X_ORIGIN))
    s = s.withColumn("err", F.when(F.col("is_test"), err))
    return s.groupBy(*by).agg(
        F.max("slope").alias("slope"), F.max("intercept").alias("intercept"),
        F.sum((~F.col("is_test")).cast("int")).alias("n_train"),
        F.sum(F.col("is_test").cast("int")).alias("n_test"),
        F.max(period).alias("last_period"),
        F.avg(F.abs("err")).alias("mae"),
        F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
        F.avg(F.abs(F.try_divide(F.col("err"), F.col("value")))).alias("mape"))


def holdout_forecast(fit: DataFrame, entity: str, digits: int = FC_DIGITS) -> DataFrame:
    """J8 + M2: forecasts at last+h for h in HORIZON_YEARS and at each target year
    (horizon = target - last, negative when the target is in the past)."""
    steps = [F.struct(F.lit(h).alias("h"), F.lit(None).cast("int").alias("ty")) for h in HORIZON_YEARS] + \
            [F.struct(F.lit(None).cast("int").alias("h"), F.lit(ty).alias("ty")) for ty in TARGET_YEARS]
    x = fit.withColumn("__s", F.explode(F.array(*steps)))
    target = F.coalesce(F.col("__s.ty"), F.col("last_period") + F.col("__s.h"))
    x = x.withColumn("target_year", target.cast("int")) \
         .withColumn("horizon_years", (F.col("target_year") - F.col("last_period")).cast("int"))
    fc = F.col("intercept") + F.col("slope") * (F.col("target_year") - X_ORIGIN)
    band = F.lit(MAE_Z) * F.col("mae")
    return x.select(entity, "metric", "horizon_years", "target_year",
                    F.round(fc, digits).alias("forecast_value"),
                    F.round(fc - band, digits).alias("ci_lower"), F.round(fc + band, digits).alias("ci_upper"))


def model_evaluation(fit: DataFrame, entity: str, digits: int = 6) -> DataFrame:
    return fit.select(entity, "metric", F.lit("LinearRegression").alias("model_type"), "n_train", "n_test",
                      *[F.round(c, digits).alias(c) for c in ("mae", "rmse", "mape")])


# -- M3 / M4: full-sample OLS with a t confidence band of the mean --------------------------------------
def series_stats(long: DataFrame, entity: str, period: str) -> DataFrame:
    x = (F.col(period) - X_ORIGIN).cast("double")
    return long.groupBy(entity, "metric").agg(
        F.regr_count("value", x).alias("n"), F.regr_avgx("value", x).alias("xbar"),
        F.regr_sxx("value", x).alias("sxx"), F.regr_sxy("value", x).alias("sxy"),
        F.regr_syy("value", x).alias("syy"), F.regr_slope("value", x).alias("slope"),
        F.regr_intercept("value", x).alias("intercept"), F.max(period).alias("last_period"))


def forecast_ci(long: DataFrame, entity: str, period: str, horizon: int | str = 5,
                min_points: int = 3, digits: int | None = FC_DIGITS) -> DataFrame:
    """Pass ``digits=None`` to keep full precision for downstream arithmetic
    (scenarios, intensities), which round once at the end.

    Consecutive future periods last+1..last+h with the 95% confidence interval
    of the fitted mean: yhat ± t(.975, n-2) · s · sqrt(1/n + (x - x̄)²/Sxx).

    ``horizon`` is a number of years or a label (1y/3y/5y/10y/2030/2040/2050).
    Series with fewer than ``min_points`` points are skipped.
    """
    from terrapanel.functions.bands import horizon_years

    st = series_stats(long, entity, period).where(F.col("n") >= min_points)
    h = F.lit(int(horizon)) if isinstance(horizon, int) else horizon_years(F.lit(horizon), F.col("last_period"))
    st = st.withColumn("h", h)
    fut = st.withColumn(period, F.explode(F.sequence(F.col("last_period") + 1, F.col("last_period") + F.col("h"))))
    tt = F.broadcast(t_table(long.sparkSession))  # fixed 200-row table
    fut = fut.join(tt, F.col("dof") == (F.col("n") - 2), "left")
    s2 = (F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx")) / (F.col("n") - 2)
    xd = (F.col(period) - X_ORIGIN).cast("double") - F.col("xbar")
    se = F.sqrt(F.greatest(s2, F.lit(0.0))) * F.sqrt(F.lit(1.0) / F.col("n") + xd * xd / F.col("sxx"))
    yhat = F.col("intercept") + F.col("slope") * (F.col(period) - X_ORIGIN)
    half = F.coalesce(F.col("t975"), t975_expansion(F.col("n") - 2)) * se
    r = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    return fut.select(entity, "metric", F.col(period).cast("int").alias(period),
                      r(yhat).alias("forecast"), r(yhat - half).alias("lower"), r(yhat + half).alias("upper"))


# -- M5 / M6 / J7: scenarios ------------------------------------------------------------------------
def scenarios(fc: DataFrame, cols: Sequence[str] = ("forecast", "lower", "upper"), digits: int = FC_DIGITS) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(f).alias("factor")) for n, f in SCENARIOS])
    x = fc.withColumn("__sc", F.explode(arr))
    out = x.select(*[c for c in fc.columns if c not in cols], F.col("__sc.scenario").alias("scenario"),
                   *[F.round(F.col(c) * F.col("__sc.factor"), digits).alias(c) for c in cols])
    return out


# -- M7: policy intensity ------------------------------------------------------------------------------
def policy_intensity(fc: DataFrame, intensities: Sequence[int] = INTENSITIES, digits: int = FC_DIGITS) -> DataFrame:
    x = fc.withColumn("intensity", F.explode(F.array(*[F.lit(int(p)) for p in intensities])))
    p = F.col("intensity") / F.lit(100.0)
    adj = F.lit(1.0) - p * F.lit(0.30) + (F.lit(1.0) - p) * F.lit(0.10)
    x = x.withColumn("forecast", F.round(F.col("forecast") * adj, digits))
    return x.withColumn("lower", F.round("lower", digits)).withColumn("upper", F.round("upper", digits))


# -- M8 / M9: direction badge and projected change ------------------------------------------------------
def direction(long: DataFrame, fc: DataFrame, entity: str, period: str) -> DataFrame:
    last_actual = long.groupBy(entity, "metric").agg(F.max_by("value", period).alias("last_actual"))
    last_fc = fc.groupBy(entity, "metric").agg(F.max_by("forecast", period).alias("last_forecast"),
                                               F.max(period).alias("target_period"))
    j = last_fc.join(last_actual, [entity, "metric"])
    pct = F.try_divide(F.col("last_forecast") - F.col("last_actual"), F.col("last_actual")) * F.lit(100.0)
    return j.select(entity, "metric", "target_period",
                    F.when(F.col("last_forecast") > F.col("last_actual"), "Medium").otherwise("Low").alias("badge"),
                    F.round(pct, 1).alias("change_pct"))


# -- M10: time-view multiplier ------------------------------------------------------------------------
def time_view(sites: DataFrame, score: str, years: Sequence[int], cap: float = 10.0, digits: int = 6) -> DataFrame:
    from terrapanel.functions.bands import risk_band

    views = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(b).alias("base"), F.lit(s).alias("slope"))
                      for v, b, s in VIEWS])
    x = (sites.withColumn("__v", F.explode(views))
              .withColumn("year", F.explode(F.array(*[F.lit(int(y)) for y in years]))))
    mult = F.col("__v.base") + F.greatest(F.lit(0), F.col("year") - VIEW_BASE_YEAR) * F.col("__v.slope")
    adj = F.least(F.lit(cap), F.col(score) * mult)
    return x.select(*[c for c in sites.columns], F.col("__v.view").alias("view"), "year",
                    F.round(adj, digits).alias("adjusted_score"), risk_band(adj).alias("adjusted_level"))
