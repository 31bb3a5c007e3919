"""Banding expressions (P16-P18, M4, M10).  Nulls stay null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Fixed values (business rules that results must match):
# risk bands: right-closed (-inf,4] Low, (4,7] Medium, (7,inf) High;
#   the stored column is left-closed: <4 Low, <7 Medium, else High.
# traffic light on a 0..10 score: >7 red, >4 amber, else green.
# readiness gauge 0..100: <40 low, <70 medium, else high; advice cut <60.
# forecast horizons: 1y, 3y, 5y, 10y; target years 2030, 2040, 2050 → max(1, year-last);
#   anything else → 5.
# ---------------------------------------------------------------------------
RISK_RIGHT_CLOSED = ((4.0, "Low"), (7.0, "Medium"))
RISK_HIGH = "High"
TRAFFIC = ((7.0, "red"), (4.0, "amber"))
GAUGE = ((40.0, "low"), (70.0, "medium"))
READINESS_CUT = 60.0
HORIZONS = {"1y": 1, "3y": 3, "5y": 5, "10y": 10}
TARGET_YEARS = (2030, 2040, 2050)
DEFAULT_HORIZON = 5


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def risk_band(score: str | Column, right_closed: bool = True) -> Column:
    """P16 (right-closed, the dashboard's cut) or P17 (left-closed, the stored column)."""
    s = _c(score)
    expr = None
    for edge, label in RISK_RIGHT_CLOSED:
        cond = (s <= edge) if right_closed else (s < edge)
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(expr.otherwise(RISK_HIGH))


def traffic_light(score: str | Column) -> Column:
    s = _c(score)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when(s > TRAFFIC[0][0], TRAFFIC[0][1]).when(s > TRAFFIC[1][0], TRAFFIC[1][1]).otherwise("green"))


def gauge_band(score: str | Column) -> Column:
    s = _c(score)
    return (F.when(s.isNull(), F.lit(None).cast("string"))
             .when(s < GAUGE[0][0], GAUGE[0][1]).when(s < GAUGE[1][0], GAUGE[1][1]).otherwise("high"))


def horizon_years(horizon: str | Column, last_period: str | Column) -> Column:
    """M4: horizon label → number of years ahead."""
    h, last = _c(horizon), _c(last_period)
    expr = F.when(F.lit(False), F.lit(0))
    for label, years in HORIZONS.items():
        expr = expr.when(h == label, F.lit(years))
    for y in TARGET_YEARS:
        expr = expr.when(h == str(y), F.greatest(F.lit(1), F.lit(y) - last))
    return expr.otherwise(F.lit(DEFAULT_HORIZON)).cast("int")
