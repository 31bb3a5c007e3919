"""Interpretable scoring models.

A linear fit needs only the covariance matrix of (X, y): one ``agg`` of
``covar_pop`` terms, algebraic, so each task ships one partial state per
aggregate and the result is a k×k matrix whatever the row count.  That small
matrix is solved on the driver (OLS directly; non-negative least squares by
trying every active set, exact for the handful of predictors used here), and
rows are scored with a column expression holding the coefficients as literals.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def moments(df: DataFrame, y: str, xs: Sequence[str]) -> dict:
    """Means, covariance matrix of xs, covariances with y, variance of y, n
    (rows with a null in y or any x are skipped)."""
    xs = list(xs)
    data = df.select(y, *xs).na.drop()
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(y).alias("my"), F.var_pop(y).alias("vy")]
    aggs += [F.avg(x).alias(f"m_{i}") for i, x in enumerate(xs)]
    aggs += [F.covar_pop(xs[i], xs[j]).alias(f"c_{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    aggs += [F.covar_pop(xs[i], y).alias(f"cy_{i}") for i in range(len(xs))]
    r = data.agg(*aggs).first().asDict()  # one row of k*(k+3)/2 + 3 numbers
    k = len(xs)
    cxx = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            cxx[i, j] = cxx[j, i] = r[f"c_{i}_{j}"] or 0.0
    return {"n": r["n"], "my": r["my"], "vy": r["vy"], "mx": np.array([r[f"m_{i}"] for i in range(k)], dtype=float),
            "cxx": cxx, "cxy": np.array([r[f"cy_{i}"] or 0.0 for i in range(k)]), "xs": xs, "y": y}


def _solve(m: dict, active: Sequence[int]) -> np.ndarray:
    k = len(m["xs"])
    w = np.zeros(k)
    if active:
        a = list(active)
        w[a] = np.linalg.lstsq(m["cxx"][np.ix_(a, a)], m["cxy"][a], rcond=None)[0]
    return w


def _sse(m: dict, w: np.ndarray) -> float:
    # per-row mean squared error of the centred fit: var(y) - 2 w'cxy + w'Cw
    return float(m["vy"] - 2 * w @ m["cxy"] + w @ m["cxx"] @ w)


def fit_linear(df: DataFrame, y: str, xs: Sequence[str], positive: bool = False) -> dict:
    """Coefficients ``{"intercept": b0, x: b, ...}`` of y ~ xs (least squares).

    ``positive=True`` constrains the slopes to be ≥ 0 (intercept free): every
    active set is solved and the feasible one that satisfies the optimality
    conditions with the least error is kept."""
    m = moments(df, y, xs)
    k = len(xs)
    if not positive:
        w = _solve(m, range(k))
    else:
        best, best_err = np.zeros(k), _sse(m, np.zeros(k))
        for r in range(1, k + 1):
            for a in itertools.combinations(range(k), r):
                w = _solve(m, a)
                if (w[list(a)] < -1e-12).any():
                    continue
                w = np.maximum(w, 0.0)
                err = _sse(m, w)
                if err < best_err - 1e-15:
                    best, best_err = w, err
        w = best
    b0 = float(m["my"] - w @ m["mx"])
    out = {"intercept": b0}
    out.update({x: float(v) for x, v in zip(xs, w)})
    out["_n"] = m["n"]
    return out


def predict(coefs: dict, xs: Sequence[str]) -> Column:
    return sum((F.lit(coefs[x]) * F.col(x) for x in xs), F.lit(coefs["intercept"]))


def coefficients_frame(spark, coefs: dict, xs: Sequence[str], digits: int = 9) -> DataFrame:
    rows = [("intercept", round(coefs["intercept"], digits))] + [(x, round(coefs[x], digits)) for x in xs]
    return spark.createDataFrame(rows, "term string, coefficient double")


def metrics(df: DataFrame, y: str, pred: str, digits: int = 6) -> DataFrame:
    """MAE, RMSE and R² (null when n ≤ 1 or y is constant)."""
    e = F.col(y) - F.col(pred)
    g = df.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
               F.sum(e * e).alias("sse"), F.var_pop(y).alias("vy"))
    r2 = F.when((F.col("n") > 1) & (F.col("vy") > 0), F.lit(1.0) - F.col("sse") / (F.col("vy") * F.col("n")))
    return g.select("n", F.round("mae", digits).alias("mae"), F.round("rmse", digits).alias("rmse"),
                    F.round(r2, digits).alias("r2"))
