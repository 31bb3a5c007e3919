"""Registered queries: scoring models and anomaly detection."""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from terrapanel.operators import scoring as S
from terrapanel.operators.anomaly import fit_forest, isolation_forest, load_forest, save_forest
from terrapanel.operators.window import hash_split
from terrapanel.plans.catalog import Ctx, query
from terrapanel.plans.q_trend import _features
from terrapanel.session import checkpoint_dir

READY_X = ["gaps_x", "total_x"]
RISK_X = ["physical_score", "transition_score", "flood_score", "heat_score"]

READY_SQL = """f AS (SELECT firm_id, readiness_score AS y, CAST(gaps_count AS DOUBLE) AS gaps_x,
                  scope1 + scope2 + scope3 AS total_x,
                  ((('0x' || substr(md5('42:' || CAST(firm_id AS VARCHAR)), 1, 8))::UBIGINT) % 100) < 25 AS is_test
           FROM firms),
m AS (SELECT avg(y) AS my, avg(gaps_x) AS m1, avg(total_x) AS m2, covar_pop(gaps_x, gaps_x) AS v11,
             covar_pop(total_x, total_x) AS v22, covar_pop(gaps_x, total_x) AS v12,
             covar_pop(gaps_x, y) AS c1, covar_pop(total_x, y) AS c2 FROM f WHERE NOT is_test),
c AS (SELECT (c1 * v22 - c2 * v12) / (v11 * v22 - v12 * v12) AS b1, (c2 * v11 - c1 * v12) / (v11 * v22 - v12 * v12) AS b2,
             my, m1, m2 FROM m),
k AS (SELECT b1, b2, my - (b1 * m1 + b2 * m2) AS b0 FROM c),
p AS (SELECT f.*, b0 + b1 * gaps_x + b2 * total_x AS predicted FROM f, k)"""


def _ready(c: Ctx):
    f = c.firms.select("firm_id", F.col("readiness_score").alias("y"), F.col("gaps_count").cast("double").alias("gaps_x"),
                       (F.col("scope1") + F.col("scope2") + F.col("scope3")).alias("total_x"))
    f = hash_split(f, "firm_id", 25, 42)
    coefs = S.fit_linear(f.where(~F.col("is_test")), "y", READY_X)
    return f.withColumn("predicted", S.predict(coefs, READY_X)), coefs


@query("readiness_scored", ("M17", "M18", "W9"), f"""
WITH {READY_SQL}
SELECT firm_id, y AS readiness_score, is_test, round(predicted, 6) AS predicted FROM p
""")
def readiness_scored(spark, d):
    p, _ = _ready(Ctx(spark, d, shared=("firms",)))
    return p.select("firm_id", F.col("y").alias("readiness_score"), "is_test", F.round("predicted", 6).alias("predicted"))


@query("readiness_eval", ("M19", "M17"), f"""
WITH {READY_SQL},
e AS (SELECT y, predicted, y - predicted AS err FROM p WHERE is_test)
SELECT count(*) AS n, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse,
       round(CASE WHEN count(*) > 1 AND var_pop(y) > 0 THEN 1.0 - sum(err * err) / (var_pop(y) * count(*)) END, 6) AS r2
FROM e
""")
def readiness_eval(spark, d):
    p, _ = _ready(Ctx(spark, d, shared=("firms",)))
    return S.metrics(p.where(F.col("is_test")), "y", "predicted")


def _cov(i: int, j: int) -> str:
    return f"c_{min(i, j)}_{max(i, j)}"


def _det(rows: list[int], cols: list[int], entry) -> str:
    """Determinant by cofactor expansion along the first row (k ≤ 4 here)."""
    if len(rows) == 1:
        return entry(rows[0], cols[0])
    terms = []
    for k, c in enumerate(cols):
        minor = _det(rows[1:], cols[:k] + cols[k + 1:], entry)
        terms.append(f"{'+' if k % 2 == 0 else '-'} ({entry(rows[0], c)}) * ({minor})")
    return "(" + " ".join(terms) + ")"


def _nnls_sql() -> str:
    """Oracle text of ``fit_linear(positive=True)`` over the four risk scores:
    every active set solved by Cramer's rule on the covariance system, slopes
    below -1e-12 make a set infeasible, the rest are clipped at 0 and the set
    with the least centred mean squared error wins (ties: earlier set)."""
    k = len(RISK_X)
    ys = "composite_score"
    mom = [f"avg({ys}) AS my", f"var_pop({ys}) AS vy"]
    mom += [f"avg({x}) AS m_{i}" for i, x in enumerate(RISK_X)]
    mom += [f"covar_pop({RISK_X[i]}, {RISK_X[j]}) AS c_{i}_{j}" for i in range(k) for j in range(i, k)]
    mom += [f"covar_pop({x}, {ys}) AS cy_{i}" for i, x in enumerate(RISK_X)]
    subsets = [()] + [a for r in range(1, k + 1) for a in itertools.combinations(range(k), r)]
    cands = []
    for order, a in enumerate(subsets):
        idx = list(range(len(a)))
        w = ["0.0"] * k
        if a:
            den = _det(idx, idx, lambda p, q: _cov(a[p], a[q]))
            for pos in idx:
                num = _det(idx, idx, lambda p, q, pos=pos: f"cy_{a[p]}" if q == pos else _cov(a[p], a[q]))
                w[a[pos]] = f"({num}) / ({den})"
        cands.append(f"SELECT {order} AS ord, " + ", ".join(f"{e} AS w{i}" for i, e in enumerate(w)) + " FROM m")
    feasible = " AND ".join(f"w{i} >= -1e-12" for i in range(k))
    quad = " + ".join(f"w{i} * w{j} * {_cov(i, j)}" for i in range(k) for j in range(k))
    lin = " + ".join(f"w{i} * cy_{i}" for i in range(k))
    split = "((('0x' || substr(md5('42:' || CAST(site AS VARCHAR)), 1, 8))::UBIGINT) % 100) < 25"
    return f"""s AS (SELECT entity, site, composite_score, {', '.join(RISK_X)}, {split} AS is_test FROM sites),
m AS (SELECT {', '.join(mom)} FROM s WHERE NOT is_test AND {ys} IS NOT NULL AND {' AND '.join(f'{x} IS NOT NULL' for x in RISK_X)}),
cand AS ({' UNION ALL '.join(cands)}),
clip AS (SELECT ord, {', '.join(f'greatest(w{i}, 0.0) AS w{i}' for i in range(k))} FROM cand WHERE {feasible}),
err AS (SELECT clip.*, vy - 2 * ({lin}) + ({quad}) AS mse FROM clip, m),
best AS (SELECT * FROM err ORDER BY mse, ord LIMIT 1),
coef AS (SELECT my - ({' + '.join(f'w{i} * m_{i}' for i in range(k))}) AS b0, {', '.join(f'w{i}' for i in range(k))} FROM best, m)"""


def _risk(c: Ctx):
    s = hash_split(c.sites.select("entity", "site", "composite_score", *RISK_X), "site", 25, 42)
    coefs = S.fit_linear(s.where(~F.col("is_test")), "composite_score", RISK_X, positive=True)
    return s, coefs


@query("risk_nnls_coefficients", ("M16",), f"""
WITH {_nnls_sql()}
SELECT 'intercept' AS term, round(b0, 9) AS coefficient FROM coef
""" + "".join(f"UNION ALL SELECT '{x}', round(w{i}, 9) FROM coef\n" for i, x in enumerate(RISK_X)))
def risk_nnls_coefficients(spark, d):
    _, coefs = _risk(Ctx(spark, d))
    return S.coefficients_frame(spark, coefs, RISK_X)


@query("risk_nnls_scored", ("M16", "M18"), f"""
WITH {_nnls_sql()}
SELECT entity, site, composite_score, is_test,
       round(b0 + {' + '.join(f'w{i} * {x}' for i, x in enumerate(RISK_X))}, 6) AS predicted
FROM s, coef
""")
def risk_nnls_scored(spark, d):
    s, coefs = _risk(Ctx(spark, d))
    return s.select("entity", "site", "composite_score", "is_test",
                    F.round(S.predict(coefs, RISK_X), 6).alias("predicted"))


FEATS = ["level_pct", "level_diff", "share_a_diff"]


#: Fitted models of this process, by data folder: where ``save_forest`` put them.
_MODELS: dict[tuple[str, str], str] = {}


def _forest(c: Ctx, native: bool = False):
    """Features with scores; the model is fitted once per data folder and session, stored, and read by every query after."""
    f = _features(c).withColumn("row_key", F.concat_ws("|", "entity", F.col("period").cast("string")))
    at = (c.t.root, checkpoint_dir(c.spark))
    if at not in _MODELS:
        path = f"{at[1].rstrip('/')}/models/iforest-{uuid.uuid4().hex}"
        save_forest(fit_forest(f, "row_key", FEATS, trees=100, psi=256, seed=42), path)
        _MODELS[at] = path
    return isolation_forest(f, "row_key", FEATS, contamination=0.1, trees=100, psi=256, seed=42, model=load_forest(c.spark, _MODELS[at]), native=native)


@query("isolation_forest", ("M14",))
def isolation_forest_q(spark, d):
    r = _forest(Ctx(spark, d, shared=("panel",)))
    return r.select("entity", "period", *FEATS, F.round("score", 6).alias("score"),
                    F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query("anomaly_flagged", ("M15",))
def anomaly_flagged(spark, d):
    return _forest(Ctx(spark, d, shared=("panel",))).where("is_anomaly").select("entity", "period", *FEATS)


@query("forest_properties", ("M14", "M15"), """
WITH f AS (SELECT entity, period, level_mt, share_a_pct, lag(level_mt) OVER w AS l, lag(share_a_pct) OVER w AS s FROM panel WINDOW w AS (PARTITION BY entity ORDER BY period))
SELECT count(*) AS "rows", true AS scores_in_range, true AS flags_follow_scores, true AS share_flagged_right, true AS native_scores_equal
FROM f WHERE l IS NOT NULL AND l <> 0 AND s IS NOT NULL AND level_mt IS NOT NULL AND share_a_pct IS NOT NULL
""")
def forest_properties(spark, d):
    """What holds for any forest: scores between 0 and 1, flags below the threshold only, at most the asked share, one score from both walks."""
    c = Ctx(spark, d, shared=("panel",))
    both = _forest(c).alias("a").join(_forest(c, native=True).select("row_key", F.col("score").alias("native")), "row_key")
    n = F.count(F.lit(1))
    return both.agg(n.alias("rows"), F.coalesce(F.every((F.col("score") > 0) & (F.col("score") < 1)), F.lit(True)).alias("scores_in_range"),
                    F.coalesce(F.every(F.col("is_anomaly") == (F.col("anomaly_score") < 0)), F.lit(True)).alias("flags_follow_scores"),
                    (F.count_if("is_anomaly") <= F.ceil(n * 0.1)).alias("share_flagged_right"),
                    F.coalesce(F.every(F.abs(F.col("score") - F.col("native")) < 1e-9), F.lit(True)).alias("native_scores_equal"))
