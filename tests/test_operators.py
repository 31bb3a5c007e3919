"""Distributed helpers against brute force, with a hot group holding a third of
the rows; model and forest properties."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from terrapanel.operators import scoring as S
from terrapanel.operators.anomaly import isolation_forest
from terrapanel.operators.rank import group_percent_rank, group_positions, group_quantiles
from terrapanel.operators.window import latest_per_key


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    g = np.where(np.arange(n) < n // 3, "HOT", rng.choice(["a", "b", "c", "d"], n))
    v = np.round(rng.normal(50, 20, n), 1)  # rounding creates ties
    pdf = pd.DataFrame({"id": np.arange(n), "g": g, "v": v})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_group_positions_match_row_number(skewed):
    pdf, df = skewed
    got = group_positions(df, "g", ["v", "id"]).select("id", "pos", "grp_n").toPandas().set_index("id").sort_index()
    exp = pdf.sort_values(["g", "v", "id"]).assign(pos=lambda d: d.groupby("g").cumcount() + 1)
    exp = exp.set_index("id").sort_index()
    assert (got["pos"].to_numpy() == exp["pos"].to_numpy()).all()
    assert (got["grp_n"].to_numpy() == pdf.groupby("g")["v"].transform("size").to_numpy()).all()


def test_group_percent_rank_matches_sql_definition(skewed, spark):
    pdf, df = skewed
    got = group_percent_rank(df, "g", "v").select("id", "percent_rank").toPandas().set_index("id").sort_index()
    w = Window.partitionBy("g").orderBy("v")
    exp = df.select("id", F.percent_rank().over(w).alias("pr")).toPandas().set_index("id").sort_index()
    assert np.allclose(got["percent_rank"].to_numpy(), exp["pr"].to_numpy())


def test_group_quantiles_match_numpy(skewed):
    pdf, df = skewed
    got = group_quantiles(df, "g", "v", [0.1, 0.25, 0.5, 0.9]).toPandas().set_index("g").sort_index()
    for g, part in pdf.groupby("g"):
        exp = np.percentile(part["v"].to_numpy(), [10, 25, 50, 90])  # linear = type 7
        assert np.allclose(got.loc[g, ["q_0", "q_1", "q_2", "q_3"]].to_numpy(dtype=float), exp)


def test_quantiles_do_not_depend_on_partitioning(skewed):
    _, df = skewed
    a = group_quantiles(df.repartition(2), "g", "v", [0.5]).toPandas().sort_values("g")
    b = group_quantiles(df.repartition(13), "g", "v", [0.5]).toPandas().sort_values("g")
    assert np.allclose(a["q_0"].to_numpy(), b["q_0"].to_numpy())


def test_latest_per_key_matches_window(spark):
    rows = [("k1", 1, 0, "old"), ("k1", 2, 5, "new"), ("k1", 2, 3, "mid"), ("k2", 1, 1, "only")] * 1
    df = spark.createDataFrame(rows, "k string, batch int, seq int, payload string")
    got = {r.k: r.payload for r in latest_per_key(df, "k", ["batch", "seq"]).collect()}
    assert got == {"k1": "new", "k2": "only"}


def test_nnls_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n = 400
    x = rng.uniform(0, 10, (n, 4))
    y = np.round((x[:, 0] + x[:, 1]) / 2, 1) - 0.05 * x[:, 2] + rng.normal(0, 0.01, n)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([x, y]), columns=["a", "b", "c", "d", "y"]))
    coefs = S.fit_linear(df, "y", ["a", "b", "c", "d"], positive=True)
    w = np.array([coefs[c] for c in "abcd"])
    assert (w >= 0).all() and coefs["c"] == 0.0
    # brute force: best non-negative solution over all active sets, on the raw data
    xc, yc = x - x.mean(0), y - y.mean()
    best = None
    for mask in range(16):
        idx = [i for i in range(4) if mask >> i & 1]
        ww = np.zeros(4)
        if idx:
            ww[idx] = np.linalg.lstsq(xc[:, idx], yc, rcond=None)[0]
        if (ww < -1e-12).any():
            continue
        err = ((yc - xc @ ww) ** 2).sum()
        if best is None or err < best[0]:
            best = (err, ww)
    assert np.allclose(w, best[1], atol=1e-6)


def test_ols_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 100, (300, 2))
    y = 3 + 0.5 * x[:, 0] - 0.2 * x[:, 1] + rng.normal(0, 1, 300)
    df = spark.createDataFrame(pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "y": y}))
    c = S.fit_linear(df, "y", ["x1", "x2"])
    beta = np.linalg.lstsq(np.column_stack([np.ones(300), x]), y, rcond=None)[0]
    assert np.allclose([c["intercept"], c["x1"], c["x2"]], beta, atol=1e-8)
    m = S.metrics(df.withColumn("p", S.predict(c, ["x1", "x2"])), "y", "p").first()
    assert 0.9 < m.r2 <= 1.0


def test_isolation_forest_properties(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(0, 1, (500, 2))
    pts[0] = [9.0, 9.0]  # planted outlier
    pdf = pd.DataFrame({"k": np.arange(500), "x": pts[:, 0], "y": pts[:, 1]})
    df = spark.createDataFrame(pdf)
    a = isolation_forest(df.repartition(3), "k", ["x", "y"], contamination=0.1, trees=50, psi=128)
    ra = a.select("k", "score", "is_anomaly").toPandas().set_index("k").sort_index()
    assert ra.loc[0, "is_anomaly"]
    assert abs(ra["is_anomaly"].mean() - 0.1) < 0.02
    b = isolation_forest(df.repartition(11), "k", ["x", "y"], contamination=0.1, trees=50, psi=128)
    rb = b.select("k", "score").toPandas().set_index("k").sort_index()
    assert np.allclose(ra["score"].to_numpy(), rb["score"].to_numpy())


def test_bands_edges_and_nulls(spark):
    from terrapanel.functions.bands import gauge_band, risk_band, traffic_light
    rows = [(None,), (3.99,), (4.0,), (6.99,), (7.0,), (7.01,), (40.0,), (69.9,), (70.0,)]
    df = spark.createDataFrame(rows, "s double")
    got = df.select("s", risk_band("s", right_closed=False).alias("left"),
                    risk_band("s").alias("right"), traffic_light("s").alias("light"),
                    gauge_band("s").alias("gauge")).collect()
    for r in got:
        if r.s is None:
            assert (r.left, r.right, r.light, r.gauge) == (None, None, None, None)
            continue
        assert r.left == ("Low" if r.s < 4 else "Medium" if r.s < 7 else "High")
        assert r.right == ("Low" if r.s <= 4 else "Medium" if r.s <= 7 else "High")
        assert r.light == ("red" if r.s > 7 else "amber" if r.s > 4 else "green")
        assert r.gauge == ("low" if r.s < 40 else "medium" if r.s < 70 else "high")


def test_box_summary_matches_numpy(skewed):
    from terrapanel.operators.kpi import box_summary

    pdf, df = skewed
    got = box_summary(df, "g", "v").toPandas().set_index("g").sort_index()
    for g, part in pdf.groupby("g"):
        v = part["v"].to_numpy()
        q1, med, q3 = np.percentile(v, [25, 50, 75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        r = got.loc[g]
        assert np.allclose([r["min"], r["q1"], r["median"], r["q3"], r["max"], r["lower_fence"], r["upper_fence"]],
                           np.round([v.min(), q1, med, q3, v.max(), lo, hi], 6))
        assert r["outliers"] == int(((v < lo) | (v > hi)).sum())


def test_hot_group_of_equal_values_is_spread(spark):
    # a third of the rows share one group and one value: range bounds on
    # (group, value) alone would put them all in one task
    n = 3000
    rows = [(i, "HOT" if i < n // 3 else f"g{i % 7}", 1.0 if i < n // 3 else float(i % 101)) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    p = group_positions(df, "g", ["v"], num_partitions=8).withColumn("pid", F.spark_partition_id())
    hot = p.where("g = 'HOT'")
    assert hot.select("pid").distinct().count() > 1
    assert sorted(r.pos for r in hot.select("pos").collect()) == list(range(1, n // 3 + 1))
    q = group_quantiles(df, "g", "v", [0.5]).where("g = 'HOT'").first()
    assert q.q_0 == 1.0
