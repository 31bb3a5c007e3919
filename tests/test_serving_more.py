"""Deep pages, tolerances by volatility, report tables, recommendations, the stored forest."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from terrapanel.operators import anomaly as A
from terrapanel.operators import kpi as K
from terrapanel.operators import reconcile as R
from terrapanel.operators import text as X
from terrapanel.registry import CO2_ENERGY, TOL_HIGH_VOLATILITY
from terrapanel.sources import pages as G


def test_page_100000_reads_one_file(spark, tmp_dir):
    df = spark.range(1_000_010).select(((F.col("id") * 7919) % 1_000_010).alias("k"), F.col("id").alias("v"))
    p = G.Pages(spark, os.path.join(tmp_dir, "p"), [("k", True)]).write(df)
    page = p.page(100_000, 10)
    assert [r.k for r in page.collect()] == list(range(999_990, 1_000_000)) and len(page.inputFiles()) == 1
    assert [r.k for r in p.page(100_001, 10).collect()] == list(range(1_000_000, 1_000_010)) and p.page(100_002, 10).count() == 0
    after = p.page_after({"k": 500_004}, 10)
    assert [r.k for r in after.collect()] == list(range(500_005, 500_015)) and len(after.inputFiles()) <= 2
    assert p.rows == 1_000_010


@pytest.mark.parametrize("up", [True, False])
def test_pages_equal_offset_and_limit(spark, tmp_dir, monkeypatch, up):
    """A third of the rows share one key, some have none: every row is on one page, in order."""
    monkeypatch.setattr(G, "SLICE_ROWS", 40)
    rows = [(None if i % 10 == 9 else 5 if i % 3 == 0 else i % 50, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(4)
    p = G.Pages(spark, os.path.join(tmp_dir, "p"), [("k", up), ("v", True)]).write(df)
    key = lambda r: ((r[0] is not None, r[0] or 0, r[1]) if up else (r[0] is None, -(r[0] or 0), r[1]))
    want = sorted(rows, key=key)
    got = [tuple(r) for n in range(1, 13) for r in p.page(n, 27).collect()]
    assert got == want and len(p.slices()) >= 6
    at, walked = None, []
    while part := [tuple(r) for r in p.page_after(at, 70).collect()]:
        walked += part
        at = {"k": part[-1][0], "v": part[-1][1]}
    assert walked == want
    ties = G.Pages(spark, os.path.join(tmp_dir, "t"), [("k", up)]).write(df)  # equal keys: any order, but one
    got = [tuple(r) for n in range(1, 13) for r in ties.page(n, 27).collect()]
    assert sorted(got, key=key) == want and [r[0] for r in got] == [r[0] for r in want]


def test_pages_of_an_empty_table(spark, tmp_dir):
    p = G.Pages(spark, os.path.join(tmp_dir, "p"), [("k", True)]).write(spark.createDataFrame([], "k int, v string"))
    assert p.page(1).collect() == [] and p.page(1).columns == ["k", "v"] and p.page_after({"k": 1}).collect() == []
    with pytest.raises(ValueError):
        p.page(0)


def test_tolerance_follows_the_series_own_past(spark):
    ddl = "country_code string, year int, co2_emissions_mt double, renewable_share_pct double"
    calm, wild = [100.0, 101, 99, 100, 102, 400], [100.0, 140, 90, 130, 80, 120]  # one bad pull doesn't make a series volatile
    rows = [(c, 2000 + i, float(x), 50.0) for c, own in (("DE", calm), ("AT", wild)) for i, x in enumerate(own)]
    hist = spark.createDataFrame(rows, ddl)
    tol = {r.country_code: (r.tol_co2_emissions_mt, r.tol_renewable_share_pct) for r in R.volatility_tolerances(hist, CO2_ENERGY).collect()}
    assert tol == {"DE": (0.15, 0.15), "AT": (TOL_HIGH_VOLATILITY, 0.15)}
    new = spark.createDataFrame([("DE", 2000, 130.0, 50.0), ("AT", 2000, 130.0, 50.0), ("AT", 2001, 200.0, 50.0), ("CH", 2000, 1.0, 1.0)], ddl)
    found = sorted((r.country_code, r.year, r.tolerance) for r in R.anomalies(R.compare(new, hist, CO2_ENERGY, R.volatility_tolerances(hist, CO2_ENERGY)), CO2_ENERGY).collect())
    assert found == [("AT", 2001, 0.4), ("DE", 2000, 0.15)]
    by_column = R.compare(new, hist, CO2_ENERGY, {"co2_emissions_mt": 0.35})
    assert [(r.country_code, r.year) for r in R.anomalies(by_column, CO2_ENERGY).collect()] == [("AT", 2001)]
    assert set(by_column.columns) == {"country_code", "year", "co2_emissions_mt", "renewable_share_pct", "_anomalies", "_matched"}


def test_recommendation_names_the_score(spark):
    df = spark.createDataFrame([(6.5,), (None,)], "c double").select(X.risk_recommendation(F.col("c"), "de").alias("de"), X.risk_recommendation(F.col("c")).alias("en"))
    a, b = df.collect()
    assert "6.5/10" in a.de and a.de.startswith("[Offline-Modus]") and "6.5/10" in a.en and "0/10" in b.en


def test_report_tables(spark):
    panel = spark.createDataFrame([("DE", 2022, 10.04, 1.0), ("DE", 2023, 9.96, 2.0), ("AT", 2023, 5.0, None)], "e string, y int, co2 double, share double")
    sites = spark.createDataFrame([("DE", "a", 4.0), ("DE", "b", 5.1)], "e string, site string, risk double")
    firms = spark.createDataFrame([("AT", "f", 50.0)], "e string, firm string, ready double")
    got = {r.e: tuple(r)[1:] for r in K.report_summary(panel, sites, firms, "e", "y", ["co2", "share"], "risk", "ready").collect()}
    assert got["DE"] == (2023, 10.0, 2.0, 4.6, 2, None, None) and got["AT"] == (2023, 5.0, None, None, None, 50.0, 1)
    assert K.report_details(sites, "e", ["site"], "DE").count() == 2 and K.report_details(sites, "e", ["site"], ["AT"]).count() == 0


def test_stored_forest_scores_alike_in_both_walks(spark, tmp_dir):
    df = spark.range(3000).select("id", F.randn(1).alias("a"), F.when(F.col("id") % 40 == 0, 9.0).otherwise(F.randn(2)).alias("b"))
    nodes = A.save_forest(A.fit_forest(df, "id", ["a", "b"], trees=30, psi=64), os.path.join(tmp_dir, "m"))
    one = A.score_forest(df, nodes, ["a", "b"], 64).select("id", "score")
    two = A.score_forest_native(df, nodes, ["a", "b"], 64).select("id", F.col("score").alias("native"))
    assert one.join(two, "id").agg(F.max(F.abs(F.col("score") - F.col("native")))).first()[0] < 1e-12
    plan = A.score_forest_native(df, nodes, ["a", "b"], 64)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    again = A.isolation_forest(df, "id", ["a", "b"], trees=30, psi=64, model=A.load_forest(spark, os.path.join(tmp_dir, "m")), native=True)
    assert again.where("is_anomaly").count() <= 300 and np.isclose(again.agg(F.avg("score")).first()[0], one.agg(F.avg("score")).first()[0])


def test_two_forest_queries_fit_once(spark, monkeypatch):
    from terrapanel.plans import q_models
    from terrapanel.plans.catalog import load_all

    load_all()["isolation_forest"].fn(spark, SF_SMALL)
    monkeypatch.setattr(q_models, "fit_forest", lambda *a, **k: pytest.fail("fitted again"))
    assert load_all()["anomaly_flagged"].fn(spark, SF_SMALL).count() > 0
