"""Cases that earlier versions got wrong: ranged positions, publishing, contract, number text, bands."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import Window, functions as F

from terrapanel.functions.text import json_sorted, numbers, py_str
from terrapanel.operators import quality as Q
from terrapanel.operators import trend as T
from terrapanel.operators.anomaly import fit_forest
from terrapanel.operators.clean import clean
from terrapanel.operators.kpi import sector_benchmark
from terrapanel.operators.rank import group_percent_rank, group_positions, group_quantiles
from terrapanel.registry import CO2_ENERGY, COMPANY_ESG, PANEL
from terrapanel.sources import files as FS
from terrapanel.sources import publish as P

PANEL_DDL = "country_code string, year int, co2_emissions_mt double, renewable_share_pct double"


def written(df, tmp_dir, name):
    """The frame as written, not as a pruned count sees it."""
    path = os.path.join(tmp_dir, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@pytest.mark.parametrize("parts", [16, 64, 200])
def test_positions_above_the_sample_size(spark, tmp_dir, parts):
    """A million rows with a payload column; one group and one value hold a third of them."""
    df = spark.range(0, 1_000_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"),
        F.when(F.col("id") % 5 < 2, F.lit(0.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("double")).alias("v"),
        F.col("id").alias("key"), F.sha1(F.col("id").cast("string")).alias("payload"))
    got = written(group_positions(df, "g", ["v"], parts), tmp_dir, "pos")
    assert got.count() == 1_000_000
    w = Window.partitionBy("g")
    wrong = (got.withColumn("lo", F.min("pos").over(Window.partitionBy("g", "v"))).withColumn("rank", F.rank().over(w.orderBy("v")))
             .withColumn("n", F.count(F.lit(1)).over(w)))
    assert wrong.filter("lo <> rank or n <> grp_n").isEmpty()
    assert got.select("g", "pos").distinct().count() == 1_000_000
    if parts == 64:
        pr = written(group_percent_rank(df, "g", "v", parts), tmp_dir, "pr")
        assert pr.count() == 1_000_000
        assert pr.withColumn("want", F.percent_rank().over(w.orderBy("v"))).filter(F.abs(F.col("want") - F.col("percent_rank")) > 1e-12).isEmpty()
        bench = written(sector_benchmark(df.withColumnRenamed("g", "sector"), "sector", "v", "key"), tmp_dir, "bench")
        assert bench.count() == 1_000_000 and bench.select("key").distinct().count() == 1_000_000
        q = {r.g: (r.q_0, r.q_1) for r in group_quantiles(df, "g", "v", [0.5, 0.9], parts).collect()}
        want = {r.g: (r.a, r.b) for r in df.groupBy("g").agg(F.expr("percentile(v, 0.5)").alias("a"), F.expr("percentile(v, 0.9)").alias("b")).collect()}
        assert q.keys() == want.keys() and all(q[g] == pytest.approx(want[g]) for g in q)


def test_positions_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 1.0), ("a", None), ("a", 3.0)], "g string, v double")
    got = sorted((str(r.g), str(r.v), r.pos, r.grp_n) for r in group_positions(df, "g", "v").collect())
    assert got == [("None", "1.0", 1, 2), ("None", "2.0", 2, 2), ("a", "3.0", 2, 2), ("a", "None", 1, 2)]
    assert group_percent_rank(df, "g", "v").count() == 4


def panel(spark, rows):
    return spark.createDataFrame(rows, PANEL_DDL)


def current(spark, root):
    return {(r.country_code, r.year): r.co2_emissions_mt for r in P.read_current(spark, root, CO2_ENERGY).collect()}


def test_partial_load_keeps_other_keys(spark, tmp_dir):
    P.publish(panel(spark, [("DE", 2023, 670.0, 52.0), ("AT", 2023, 60.0, 70.0)]), tmp_dir, CO2_ENERGY, "a-0")
    P.publish(panel(spark, [("CH", 2023, 40.0, 60.0), ("AT", 2023, 61.0, 70.0)]), tmp_dir, CO2_ENERGY, "a-1", partial=True)
    assert current(spark, tmp_dir) == {("DE", 2023): 670.0, ("AT", 2023): 61.0, ("CH", 2023): 40.0}
    P.publish(panel(spark, [("CH", 2023, 41.0, 60.0)]), tmp_dir, CO2_ENERGY, "a-2")
    assert current(spark, tmp_dir) == {("CH", 2023): 41.0}


def test_published_ids_are_not_rewritten(spark, tmp_dir):
    P.publish(panel(spark, [("DE", 2023, 670.0, 52.0)]), tmp_dir, CO2_ENERGY, "s-0")
    again = P.publish(panel(spark, [("DE", 2023, 1.0, 1.0)]), tmp_dir, CO2_ENERGY, "s-0")
    assert again.status == "already_published" and current(spark, tmp_dir) == {("DE", 2023): 670.0}
    with pytest.raises(ValueError):
        P.write_snapshot(panel(spark, [("DE", 2023, 1.0, 1.0)]), tmp_dir, CO2_ENERGY, "s-0")


def test_crash_before_the_pointer(spark, tmp_dir):
    """A snapshot folder that no pointer names is invisible, and the replay replaces it."""
    P.publish(panel(spark, [("DE", 2023, 670.0, 52.0)]), tmp_dir, CO2_ENERGY, "s-0")
    panel(spark, [("XX", 1, 1.0, 1.0)]).write.parquet(os.path.join(tmp_dir, "co2_energy", "snapshot=s-1"))
    assert current(spark, tmp_dir) == {("DE", 2023): 670.0}
    P.publish(panel(spark, [("DE", 2023, 671.0, 52.0)]), tmp_dir, CO2_ENERGY, "s-1")
    assert current(spark, tmp_dir) == {("DE", 2023): 671.0} and P.current_snapshot_id(spark, tmp_dir, CO2_ENERGY) == "s-1"


def test_new_columns_duplicates_and_empty_previous(spark, tmp_dir):
    P.write_snapshot(panel(spark, []), tmp_dir, CO2_ENERGY, "empty")
    r = P.publish(panel(spark, [("DE", 2023, 670.0, 52.0), ("DE", 2023, 670.0, 52.0), ("DE", 2023, 660.0, 52.0)]), tmp_dir, CO2_ENERGY, "n-0")
    assert r.rows_compared == 0 and P.read_current(spark, tmp_dir, CO2_ENERGY).count() == 1
    more = panel(spark, [("DE", 2023, 671.0, 52.0), ("AT", 2023, 60.0, 70.0)]).withColumn("nuclear_share_pct", F.lit(1.5))
    assert P.publish(more, tmp_dir, CO2_ENERGY, "n-1").status == "published"
    assert P.publish(panel(spark, [("DE", 2023, 672.0, 52.0)]), tmp_dir, CO2_ENERGY, "n-2", partial=True).status == "published"
    got = {r.country_code: (r.co2_emissions_mt, r.nuclear_share_pct) for r in P.read_current(spark, tmp_dir, CO2_ENERGY).collect()}
    assert got == {"DE": (672.0, None), "AT": (60.0, 1.5)}


def test_contract_rejects_junk(spark):
    row = {"company_id": "  ", "company_name": "n", "country_code": "DE", "sector": "s", "scope1_tco2e": "abc", "scope2_tco2e": "1",
           "scope3_tco2e": "1", "esg_readiness_score": "5", "csrd_readiness_score": "5", "reporting_gaps_count": "1"}
    df = spark.createDataFrame([row], ", ".join(f"{k} string" for k in row))
    got = Q.validate(df, COMPANY_ESG).first()
    assert not got.is_valid and {(v.field, v.rule) for v in got._violations} == {("company_id", "blank"), ("scope1_tco2e", "not_a_number")}


def test_gate_compares_the_exact_rate(spark):
    df = spark.range(10_000_000).select((F.col("id") >= 500_004).alias("is_valid"))
    rep = Q.validation_report(df, PANEL).first()
    assert rep.pass_rate == 0.95 and not rep.passed


def test_clean_all_text_frame_and_company_rules(spark):
    df = spark.createDataFrame([(" de ", "2023", "670.5", "140", "x"), ("AT", "2022", "bad", "50", "x")],
                               "country_code string, year string, co2_emissions_mt string, renewable_share_pct string, data_quality string")
    assert [tuple(r) for r in clean(df, CO2_ENERGY).collect()] == [("DE", 2023, 670.5, 100.0, "x")]
    c = spark.createDataFrame([("A", "DE", -5.0), ("B", None, 3.0)], "company_id string, country_code string, esg_readiness_score double")
    assert [tuple(r) for r in clean(c, COMPANY_ESG).collect()] == [("A", "DE", 0.0)]


NUMBERS = [0.0, -0.0, 1.0, 12345678.9, 0.00012, 0.0001, 0.00009999, 1e-5, 1.5e-7, 9999999999999998.0, 1e16, 1.5e16, 123456789012345.6, 0.1,
           -2.5, 1e7, 1.0e22, 3.141592653589793, 100000.5, 0.001, 1e-3 + 1e-9, 7e-300, 1e300]


def test_number_text_is_pythons(spark):
    df = spark.createDataFrame([(x,) for x in NUMBERS], "x double").select("x", py_str("x").alias("t"))
    assert [r.t for r in df.collect()] == [str(x) for x in NUMBERS]
    got = df.filter("abs(x) >= 0.0001 and abs(x) < 1e16").select("x", numbers("t").alias("n")).collect()
    assert all(r.n == [r.x] for r in got)


def test_json_text_with_any_separator(spark):
    df = spark.createDataFrame([("a b\u0085c \"q\" é",)], "t string").select(json_sorted({"t": F.col("t")}).alias("j"))
    import json

    assert json.loads(df.first().j) == {"t": "a b\u0085c \"q\" é"}


def test_bands_of_long_series(spark):
    for dof in (201, 500, 5000):
        got = spark.range(1).select(T.t975_expansion(F.lit(dof)).alias("t")).first().t
        assert got == pytest.approx(T.t_quantile(0.975, dof), abs=2e-9)
    assert T.t_quantile(0.975, 200) == pytest.approx(1.971896, abs=1e-6)
    long = spark.range(300).select(F.lit("e").alias("entity"), F.lit("m").alias("metric"), (F.col("id") + 1700).cast("int").alias("period"),
                                   (F.col("id") * 2 + F.col("id") % 7).cast("double").alias("value"))
    rows = T.forecast_ci(long, "entity", "period", horizon=3).collect()
    assert len(rows) == 3 and all(r.lower < r.forecast < r.upper for r in rows)


@pytest.mark.parametrize("n", [40, 3000, 60_000])
def test_forest_samples_exactly_psi_rows(spark, n):
    df = spark.range(n).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    nodes = fit_forest(df, "id", ["a", "b"], trees=20, psi=64).filter("node = 0").collect()
    assert len(nodes) == 20 and {r["size"] for r in nodes} == {min(64, n)}


def test_latest_run_and_fallback(spark, tmp_dir):
    FS.land(spark.range(3), tmp_dir, "d", "20240101T000000Z")
    FS.land(spark.range(5), tmp_dir, "d", "20240102T000000Z")
    got = FS.read_latest_run(spark, tmp_dir, "d")
    assert got.count() == 5 and {r._run_id for r in got.collect()} == {"20240102T000000Z"}

    def bug():
        raise KeyError("a bug is no missing source")

    with pytest.raises(KeyError):
        FS.first_available([("x", bug)])
    ok = FS.first_available([("x", lambda: spark.read.parquet(os.path.join(tmp_dir, "nowhere"))), ("y", lambda: spark.range(1))])
    assert ok.first().data_quality == "y"
