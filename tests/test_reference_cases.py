"""The reference's own assertions, re-stated over DataFrames, plus the edge
cases it lacks (null share, band edges, previous value 0, change equal to the
tolerance, duplicate previous keys, keep-previous policy, tab in a code,
fractional year)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terrapanel.functions import bands as B
from terrapanel.functions import labels as L
from terrapanel.functions.clean import to_number
from terrapanel.operators import clean as C
from terrapanel.operators import quality as Q
from terrapanel.operators import reconcile as R
from terrapanel.operators import text as X
from terrapanel.operators import trend as T
from terrapanel.registry import CO2_ENERGY, COMPANY_ESG, REGIONAL_RISK

PANEL_DDL = "country_code string, year int, co2_emissions_mt double, renewable_share_pct double"


def test_clean_panel_keep_last_and_clamp(spark):
    df = spark.createDataFrame([("de", 2020, 700.0, 130.0, 1, 0), ("DE", 2020, 690.0, 50.0, 1, 1)],
                               PANEL_DDL + ", _batch int, _row_seq long")
    out = C.clean(df, CO2_ENERGY).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.country_code, r.co2_emissions_mt, r.renewable_share_pct) == ("DE", 690.0, 50.0)


def test_clean_scores_clamp_and_trim(spark):
    df = spark.createDataFrame([("at", " Vienna ", 12.0, -1.0, 5.0, 5.0, 5.0, "Medium")],
                               "country_code string, region string, physical_risk_score double, "
                               "transition_risk_score double, flood_risk_score double, heat_stress_score double, "
                               "composite_climate_risk_score double, risk_level string")
    r = C.clean(df, REGIONAL_RISK, order_by=()).first()
    assert (r.country_code, r.region, r.physical_risk_score, r.transition_risk_score) == ("AT", "Vienna", 10.0, 0.0)


def test_null_share_stays_null_and_silver_turns_it_to_zero(spark):
    df = spark.createDataFrame([("DE", 2020, 700.0, None, 1, 0)], PANEL_DDL + ", _batch int, _row_seq long")
    kept = C.clean(df, CO2_ENERGY, dropna=("country_code", "year")).first()
    assert kept.renewable_share_pct is None
    silver = C.clean(df, CO2_ENERGY, null_as_lower=True, dropna=("country_code", "year")).first()
    assert silver.renewable_share_pct == 0.0


def test_leading_tab_is_stripped(spark):
    df = spark.createDataFrame([("\tde ", 2020, 1.0, 1.0, 1, 0)], PANEL_DDL + ", _batch int, _row_seq long")
    assert C.clean(df, CO2_ENERGY).first().country_code == "DE"


def test_fractional_year_is_rejected_not_truncated(spark):
    df = spark.createDataFrame([("2020.5",), ("2020",), ("abc",)], "y string")
    got = [r.v for r in df.select(to_number("y", integral=True).alias("v")).collect()]
    assert got == [None, 2020, None]


def test_row_contract_gate(spark):
    df = spark.createDataFrame([("DE", 2020, 700.0, 50.0, "official"), ("XX", 2020, 700.0, 50.0, "official")],
                               PANEL_DDL + ", data_quality string")
    rep = Q.validation_report(Q.validate(df, CO2_ENERGY), CO2_ENERGY).first()
    assert (rep.total_rows, rep.valid_rows, rep.invalid_rows) == (2, 1, 1)
    assert rep.pass_rate == 0.5 and rep.passed is False
    first = Q.validate(df, CO2_ENERGY).where("not is_valid").first().first_error
    assert first == "country_code:not_allowed"


def test_empty_input_fails_gate(spark):
    df = spark.createDataFrame([], PANEL_DDL)
    rep = Q.validation_report(Q.validate(df, CO2_ENERGY), CO2_ENERGY).first()
    assert rep.pass_rate == 0.0 and rep.passed is False


def _pair(spark, new, prev):
    n = spark.createDataFrame(new, PANEL_DDL)
    p = None if prev is None else spark.createDataFrame(prev, PANEL_DDL)
    return n, p


def test_reconcile_jump_is_flagged(spark):
    n, p = _pair(spark, [("DE", 2023, 10.0, 52.0)], [("DE", 2023, 670.0, 52.0)])
    cmp = R.compare(n, p, CO2_ENERGY)
    assert R.anomalies(cmp, CO2_ENERGY).count() == 1
    assert R.safe_rows(cmp).count() == 0


def test_reconcile_small_change_is_clean(spark):
    n, p = _pair(spark, [("DE", 2023, 665.0, 53.0)], [("DE", 2023, 670.0, 52.0)])
    cmp = R.compare(n, p, CO2_ENERGY)
    s = R.summary(cmp, CO2_ENERGY).first()
    assert s.clean and s.anomaly_count == 0 and R.safe_rows(cmp).count() == 1


def test_reconcile_first_run_promotes_all(spark):
    n, _ = _pair(spark, [("DE", 2023, 665.0, 53.0), ("AT", 2023, 60.0, 70.0)], None)
    cmp = R.compare(n, None, CO2_ENERGY)
    s = R.summary(cmp, CO2_ENERGY, had_previous=False).first()
    assert s.rows_compared == 0 and R.promote(cmp, None, CO2_ENERGY).count() == 2


def test_change_equal_to_tolerance_passes_and_zero_previous_is_skipped(spark):
    # 115 vs 100 is exactly 0.15 (strict >), previous 0 cannot be compared
    n, p = _pair(spark, [("DE", 2023, 115.0, 50.0), ("AT", 2023, 5.0, 50.0)],
                 [("DE", 2023, 100.0, 50.0), ("AT", 2023, 0.0, 50.0)])
    assert R.anomalies(R.compare(n, p, CO2_ENERGY), CO2_ENERGY).count() == 0


def test_duplicate_previous_keys_do_not_duplicate_rows(spark):
    n, p = _pair(spark, [("DE", 2023, 100.0, 50.0)], [("DE", 2023, 100.0, 50.0), ("DE", 2023, 101.0, 50.0)])
    cmp = R.compare(n, p, CO2_ENERGY)
    assert cmp.count() == 1 and R.summary(cmp, CO2_ENERGY).first().rows_compared == 1


def test_keep_previous_policy_keeps_flagged_key(spark):
    n, p = _pair(spark, [("DE", 2023, 10.0, 52.0), ("AT", 2023, 60.0, 70.0)],
                 [("DE", 2023, 670.0, 52.0), ("AT", 2023, 60.0, 70.0)])
    cmp = R.compare(n, p, CO2_ENERGY)
    kept = {(r.country_code, r.co2_emissions_mt) for r in R.promote(cmp, p, CO2_ENERGY, "keep_previous").collect()}
    assert kept == {("DE", 670.0), ("AT", 60.0)}
    dropped = {r.country_code for r in R.promote(cmp, p, CO2_ENERGY, "drop").collect()}
    assert dropped == {"AT"}


def test_unique_key_duplicate_is_reported(spark):
    df = spark.createDataFrame([("X-1", "a"), ("X-1", "b"), ("X-2", "c")], "company_id string, company_name string")
    dup = Q.duplicate_rows(df, COMPANY_ESG.key).collect()
    assert [(r.company_id, r.copies) for r in dup] == [("X-1", 2)]


def test_grounding_bad_and_good(spark):
    rows = [("Emissions were 999999 Mt in 2023.", '{"co2_emissions_mt": 670, "year": 2023}'),
            ("Emissions were about 670.5 Mt in 2023.", '{"co2_emissions_mt": 670.5, "year": 2023}')]
    df = spark.createDataFrame(rows, "answer string, context string")
    g = [r.g for r in df.select(X.grounding(F.col("answer"), F.col("context")).alias("g")).collect()]
    assert g[0].grounded is False and g[0].unmatched == ["999999.0"] and "999999.0" in g[0].warning
    assert g[1].grounded is True and g[1].warning is None


def test_readiness_sentence_and_languages(spark):
    df = spark.createDataFrame([("Acme AG", 42.0, 3)], "name string, score double, gaps int")
    en, de = df.select(X.readiness_sentence(F.col("name"), F.col("score"), F.col("gaps")),
                       X.readiness_sentence(F.col("name"), F.col("score"), F.col("gaps"), "de")).first()
    assert "42" in en and "Acme AG" in en and en != de and "Scope 3" in en


def test_fixed_formatting_matches_python(spark):
    vals = [2.5, 3.5, 0.125, 2.675, 1.005, -2.45, 16.6137685, 1234567.891, 0.05]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    from terrapanel.functions.text import fixed, py_str
    got = df.select(fixed("x", 0).alias("a"), fixed("x", 1).alias("b"), fixed("x", 2).alias("c"),
                    py_str("x").alias("d")).collect()
    for v, r in zip(vals, got):
        assert (r.a, r.b, r.c, r.d) == (f"{v:.0f}", f"{v:.1f}", f"{v:.2f}", str(v))


def test_insight_bundle(spark):
    df = spark.createDataFrame([("CO2 emissions", -5.2)], "m string, d double")
    en = df.select(X.insight_bundle(F.col("m"), F.col("d")).alias("b")).first().b.asDict()
    de = df.select(X.insight_bundle(F.col("m"), F.col("d"), "de").alias("b")).first().b.asDict()
    assert len(en) == 6 and "decreased" in en["what_changed"] and "gesunken" in de["what_changed"]
    zero = spark.createDataFrame([("x", 0.0)], "m string, d double")
    assert "decreased" in zero.select(X.insight_bundle(F.col("m"), F.col("d")).alias("b")).first().b.what_changed


def _series(spark, years, values):
    return spark.createDataFrame([("E", "m", y, float(v)) for y, v in zip(years, values)],
                                 "entity string, metric string, period int, value double")


def test_forecast_length_and_years(spark):
    fc = T.forecast_ci(_series(spark, range(2015, 2024), range(100, 109)), "entity", "period", 5).collect()
    assert sorted(r.period for r in fc) == [2024, 2025, 2026, 2027, 2028]


def test_forecast_band_contains_forecast(spark):
    import random
    rnd = random.Random(1)
    years = list(range(2010, 2024))
    vals = [2 * (y - 2010) + rnd.gauss(0, 1) for y in years]
    for r in T.forecast_ci(_series(spark, years, vals), "entity", "period", 5).collect():
        assert r.lower <= r.forecast <= r.upper


def test_forecast_needs_three_points(spark):
    assert T.forecast_ci(_series(spark, [2020, 2021], [1, 2]), "entity", "period", 5).count() == 0


def test_forecast_matches_fixture_golden(spark):
    # full-sample fit of a linear series: exact line, zero band
    fc = T.forecast_ci(_series(spark, range(2000, 2024), [3 * i + 1 for i in range(24)]), "entity", "period", 1,
                       digits=None).first()
    assert fc.forecast == pytest.approx(3 * 24 + 1) and fc.upper - fc.lower == pytest.approx(0.0, abs=1e-6)


def test_scenarios_order(spark):
    fc = T.forecast_ci(_series(spark, [2021, 2022, 2023], [100, 110, 120]), "entity", "period", 1)
    sc = {r.scenario: r.forecast for r in T.scenarios(fc).collect()}
    assert sc["Accelerated Transition"] < sc["Baseline"] < sc["Delayed Policy Action"]


def test_t_table_values():
    assert T.t_quantile(0.975, 22) == pytest.approx(2.073873, abs=1e-6)
    assert T.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-6)
    assert T.t_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-6)


def test_bands(spark):
    df = spark.createDataFrame([(3.9,), (4.0,), (4.1,), (7.0,), (7.1,), (None,)], "s double")
    right = [r.b for r in df.select(B.risk_band("s").alias("b")).collect()]
    left = [r.b for r in df.select(B.risk_band("s", right_closed=False).alias("b")).collect()]
    assert right == ["Low", "Low", "Medium", "Medium", "High", None]
    assert left == ["Low", "Medium", "Medium", "High", "High", None]


def test_horizon_labels(spark):
    df = spark.createDataFrame([("1y",), ("10y",), ("2030",), ("2050",), ("2020",), ("bogus",)], "h string")
    got = [r.y for r in df.select(B.horizon_years(F.col("h"), F.lit(2023)).alias("y")).collect()]
    assert got == [1, 10, 7, 27, 5, 5]
    past = spark.range(1).select(B.horizon_years(F.lit("2030"), F.lit(2035)).alias("y")).first().y
    assert past == 1


def test_label_lookup_fallbacks(spark):
    df = spark.createDataFrame([("tab_x", "de"), ("kpi_co2", "de"), ("kpi_co2", "fr")], "key string, lang string")
    got = {(r.key, r.lang): r.label for r in L.lookup(df, "key", "lang").collect()}
    assert got[("kpi_co2", "de")] == "CO2-Emissionen (Mt)"
    assert got[("kpi_co2", "fr")] == "CO2 Emissions (Mt)"
    assert got[("tab_x", "de")] == "tab_x"


def test_email_guard_matches_plain_regex(spark):
    import re

    from terrapanel.functions.text import EMAIL_RE, IBAN_RE, email_count, has_email

    texts = ["no pii here", "mail a.b@x.org and c@d.co now", "@ alone", "x@y", "DE89370400440532013000 is an IBAN",
             "two: p@q.de,r@s.com", "", "weird @@a.b.cc"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = df.select("id", email_count("text").alias("n"), has_email("text").alias("h"),
                    F.regexp_count("text", F.lit(IBAN_RE)).alias("iban")).orderBy("id").collect()
    for r, t in zip(got, texts):
        assert r.n == len(re.findall(EMAIL_RE, t)), t
        assert r.h == bool(re.search(EMAIL_RE, t)), t
        assert r.iban == len(re.findall(IBAN_RE, t)), t
