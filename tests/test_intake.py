"""Text files of many headers: typed, routed, defaults filled, nothing lost."""

from __future__ import annotations

import os

from terrapanel.operators import quality as Q
from terrapanel.registry import CO2_ENERGY, COMPANY_ESG, REGIONAL_RISK
from terrapanel.sources import publish as P
from terrapanel.sources import rescue

ROUTES = {"co2_energy": CO2_ENERGY, "climate_risk": REGIONAL_RISK, "company_esg": COMPANY_ESG}


def put(folder, name, text):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write(text)


def test_files_of_many_headers(spark, tmp_dir):
    put(tmp_dir, "sample_co2_energy_dach.csv",
        "country_code,year,co2_emissions_mt,renewable_share_pct,co2_per_capita_t,note\n"
        "DE,2023,670.5,52,7.9,\"a, quoted\"\nAT,2022.0,60,70,,\nCH,abc,40,60,,x\nDE,2021,700,50,junk,\nXX,2020,1,1,,\n,2020,1,1,,\n")
    put(tmp_dir, "co2energy_more.csv",  # the same dataset, another order, a tag of its own; a quality tag that is missing is an error
        "year,country_code,renewable_share_pct,co2_emissions_mt,data_quality\n2020,AT,71,61,official\n2019,AT,71,61,\n2018,AT,71,61,guess\n2017,AT\n")
    put(tmp_dir, "notes_2024.csv", "who,what\nme,hello\n")
    put(tmp_dir, "company_esg.csv", "company_id\n")  # a header alone
    raw = rescue.read_text(spark, tmp_dir)
    out = rescue.intake(raw, ROUTES)
    got = sorted((r.country_code, r.year, r.co2_emissions_mt, r.co2_per_capita_t, r.data_quality, (r._rescued or {}).get("note")) for r in out.valid["co2_energy"].collect())
    assert got == [("AT", 2020, 61.0, None, "official", None), ("AT", 2022, 60.0, None, "sample", None), ("DE", 2023, 670.5, 7.9, "sample", "a, quoted")]
    assert dict(out.valid["co2_energy"].dtypes)["year"] == "bigint" and dict(out.valid["co2_energy"].dtypes)["co2_emissions_mt"] == "double"
    why = sorted((r.source_file, r.reason) for r in out.rejects.collect())
    assert ("notes_2024.csv", "no_route") in why and ("sample_co2_energy_dach.csv", "year:not_integer") in why
    assert ("sample_co2_energy_dach.csv", "country_code:not_allowed") in why and ("sample_co2_energy_dach.csv", "country_code:missing") in why
    assert ("sample_co2_energy_dach.csv", "co2_per_capita_t:not_a_number") in why and ("co2energy_more.csv", "data_quality:not_allowed") in why
    assert raw.count() == sum(v.count() for v in out.valid.values()) + out.rejects.count() == 11
    held = {r.reason: r.row for r in out.rejects.collect()}
    assert held["co2_per_capita_t:not_a_number"]["co2_per_capita_t"] == "junk" and held["no_route"] == {"who": "me", "what": "hello"}


def test_default_is_for_files_without_the_column(spark, tmp_dir):
    put(tmp_dir, "co2_energy.csv", "country_code,year,co2_emissions_mt,renewable_share_pct\nDE,2023,670.5,52\n")
    out = rescue.intake(rescue.read_text(spark, tmp_dir), ROUTES)
    row = out.valid["co2_energy"].first()
    assert row.data_quality == "sample" and row.nuclear_share_pct is None and row._rescued is None
    assert out.rejects.count() == 0


def test_empty_folder(spark, tmp_dir):
    put(tmp_dir, "co2_energy.csv", "")
    out = rescue.intake(rescue.read_text(spark, tmp_dir), ROUTES)
    assert out.rejects.count() == 0 and out.valid["co2_energy"].count() == 0


def test_publish_fills_defaults_and_drops_extras(spark, tmp_dir):
    load = spark.createDataFrame([("DE", 2023, 670.0, 52.0, "x")], "country_code string, year int, co2_emissions_mt double, renewable_share_pct double, stray string")
    P.publish(load, tmp_dir, CO2_ENERGY, "s0")
    row = P.read_current(spark, tmp_dir, CO2_ENERGY).first().asDict()
    assert set(row) == set(CO2_ENERGY.columns) and row["data_quality"] == "sample" and row["nuclear_share_pct"] is None


def test_gate_counts_the_headline_measure(spark):
    ddl = "country_code string, year int, co2_emissions_mt double"
    rows = [("DE", 2000 + i, None if i < 2 else 1.0) for i in range(20)]
    got = Q.key_null_gate(spark.createDataFrame(rows, ddl), CO2_ENERGY).first()
    assert got.max_key_null_rate == 0.1 and not got.passed
