"""Landed files to the published table in one call."""

from __future__ import annotations

import os

import pytest

from terrapanel.operators.quality import QualityGateError
from terrapanel.pipeline import run_dataset
from terrapanel.registry import CO2_ENERGY
from terrapanel.sources import publish as P


def pulled(spark, tmp_dir, name, rows):
    path = os.path.join(tmp_dir, f"{name}.csv")
    with open(path, "w") as f:
        f.write("country_code,year,co2_emissions_mt,renewable_share_pct\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))
    return spark.read.option("header", True).csv(path)  # every column is text


def published(spark, root):
    return sorted((r.country_code, r.year, r.co2_emissions_mt) for r in P.read_current(spark, f"{root}/published", CO2_ENERGY).collect())


def test_landed_files_to_published_table(spark, tmp_dir):
    root = os.path.join(tmp_dir, "root")
    first = run_dataset(pulled(spark, tmp_dir, "a", [(" de ", 2023, 670, 52), ("AT", 2023, 60, 170), ("AT", 2023, 61, 70)]), root, CO2_ENERGY, "20240101T000000Z")
    assert first.status == "published" and published(spark, root) == [("AT", 2023, 61.0), ("DE", 2023, 670.0)]
    again = run_dataset(pulled(spark, tmp_dir, "a", [("DE", 2023, 1, 52)]), root, CO2_ENERGY, "20240101T000000Z")
    assert again.status == "already_published" and published(spark, root) == [("AT", 2023, 61.0), ("DE", 2023, 670.0)]
    out = os.path.join(tmp_dir, "csv")
    second = run_dataset(pulled(spark, tmp_dir, "b", [("DE", 2023, 10, 52), ("AT", 2023, 62, 70)]), root, CO2_ENERGY, "20240102T000000Z", export=out)
    assert second.anomaly_count == 1 and published(spark, root) == [("AT", 2023, 62.0), ("DE", 2023, 670.0)]
    assert spark.read.option("header", True).csv(out).count() == 2
    bad = run_dataset(pulled(spark, tmp_dir, "c", [("XX", 2023, 10, 52)]), root, CO2_ENERGY, "20240103T000000Z")
    assert bad.status == "gate_failed" and len(published(spark, root)) == 2
    with pytest.raises(QualityGateError):
        run_dataset(pulled(spark, tmp_dir, "d", [("", 2023, 10, 52), ("DE", 2023, 10, 52)]), root, CO2_ENERGY, "20240104T000000Z")
