"""File sources, snapshot publish, and stream = batch checks."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from terrapanel.registry import CO2_ENERGY
from terrapanel.sources import files as FS
from terrapanel.sources import publish as P
from terrapanel.streaming import refresh as ST

from conftest import SF_SMALL

PANEL_DDL = "country_code string, year int, co2_emissions_mt double, renewable_share_pct double"


def test_csv_with_schema_keeps_bad_rows_visible(spark, tmp_dir):
    path = os.path.join(tmp_dir, "sample_co2_energy.csv")
    with open(path, "w") as f:
        f.write("country_code,year,co2_emissions_mt\nDE,2020,700.5\nAT,abc,60\n")
    df = FS.read_csv(spark, path, "country_code string, year int, co2_emissions_mt double")
    rows = {r.country_code: r for r in df.collect()}
    assert rows["DE"].year == 2020 and rows["DE"]._corrupt is None
    assert rows["AT"].year is None and rows["AT"]._corrupt is not None


def test_land_and_read_latest_run(spark, tmp_dir):
    a = spark.createDataFrame([("DE", 2020, 1.0, 1.0)], PANEL_DDL)
    b = spark.createDataFrame([("DE", 2020, 2.0, 2.0), ("AT", 2020, 3.0, 3.0)], PANEL_DDL)
    FS.land(a, tmp_dir, "co2_energy", "20240101T000000Z")
    FS.land(b, tmp_dir, "co2_energy", "20240102T000000Z")
    latest = FS.read_latest_run(spark, tmp_dir, "co2_energy")
    assert latest.count() == 2 and {r._run_id for r in latest.collect()} == {"20240102T000000Z"}
    assert len(os.listdir(os.path.join(tmp_dir, "raw", "co2_energy"))) >= 2  # nothing deleted


def test_route_by_file_name(spark, tmp_dir):
    df = spark.createDataFrame([("sample_co2_energy_dach.csv",), ("company_esg_2024.csv",), ("other.csv",)],
                               "_source_file string")
    routes = {"co2_energy": "co2_energy", "climate_risk": "regional_climate_risk", "company_esg": "company_esg"}
    got = [r._dataset for r in FS.route(df, routes).collect()]
    assert got == ["co2_energy", "company_esg", None]


def test_first_available_falls_back(spark):
    empty = lambda: spark.createDataFrame([], PANEL_DDL)

    def broken():
        raise OSError("source down")

    sample = lambda: spark.createDataFrame([("DE", 2020, 1.0, 1.0)], PANEL_DDL)
    out = FS.first_available([("official", broken), ("estimated", empty), ("sample", sample)])
    assert out.first().data_quality == "sample"


def test_json_stat(spark, tmp_dir):
    doc = {"version": "2.0", "class": "dataset", "id": ["geo", "time"], "size": [2, 3],
           "dimension": {"geo": {"category": {"index": {"DE": 0, "AT": 1}}},
                         "time": {"category": {"index": ["2020", "2021", "2022"]}}},
           "value": [1, 2, 3, 4, 5, 6]}
    path = os.path.join(tmp_dir, "doc.json")
    with open(path, "w") as f:
        json.dump(doc, f)
    rows = sorted((r.geo, r.time, r.value) for r in FS.read_json_stat(spark, path).collect())
    assert rows == sorted([("DE", "2020", 1), ("DE", "2021", 2), ("DE", "2022", 3),
                           ("AT", "2020", 4), ("AT", "2021", 5), ("AT", "2022", 6)])


def test_publish_pointer_and_policies(spark, tmp_dir):
    v1 = spark.createDataFrame([("DE", 2023, 670.0, 52.0), ("AT", 2023, 60.0, 70.0)], PANEL_DDL)
    r1 = P.publish(v1, tmp_dir, CO2_ENERGY, "s1")
    assert r1.status == "published" and r1.rows_compared == 0
    v2 = spark.createDataFrame([("DE", 2023, 10.0, 52.0), ("AT", 2023, 61.0, 70.0)], PANEL_DDL)
    r2 = P.publish(v2, tmp_dir, CO2_ENERGY, "s2")
    assert r2.anomaly_count == 1 and P.current_snapshot_id(spark, tmp_dir, CO2_ENERGY) == "s2"
    cur = {r.country_code: r.co2_emissions_mt for r in P.read_current(spark, tmp_dir, CO2_ENERGY).collect()}
    assert cur == {"DE": 670.0, "AT": 61.0}           # flagged key keeps its previous value
    bad = spark.createDataFrame([("XX", 2023, 1.0, 1.0), ("YY", 2023, 1.0, 1.0)], PANEL_DDL)
    r3 = P.publish(bad, tmp_dir, CO2_ENERGY, "s3")
    assert r3.status == "gate_failed" and P.current_snapshot_id(spark, tmp_dir, CO2_ENERGY) == "s2"
    assert os.path.isdir(os.path.join(tmp_dir, "co2_energy", "snapshot=s1"))  # history kept


def test_upsert_is_idempotent(spark, tmp_dir):
    batch = spark.createDataFrame([("DE", 2023, 1.0, 1.0, 1), ("DE", 2023, 2.0, 2.0, 2), ("AT", 2023, 3.0, 3.0, 1)],
                                  PANEL_DDL + ", _row_seq int")
    P.upsert_snapshot(batch, tmp_dir, CO2_ENERGY, "b0")
    P.upsert_snapshot(batch, tmp_dir, CO2_ENERGY, "b0")  # replay of the same batch
    cur = sorted((r.country_code, r.co2_emissions_mt) for r in P.read_current(spark, tmp_dir, CO2_ENERGY).collect())
    assert cur == [("AT", 3.0), ("DE", 2.0)]


def test_refresh_stream_publishes_each_batch(spark, tmp_dir):
    land = os.path.join(tmp_dir, "landing")
    out = os.path.join(tmp_dir, "published")
    spark.createDataFrame([("DE", 2023, 670.0, 52.0)], PANEL_DDL).write.parquet(os.path.join(land, "b1"))
    stream = ST.landing_stream(spark, os.path.join(land, "*"), PANEL_DDL)
    q = ST.refresh(stream, out, CO2_ENERGY, clean=lambda d: d.drop("_ingested_at", "_source_file", "_row_seq"),
                   name="t_refresh")
    q.awaitTermination()
    assert P.read_current(spark, out, CO2_ENERGY).count() == 1
    fresh = spark.read.parquet(os.path.join(out, "_freshness")).collect()
    assert len(fresh) == 1 and fresh[0].status == "published" and fresh[0].source_as_of == "2023"


def test_hourly_rollup_stream_equals_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "events")
    spark.read.parquet(f"{SF_SMALL}/events.parquet").select("ts", "event_type", "value").write.parquet(src)
    batch = ST.hourly_rollup(spark.read.parquet(src), "ts", ["event_type"], "value", watermark=None)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    agg = ST.hourly_rollup(stream, "ts", ["event_type"], "value", watermark="2 hours")
    q = (agg.writeStream.outputMode("complete").format("memory").queryName("t_hourly")
            .option("checkpointLocation", os.path.join(tmp_dir, "ck_hourly")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.table("t_hourly")
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0


def test_dedupe_within_watermark(spark, tmp_dir):
    src = os.path.join(tmp_dir, "dups")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts", "value")
    ev.unionByName(ev.where(F.col("event_id") % 3 == 0)).write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (ST.dedupe(stream, ["event_id"], "ts", "1 day").writeStream.format("memory").queryName("t_dedupe")
           .option("checkpointLocation", os.path.join(tmp_dir, "ck_dedupe")).trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("t_dedupe").count() == ev.count()


def test_write_counted_matches_rows(spark, tmp_dir):
    df = spark.range(0, 1234, numPartitions=5).withColumnRenamed("id", "k")
    n = FS.write_counted(df, os.path.join(tmp_dir, "counted"))
    assert n == 1234 == spark.read.parquet(os.path.join(tmp_dir, "counted")).count()


def test_no_personal_data_in_published_schemas(frame):
    from terrapanel.functions.text import personal_fields, pii_columns
    from terrapanel.plans.catalog import load_all
    from terrapanel.registry import DATASETS

    for ds in DATASETS.values():
        assert not personal_fields(list(ds.columns)), ds.name
        assert not pii_columns(list(ds.columns)), ds.name
    # every registered result schema is free of exact personal-data field names
    for name in load_all():
        assert not personal_fields(frame(name).columns), name
    assert personal_fields(["Email", "year"]) == {"email"}
    assert pii_columns(["contact_email"]) == [("contact_email", "email")]
