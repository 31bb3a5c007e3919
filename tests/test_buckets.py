"""Bucketed snapshots: cost of an upsert, merge joins without an exchange, publishers at once, rejects."""

from __future__ import annotations

import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import reconcile as R
from terrapanel.registry import CO2_ENERGY, Dataset
from terrapanel.sources import buckets as B
from terrapanel.sources import publish as P

WIDE = Dataset(name="wide", key=("id",), entity="id", check_cols=("x", "y"), tolerance=0.15)
PANEL_DDL = "country_code string, year int, co2_emissions_mt double, renewable_share_pct double"


def wide(spark, n, shift=0.0):
    return spark.range(n).select("id", (F.col("id") % 97 + 100.0 + shift).alias("x"), (F.col("id") % 31 + 50.0).alias("y"),
                                 F.sha2(F.col("id").cast("string"), 256).alias("payload"))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def generations(base):
    folder = os.path.join(base, "data")
    return {g: size(os.path.join(folder, g)) for g in os.listdir(folder) if g.startswith("_gen=")}


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_of_one_key_rewrites_one_bucket(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 40_000)
    P.write_snapshot(wide(spark, 1_000_000), tmp_dir, WIDE, "s0")
    s = P.store(spark, tmp_dir, WIDE)
    first = s.head()
    assert first.buckets == 32 and first.rows == 1_000_000
    (gen, whole), = generations(s.base).items()
    folders = [d for d, _, files in os.walk(os.path.join(s.base, "data", gen)) if any(f.endswith(".parquet") for f in files)]
    assert len(folders) == 32 and all(sum(f.endswith(".parquet") for f in os.listdir(d)) == 1 for d in folders)  # one file a bucket
    held = P.read_current(spark, tmp_dir, WIDE)
    batch = spark.createDataFrame([(77, 1.0, 2.0, "new", 1), (77, 3.0, 4.0, "newer", 2)], "id long, x double, y double, payload string, _row_seq int")
    assert P.upsert_snapshot(batch, tmp_dir, WIDE, "b1").rewritten_buckets == 1
    written = {g: n for g, n in generations(s.base).items() if g != gen}
    assert sum(written.values()) < whole / 20  # the staged row and one bucket of 32
    second = s.head()
    assert sum(first.live[b] != second.live[b] for b in first.live) == 1 and second.rows == 1_000_000
    assert [tuple(r) for r in P.read_current(spark, tmp_dir, WIDE).where("id = 77").collect()] == [(77, 3.0, 4.0, "newer")]
    assert held.where("id = 77").first().payload != "newer" and held.count() == 1_000_000  # a reader keeps its manifest
    before = generations(s.base)
    assert P.upsert_snapshot(batch, tmp_dir, WIDE, "b1").status == "already_published"
    assert generations(s.base) == before and s.head() == second


def test_compare_and_merge_without_exchange(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 1000)
    P.write_snapshot(wide(spark, 16_000), tmp_dir, WIDE, "s0")
    s = P.store(spark, tmp_dir, WIDE)
    old = s.head()
    new = wide(spark, 17_000).withColumn("x", F.when(F.col("id") % 10 == 0, F.col("x") * 2).otherwise(F.col("x")))
    gen, live = s.write(new.repartition(old.buckets, "id"), ("id",), old.buckets)
    staged = B.Manifest("", old.buckets, ("id",), new.schema, {b: (gen, n) for b, n in live.items()})
    monkey = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    kept = {k: spark.conf.get(k) for k in monkey}
    try:
        for k, v in monkey.items():
            spark.conf.set(k, v)
        compared = R.compare(s.read(staged, bucketed=True), s.read(old, bucketed=True), WIDE)
        merged = R.merge(s.read(staged, bucketed=True), s.read(old, bucketed=True), ["id"], None, True, True)
        for df in (compared, merged):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in plan and "SortMergeJoin" in plan, plan
        assert merged.rdd.getNumPartitions() == old.buckets
        # the withheld keys are the only side that moves
        withheld = compared.where(F.size("_anomalies") > 0).select("id")
        some = spark.createDataFrame([(10,), (20,)], "id long")
        plan = R.merge(s.read(staged, bucketed=True), s.read(old, bucketed=True), ["id"], some)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert rows(compared.select("id", "_matched", F.size("_anomalies"))) == rows(
            R.compare(new, wide(spark, 16_000), WIDE).select("id", "_matched", F.size("_anomalies")))
        assert withheld.count() == 1600
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("on_flag", ["keep_previous", "drop"])
@pytest.mark.parametrize("partial", [False, True])
def test_publish_equals_plain_rules(spark, tmp_dir, monkeypatch, partial, on_flag):
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 100)
    P.publish(wide(spark, 1000), tmp_dir, WIDE, "s0")
    new = wide(spark, 1200).where("id >= 300").withColumn("y", F.when(F.col("id") % 50 == 7, F.col("y") * 3).otherwise(F.col("y")))
    res = P.publish(new, tmp_dir, WIDE, "s1", on_flag, partial)
    old = wide(spark, 1000)
    compared = R.compare(new, old, WIDE)
    want = R.promote(compared, old, WIDE, on_flag)
    if partial:
        want = want.unionByName(old.where("id < 300"))
    assert rows(P.read_current(spark, tmp_dir, WIDE)) == rows(want)
    assert (res.rows_compared, res.flagged_rows, res.anomaly_count, res.rejected_rows) == (900, 14, 14, 14)
    assert {r.reason for r in P.read_rejects(spark, tmp_dir, WIDE).collect()} == {"withheld:y"}
    if not partial:  # only the buckets of withheld rows were written twice
        flagged = {r.b for r in new.where("id % 50 = 7 and id < 1000").select(B.bucket_of(("id",), 16).alias("b")).collect()}
        assert res.rewritten_buckets == len(flagged) < 16


def test_second_row_of_a_key_is_rejected_not_lost(spark, tmp_dir):
    load = spark.createDataFrame([("DE", 2023, 670.0, 52.0)] * 3 + [("DE", 2023, 660.0, 52.0), ("AT", 2023, 60.0, 70.0), ("XX", 2023, 1.0, 1.0)]
                                 + [("CH", y, 40.0, 60.0) for y in range(2000, 2020)], PANEL_DDL)
    res = P.publish(load, tmp_dir, CO2_ENERGY, "s0")
    assert res.status == "published" and res.rejected_rows == 4
    assert res.total_rows == P.store(spark, tmp_dir, CO2_ENERGY).head().rows + res.rejected_rows
    got = sorted((r.reason, r.copies, json.loads(r.row)["co2_emissions_mt"]) for r in P.read_rejects(spark, tmp_dir, CO2_ENERGY).collect())
    assert got == [("contract:country_code:not_allowed", 1, 1.0), ("duplicate_key", 1, 660.0), ("duplicate_key", 2, 670.0)]
    again = spark.createDataFrame([("DE", 2023, 671.0, 52.0, 1), ("DE", 2023, 672.0, 52.0, 2), (None, 2023, 1.0, 1.0, 3)], PANEL_DDL + ", _row_seq int")
    res = P.upsert_snapshot(again, tmp_dir, CO2_ENERGY, "s1")
    assert sorted((r.reason, r.copies) for r in P.read_rejects(spark, tmp_dir, CO2_ENERGY).collect()) == [("duplicate_key", 1), ("null_key", 1)]
    assert res.rejected_rows == 2 and P.read_rejects(spark, tmp_dir, CO2_ENERGY, "s0").count() == 3


def test_hot_key_of_a_load_is_folded(spark, tmp_dir):
    """A third of 60,000 rows repeat one row: one task never holds them, and the count is right."""
    load = wide(spark, 40_000).unionByName(spark.range(20_000).select(F.lit(5).cast("long").alias("id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit("z").alias("payload")))
    res = P.publish(load, tmp_dir, WIDE, "s0")
    got = P.read_rejects(spark, tmp_dir, WIDE).collect()
    assert res.rejected_rows == 20_000 and [(r.reason, r.copies) for r in got] == [("duplicate_key", 20_000)]


def test_types_and_columns_of_a_partial_load(spark, tmp_dir):
    P.write_snapshot(spark.createDataFrame([(1, 1.0), (2, 2.0)], "id long, x double"), tmp_dir, WIDE, "s0")
    res = P.upsert_snapshot(spark.createDataFrame([("2", "2.5", "a"), ("3", "junk", "b"), ("4", None, "c")], "id string, x string, note string"), tmp_dir, WIDE, "s1")
    assert rows(P.read_current(spark, tmp_dir, WIDE).fillna({"note": "-", "x": -1.0})) == [(1, 1.0, "-"), (2, 2.5, "a"), (4, -1.0, "c")]
    assert res.rejected_rows == 1 and P.read_rejects(spark, tmp_dir, WIDE).first().reason == "type"
    P.write_snapshot(spark.createDataFrame([(9, 9)], "id long, x int"), tmp_dir, WIDE, "s2")
    assert P.read_current(spark, tmp_dir, WIDE).schema.simpleString() == "struct<id:bigint,x:int,note:string>"
    assert rows(P.read_current(spark, tmp_dir, WIDE, "s0")) == [(1, 1.0), (2, 2.0)]
    P.write_snapshot(spark.createDataFrame([], "id long, x int"), tmp_dir, WIDE, "s3")
    assert P.read_current(spark, tmp_dir, WIDE).count() == 0


def test_outgrown_layout_is_made_anew(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 100)
    P.publish(wide(spark, 150), tmp_dir, WIDE, "s0")
    res = P.publish(wide(spark, 5000).withColumn("x", F.when(F.col("id") == 3, 1.0).otherwise(F.col("x"))), tmp_dir, WIDE, "s1")
    s = P.store(spark, tmp_dir, WIDE)
    assert (s.find("s0").buckets, s.head().buckets) == (2, 64) and res.flagged_rows == 1
    assert rows(P.read_current(spark, tmp_dir, WIDE)) == rows(wide(spark, 5000))


def test_beaten_publisher_takes_the_new_head(spark, tmp_dir, monkeypatch):
    """Another publisher commits between a publisher's base and its commit."""
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 100)
    P.write_snapshot(wide(spark, 1000), tmp_dir, WIDE, "s0")
    commit, rival = B.BucketStore.commit, [lambda: P.upsert_snapshot(row(900, 1.0), tmp_dir, WIDE, "other"), lambda: P.upsert_snapshot(row(5, 2.0), tmp_dir, WIDE, "same")]

    def row(i, x):
        return spark.createDataFrame([(i, x, x, "up")], "id long, x double, y double, payload string")

    def beaten(self, new, base):
        if new.snapshot == "mine" and rival:
            rival.pop(0)()
        return commit(self, new, base)

    bucket = lambda i: spark.createDataFrame([(i,)], "id long").select(B.bucket_of(("id",), 16)).first()[0]
    mine = next(i for i in range(6, 1000) if bucket(i) == bucket(5) != bucket(900))  # shares its bucket with 5, not with 900
    monkeypatch.setattr(B.BucketStore, "commit", beaten)
    res = P.upsert_snapshot(row(mine, 3.0), tmp_dir, WIDE, "mine")
    assert res.attempts == 3
    got = {r.id: r.x for r in P.read_current(spark, tmp_dir, WIDE).where("payload = 'up'").collect()}
    assert got == {900: 1.0, 5: 2.0, mine: 3.0} and P.read_current(spark, tmp_dir, WIDE).count() == 1000
    log = [r.snapshot for r in P.store(spark, tmp_dir, WIDE).log().orderBy("seq").collect()]
    assert log == ["s0", "other", "same", "mine"]


def test_publishers_at_once_lose_nothing(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(B, "ROWS_PER_BUCKET", 100)
    P.write_snapshot(wide(spark, 400), tmp_dir, WIDE, "s0")
    failed = []

    def run(k):
        try:
            batch = spark.range(k, 400, 4).select("id", F.lit(float(k)).alias("x"), F.lit(1.0).alias("y"), F.lit(f"by {k}").alias("payload"))
            assert P.upsert_snapshot(batch, tmp_dir, WIDE, f"t{k}").status == "published"
        except BaseException as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=run, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    assert {r.payload: r["count"] for r in P.read_current(spark, tmp_dir, WIDE).groupBy("payload").count().where("payload like 'by%'").collect()} == {f"by {k}": 100 for k in range(3)}
    log = P.store(spark, tmp_dir, WIDE).log().orderBy("seq").collect()
    assert [r.seq for r in log] == [1, 2, 3, 4] and {r.snapshot for r in log} == {"s0", "t0", "t1", "t2"}


def test_create_if_absent_has_one_winner(spark, tmp_dir):
    path, won = os.path.join(tmp_dir, "log", "1.json"), []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if B.create_if_absent(spark, path, f"{i}\n") else None) for i in range(16)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and open(path).read() == f"{won[0]}\n" and os.listdir(os.path.dirname(path)) == ["1.json"]
