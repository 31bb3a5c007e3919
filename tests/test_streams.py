"""Streams across restarts: late rows, keys seen before, two sources."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from terrapanel.registry import Dataset
from terrapanel.sources import publish as P
from terrapanel.streaming import refresh as ST
from terrapanel.streaming import seen
from terrapanel.streaming.rollup import rollup

EVENTS = "event_id long, ts timestamp, kind string, value double"
START = datetime(2024, 1, 1)


def events(rows):
    """[(id, minutes after the start, kind)]"""
    return [(i, START + timedelta(minutes=m), k, float(i)) for i, m, k in rows]


def land(spark, folder, n, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(os.path.join(folder, f"b{n}"))


def stream(spark, folder):
    return spark.readStream.schema(EVENTS).parquet(os.path.join(folder, "*"))


BATCHES = [
    [(1, 5, "a"), (2, 50, "a"), (3, 70, "b"), (4, 200, "a")],           # watermark 80 after it
    [(5, 10, "a"), (6, 75, "b"), (7, 150, "a"), (8, 300, "b")],         # 5: window ended at 60, too late; 6: ends at 120, in time
    [(9, 290, "a"), (10, 100, "a"), (11, 500, "b")],                    # 10: ended at 120, watermark 180, too late
]


def in_time():
    late = {5, 10}
    return [r for b in BATCHES for r in b if r[0] not in late], late


def test_rollup_keeps_late_rows_and_matches_spark(spark, tmp_dir):
    folder, out = os.path.join(tmp_dir, "land"), os.path.join(tmp_dir, "out")
    kept = rollup(out, "ts", ["kind"], "value")
    spark_out = os.path.join(tmp_dir, "spark")
    for n, rows in enumerate(BATCHES):  # every round is a restart of both queries from their checkpoints
        land(spark, folder, n, events(rows))
        kept.start(stream(spark, folder), os.path.basename(tmp_dir)).awaitTermination()
        q = (ST.hourly_rollup(stream(spark, folder), "ts", ["kind"], "value").writeStream.outputMode("append").format("parquet")
             .option("path", spark_out).option("checkpointLocation", os.path.join(tmp_dir, "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
    ok, late = in_time()
    whole = ST.hourly_rollup(spark.createDataFrame(events(ok), EVENTS), "ts", ["kind"], "value", watermark=None)
    closed = whole.where(F.col("window_start") <= F.lit(START + timedelta(minutes=500 - 120 - 60)))
    got = kept.windows(spark)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect())) and closed.count() == 6
    assert {r.event_id for r in kept.late(spark).collect()} == late
    log = sorted(map(tuple, kept.batches(spark).select("batch", "rows", "late_rows").collect()))
    assert log == [(0, 4, 0), (1, 4, 1), (2, 3, 1)]
    # Spark's own append mode emits the same windows
    assert sorted(map(tuple, spark.read.parquet(spark_out).select(*got.columns).collect())) == sorted(map(tuple, got.collect()))
    # a replay of a batch changes nothing
    kept.add(spark.createDataFrame(events(BATCHES[2]), EVENTS), 2)
    assert sorted(map(tuple, kept.windows(spark).collect())) == sorted(map(tuple, closed.collect()))


def test_rollup_of_nulls_and_empty_batches(spark, tmp_dir):
    kept = rollup(os.path.join(tmp_dir, "out"), "ts", ["kind"], "value")
    kept.add(spark.createDataFrame([], EVENTS), 0)
    kept.add(spark.createDataFrame([(1, None, "a", 1.0), (2, START, None, None)], EVENTS), 1)
    kept.add(spark.createDataFrame(events([(3, 600, "z")]), EVENTS), 2)
    assert [r.event_id for r in kept.late(spark).collect()] == [1]
    assert [tuple(r) for r in kept.windows(spark).collect()] == [(START, None, 1, None)]


def test_keys_are_dropped_long_after_any_watermark(spark, tmp_dir):
    keys = seen.SeenKeys(spark, os.path.join(tmp_dir, "seen"), ["event_id", "kind"], buckets=2)
    got, sizes = [], []
    for n in range(20):  # no state of Spark's own at all: runs of hashes
        batch = events([(100 * n + i, 24 * 60 * n + i, "a") for i in range(20)] + [(100 * n + 3, 24 * 60 * n + 3, "a")])
        if n:  # one row of the batch before, one of the very first
            batch += events([(100 * (n - 1), 24 * 60 * (n - 1), "a"), (7, 7, "a"), (7, 7, f"k{n}")])
        got += [(r.event_id, r.kind) for r in keys.add(spark.createDataFrame(batch, EVENTS), n).collect()]
        sizes.append(len(keys.runs()))
    assert len(got) == len(set(got)) == 20 * 20 + 19
    assert max(sizes) <= 2 * (seen.FANOUT - 1) + 1 and sum(r.rows for r in keys.runs()) == len(got)
    # the replay of a batch gives its rows again, and notes nothing twice
    again = keys.add(spark.createDataFrame(batch, EVENTS), 19)
    assert again.count() == 21 and sum(r.rows for r in keys.runs()) == len(got)


def test_event_times_prune_runs_and_runs_never_move(spark, tmp_dir):
    keys = seen.SeenKeys(spark, os.path.join(tmp_dir, "seen"), ["event_id"], "ts", buckets=4)
    for n in range(2):
        keys.add(spark.createDataFrame(events([(100 * n + i, 24 * 60 * n + i, "a") for i in range(9)]), EVENTS), n)
    asked = []
    read = keys.store.read
    keys.store.read = lambda m, *a, **k: asked.append(m) or read(m, *a, **k)
    assert [r.event_id for r in keys.add(spark.createDataFrame(events([(103, 24 * 60 + 3, "a"), (999, 24 * 60 + 5, "a")]), EVENTS), 2).collect()] == [999]
    runs = keys.runs(before=2)
    gens = {gen for m in asked for gen, _ in m.live.values()}
    assert runs[1].gen in gens and runs[0].gen not in gens
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        staged = keys._generation(*keys._written(spark.createDataFrame([(1, 2)], "h1 long, h2 long")))
        plan = keys.unseen(staged, runs)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_stream_drops_rows_sent_again_after_a_restart(spark, tmp_dir):
    folder, out = os.path.join(tmp_dir, "land"), os.path.join(tmp_dir, "out")

    def sink(new, batch_id):
        new.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    for n, rows in enumerate([[(1, 1, "a"), (2, 2, "a")], [(1, 1, "a"), (3, 90_000, "a"), (3, 90_000, "a")], [(2, 2, "a"), (4, 1, "b")]]):
        land(spark, folder, n, events(rows))
        seen.dedupe_across_runs(stream(spark, folder), os.path.join(tmp_dir, "seen"), ["event_id"], sink, os.path.basename(tmp_dir)).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]


FIRMS_DS = Dataset(name="listed", key=("firm_id",), entity="country", period="year")


def test_two_sources_in_one_query(spark, tmp_dir):
    main, sub, root = (os.path.join(tmp_dir, x) for x in ("main", "sub", "root"))

    def run():
        a = spark.readStream.schema("firm_id long, country string, year int, score double").parquet(os.path.join(main, "*"))
        b = spark.readStream.schema("form string, country string, year int").parquet(os.path.join(sub, "*"))
        ST.collect_sources(a, b, root, FIRMS_DS, id_from="form", name=os.path.basename(tmp_dir)).awaitTermination()

    put = lambda folder, n, rows, ddl: spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(os.path.join(folder, f"b{n}"))
    put(main, 0, [(1, "DE", 2020, 5.0), (2, "AT", 2021, 6.0)], "firm_id long, country string, year int, score double")
    put(sub, 0, [("f1", "CH", 2022)], "form string, country string, year int")
    run()
    put(main, 1, [(2, "AT", 2023, 7.0)], "firm_id long, country string, year int, score double")
    run()
    put(sub, 1, [("f1", "CH", 2024), ("f2", "DE", 2019)], "form string, country string, year int")
    run()
    got = sorted((r.country, r.year, r.score, r.data_quality) for r in P.read_current(spark, root, FIRMS_DS).collect())
    assert got == [("AT", 2023, 7.0, "official"), ("CH", 2024, None, "user_input"), ("DE", 2019, None, "user_input"), ("DE", 2020, 5.0, "official")]
    fresh = sorted((r.batch_id, r.source, r.rows, r.source_as_of) for r in spark.read.parquet(f"{root}/_sources").collect())
    assert fresh == [(0, "official", 2, "2021"), (0, "user_input", 1, "2022"), (1, "official", 1, "2023"), (2, "user_input", 2, "2024")]


def test_upsert_stream_goes_on_after_a_restart(spark, tmp_dir):
    folder, root = os.path.join(tmp_dir, "land"), os.path.join(tmp_dir, "root")
    ds = Dataset(name="events", key=("event_id",), entity="kind")
    for n, rows in enumerate([[(1, 1, "a"), (2, 2, "a")], [(2, 5, "b"), (3, 3, "b")]]):
        land(spark, folder, n, events(rows))
        ST.upsert(stream(spark, folder), root, ds, name=os.path.basename(tmp_dir)).awaitTermination()
    assert sorted((r.event_id, r.kind) for r in P.read_current(spark, root, ds).collect()) == [(1, "a"), (2, "b"), (3, "b")]
    assert P.store(spark, root, ds).head().seq == 2
