"""Null, repeated and equal rows in masses: spread over tasks, counted right."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from terrapanel.llm import packing, pairwise_quality, pivotal_mix, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def hot(spark, n, third=None):
    """n rows, a third of them equal."""
    same = F.col("id") < n // 3
    return spark.range(n).select(F.when(same, F.lit(third).cast("long")).otherwise(F.col("id")).alias("doc_id"),
                                 F.when(same, F.lit("one two three")).otherwise(F.concat(F.lit("word "), F.col("id").cast("string"))).alias("text"),
                                 F.lit("en").alias("lang"), F.lit("web").alias("source"), F.lit(1).cast("long").alias("n_chars"))


def test_ranges_are_read_in_as_many_tasks(spark, tmp_dir):
    pages = spark.range(600).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html"))
    manifest = warc.write_archives(pages)
    ranges = sum(-(-r.bytes // 5_000) for r in manifest.collect())
    got = warc.read_archives(spark, manifest, range_bytes=5_000, with_payload=False).withColumn("task", F.spark_partition_id())
    tasks = got.groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 600 and len(tasks) > ranges / 2 > 8


def test_equal_rows_are_mixed_in_proportion(spark):
    """A third of the rows are equal: each is rounded on its own, and alike whatever order the rows come in."""
    df = hot(spark, 20_000, 7)
    a, b = (pivotal_mix.mix(df.repartition(k)).select("doc_id", "tag", "copies", "taken", "target").toPandas() for k in (3, 11))
    assert len(a) == 20_000 and abs(a.taken.sum() - a.target[0]) <= 3 and a.copies.max() <= 2
    count = lambda x: x.groupby(["doc_id", "tag", "copies"]).size().to_dict()
    assert count(a) == count(b)
    equal = a[a.doc_id == 7]
    assert len(equal) >= 6_666 and 1.4 < equal.copies.mean() < 1.6


def test_equal_rows_are_copied_as_often_as_the_mix_says(spark):
    mixed = pivotal_mix.mixed(hot(spark, 3000, 7)).groupBy((F.col("text") == "one two three").alias("hot")).agg(F.sum(F.regexp_count("text", F.lit("[^ ]+"))).alias("w")).collect()
    assert abs(sum(r.w for r in mixed) - 1.5 * (3 * 1000 + 2 * 2000)) <= 3 and len(mixed) == 2


def test_null_ids_spread_over_shards(spark):
    out = packing.pack_documents(hot(spark, 6000).withColumn("doc_id", F.lit(None).cast("long")), shard=500)
    assert out.count() == 6000 and "row_no" not in out.columns
    seq = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count(F.lit(1)).alias("pieces"))
    assert seq.filter("n > 4096 or n <> end").count() == 0 and seq.agg(F.max("pieces")).first()[0] < 3000


def test_repeated_ids_stay_within_the_bound(spark):
    text = [(i % 40, ("good plain words here " if i % 2 else "!!! $$$ || ") * (1 + i % 5), "a") for i in range(2000)] + [(5, "x", "a")] * 3000
    labels = spark.createDataFrame([(i % 40, i % 2) for i in range(4000)] + [(3, 0)], "doc_id long, quality int")
    model = pairwise_quality.train(docs(spark, text), labels, max_labels=20)
    scores = pairwise_quality.score(docs(spark, text[:40]), model).collect()
    assert len(scores) == 40 and all(0 <= r.score <= 1 for r in scores)
    none = pairwise_quality.train(docs(spark, []), labels)
    assert len({r.score for r in pairwise_quality.score(docs(spark, text[:5]), none).collect()}) == 1


def test_one_document_a_group_whatever_its_id(spark, tmp_dir):
    a, b, c = ("alpha beta gamma delta epsilon zeta eta theta " * 3, "one two three four five six seven eight nine " * 3, "red green blue " * 9)
    rows = [(None, a, "s"), (None, a, "s"), (4, b, "s"), (4, b, "s"), (2, b, "s"), (4, c, "s"), (None, c + " x", "s"), (None, None, "s"), (None, None, "s"), (9, "", "s"),
            (7, "a very " + "l" * 200_000 + " word stands in here alone", "s")]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, rows), tmp_dir).collect()
    kept = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "")[:9]) for r in got)
    assert kept == [(False, 2, "one two t"), (False, 4, "red green"), (False, 7, "a very ll"), (False, 9, ""), (True, 0, ""), (True, 0, ""), (True, 0, "alpha bet")]
    assert corpus_pipeline.near_duplicates(spark, docs(spark, []), tmp_dir).count() == 0
