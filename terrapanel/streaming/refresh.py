"""Structured Streaming jobs (ST1-ST6).

The periodic re-pull of the batch pipeline becomes a file-source stream: new
landed files are micro-batches, each batch is validated, reconciled and
published as a snapshot named by stream and ``batchId`` (so a replay after a
failure finds it published and changes nothing), and progress lives in a
checkpoint under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from terrapanel.operators.serve import surrogate_id
from terrapanel.registry import Dataset
from terrapanel.session import checkpoint_dir
from terrapanel.sources.publish import publish, upsert_snapshot

# Refresh every hour, never more often than every 60 seconds.
REFRESH_SECONDS = 3600
MIN_REFRESH_SECONDS = 60


def _trigger(writer, every_seconds: int | None):
    if every_seconds is None:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=f"{max(MIN_REFRESH_SECONDS, int(every_seconds))} seconds")


def landing_stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet") -> DataFrame:
    """New files under ``path`` as a stream, with ingest lineage."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.load(path).withColumn("_ingested_at", F.current_timestamp())
                  .withColumn("_source_file", F.col("_metadata.file_name")))


def _stream_id(spark: SparkSession, ckpt: str) -> str:
    """An id that lives with the stream's checkpoint: the same after a restart, a
    new one when the checkpoint is lost and batch numbers start again at 0."""
    path = f"{ckpt}/_stream_id"
    try:
        return spark.read.schema("id string").parquet(path).agg(F.min("id").alias("id")).first()["id"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    spark.createDataFrame([(uuid.uuid4().hex[:12],)], "id string").coalesce(1).write.mode("append").parquet(path)
    return _stream_id(spark, ckpt)


def _snapshot_id(query: str, batch_id: int) -> str:
    return f"{query}-{batch_id:010d}"


def _with_row_seq(batch: DataFrame) -> DataFrame:
    """Row order inside one micro-batch (a static frame, where row ids are allowed)."""
    if "_row_seq" in batch.columns:
        return batch
    return batch.withColumn("_row_seq", F.monotonically_increasing_id())


def _freshness_row(batch: DataFrame, ds: Dataset, batch_id: int, status: str) -> DataFrame:
    """ST5: one metrics row per batch (newest period seen, when it was checked)."""
    newest = F.max(ds.period).cast("string") if ds.period and ds.period in batch.columns else F.lit(None).cast("string")
    return batch.agg(F.lit(ds.name).alias("dataset"), F.lit(int(batch_id)).cast("long").alias("batch_id"),
                     F.count(F.lit(1)).alias("rows"), newest.alias("source_as_of"),
                     F.current_timestamp().alias("last_checked_at"), F.lit(status).alias("status"))


def refresh(stream: DataFrame, root: str, ds: Dataset, clean: Callable[[DataFrame], DataFrame] | None = None,
            every_seconds: int | None = None, name: str | None = None) -> StreamingQuery:
    """ST1: ingest → clean → validate → reconcile → publish per micro-batch.

    A failed gate publishes nothing, so readers keep the last good snapshot.  A
    micro-batch may hold part of a pull only: keys that it lacks keep their rows.
    ``every_seconds=None`` processes what has landed and stops (availableNow).
    """
    spark = stream.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/refresh_{name or ds.name}"

    query = _stream_id(spark, ckpt)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = _with_row_seq(batch).persist()
        try:
            data = clean(batch) if clean else batch
            res = publish(data, root, ds, snapshot_id=_snapshot_id(query, batch_id), partial=True)
            _freshness_row(data, ds, batch_id, res.status).write.mode("append").parquet(
                f"{root.rstrip('/')}/_freshness")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    if name:
        w = w.queryName(name)
    return _trigger(w, every_seconds).start()


def upsert(stream: DataFrame, root: str, ds: Dataset, every_seconds: int | None = None,
           name: str | None = None) -> StreamingQuery:
    """ST2: keyed upsert of re-pulled rows into the published snapshot."""
    spark = stream.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/upsert_{name or ds.name}"

    query = _stream_id(spark, ckpt)

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_snapshot(_with_row_seq(batch), root, ds, snapshot_id=_snapshot_id(query, batch_id))

    return _trigger(stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt), every_seconds).start()


def _is_ntz(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes).get(col) == "timestamp_ntz"


def dedupe(stream: DataFrame, key: Sequence[str], event_time: str, watermark: str = "1 day") -> DataFrame:
    """ST3: drop re-sent rows; state is bounded by the watermark (older re-sends
    are handled by the keyed upsert of ST2, not by state).  Watermarks need a
    zoned timestamp, so a zone-less event time is read in the session zone."""
    if not _is_ntz(stream, event_time):
        return stream.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(list(key))
    et = "__event_time"
    return (stream.withColumn(et, F.col(event_time).cast("timestamp")).withWatermark(et, watermark)
                  .dropDuplicatesWithinWatermark(list(key)).drop(et))


def hourly_rollup(df: DataFrame, ts: str, by: Sequence[str], value: str, watermark: str | None = "2 hours",
                  window: str = "1 hour") -> DataFrame:
    """ST4: tumbling-window rollup; late rows within the watermark are still
    counted, the window is emitted once the watermark passes it (append mode).
    Pass ``watermark=None`` for the batch twin (same grouping, no state)."""
    start = F.col("w.start")
    if watermark:
        if _is_ntz(df, ts):  # watermarks need a zoned timestamp; results go back to the input type
            df = df.withColumn(ts, F.col(ts).cast("timestamp"))
            start = start.cast("timestamp_ntz")
        df = df.withWatermark(ts, watermark)
    g = df.groupBy(F.window(ts, window).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total_value"))
    return g.select(start.alias("window_start"), *by, "n", F.round("total_value", 6).alias("total_value"))


def with_submissions(main: DataFrame, submitted: DataFrame, tag: str = "user_input", main_tag: str | None = None) -> DataFrame:
    """ST6: a second source (rows typed in by users) appended to the main stream.

    Columns that one side lacks are null; ``data_quality`` tells the sources apart
    (``main_tag`` for main rows, where they have no tag of their own).
    """
    if main_tag is not None:
        own = F.col("data_quality") if "data_quality" in main.columns else F.lit(None).cast("string")
        main = main.withColumn("data_quality", F.coalesce(own, F.lit(main_tag)))
    return main.unionByName(submitted.withColumn("data_quality", F.lit(tag)), allowMissingColumns=True)


def source_freshness(batch: DataFrame, ds: Dataset, batch_id: int, source_col: str = "data_quality") -> DataFrame:
    """ST5: one row per source in the batch: rows, newest period (where there is one), when it was checked."""
    newest = F.max(ds.period).cast("string") if ds.period and ds.period in batch.columns else F.lit(None).cast("string")
    return batch.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("rows"), newest.alias("source_as_of")).select(
        F.lit(ds.name).alias("dataset"), F.lit(int(batch_id)).cast("long").alias("batch_id"), "source", "rows", "source_as_of",
        F.current_timestamp().alias("last_checked_at"))


def collect_sources(main: DataFrame, submitted: DataFrame, root: str, ds: Dataset, tag: str = "user_input", main_tag: str = "official",
                    id_from: str | None = None, every_seconds: int | None = None, name: str | None = None) -> StreamingQuery:
    """ST6: one query over the main stream and the stream of submissions, upserted into the published snapshot.

    Submitted rows get a surrogate key from ``id_from`` (P21; null: they bring
    their own key), so they never replace a main row.  Each batch appends its rows
    per source to ``<root>/_sources`` (``source_freshness``) under its own batch
    folder.  Offsets of both sources are in one checkpoint: a restart goes on
    where each of them stopped.
    """
    spark = main.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/sources_{name or ds.name}"
    if id_from is not None:
        submitted = submitted.withColumn(ds.key[0], surrogate_id(F.col(id_from)))
        main = main.withColumn(ds.key[0], F.col(ds.key[0]).cast("string"))
    query = _stream_id(spark, ckpt)

    def run(batch: DataFrame, batch_id: int) -> None:
        upsert_snapshot(_with_row_seq(batch), root, ds, snapshot_id=_snapshot_id(query, batch_id))
        source_freshness(batch, ds, batch_id).write.mode("overwrite").parquet(f"{root.rstrip('/')}/_sources/stream={query}/batch={batch_id}")

    both = with_submissions(main, submitted, tag, main_tag)
    return _trigger(both.writeStream.foreachBatch(run).option("checkpointLocation", ckpt), every_seconds).start()
