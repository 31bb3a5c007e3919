"""ST4: append-mode window rollup that keeps the rows that came too late.

``refresh.hourly_rollup`` under Spark's own watermark emits the same windows but
drops late rows unseen.  Here one query routes every row: each micro-batch is
split by the watermark that held before it, rows of windows still open go into
partial aggregates, others into a side table, and the windows that the batch's
own event times close are summed up and appended once.

Tables under ``out`` (each batch writes a folder of its own, so a replay after a
failure replaces what the failed attempt left):

* ``batches/batch=<id>`` — rows, late rows, watermark before and after;
* ``partial/batch=<id>`` — aggregates of the rows in time, by window and group;
* ``late/batch=<id>``    — the rows that came too late, whole;
* ``rollup/batch=<id>``  — windows that closed, final.

A row is too late when its window ended at or before the watermark: the greatest
event time of the batches before, less ``delay``, which is Spark's own rule.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from terrapanel.session import checkpoint_dir
from terrapanel.streaming.refresh import _trigger

BATCH = "rows long, late_rows long, before_us long, after_us long, open_us long"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """A table written batch by batch; None before the first."""
    try:
        return (spark.read if schema is None else spark.read.schema(f"{schema}, batch long")).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


@dataclass(frozen=True)
class Rollup:
    """The rollup kept under ``out``."""

    out: str
    ts: str
    by: tuple[str, ...]
    value: str
    delay: str = "2 hours"
    window: str = "1 hour"

    def batches(self, spark: SparkSession) -> DataFrame | None:
        """(batch, rows, late_rows, before_us, after_us, open_us): what each batch held, the watermark in microseconds
        (null: none yet), and when its last window ends."""
        return _read(spark, f"{self.out}/batches", BATCH)

    def windows(self, spark: SparkSession) -> DataFrame | None:
        """The closed windows: window_start, group, n, total_value."""
        t = _read(spark, f"{self.out}/rollup")
        return None if t is None else t.select("window_start", *self.by, "n", F.round("total_value", 6).alias("total_value"))

    def late(self, spark: SparkSession) -> DataFrame | None:
        """The rows that came too late."""
        t = _read(spark, f"{self.out}/late")
        return None if t is None else t.drop("batch")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Route one micro-batch; the same id again replaces what it wrote before."""
        spark = batch.sparkSession
        done = self.batches(spark)
        before = None if done is None else done.where(F.col("batch") < batch_id).agg(F.max("after_us").alias("w")).first()["w"]
        end = F.window(self.ts, self.window)
        micros = lambda c: F.unix_micros(c.cast("timestamp"))
        tagged = batch.withColumn("__w", end).withColumn("__end", micros(F.col("__w.end")))
        late = F.lit(False) if before is None else F.col("__end") <= F.lit(before)
        in_time = tagged.where(~late)
        sums = in_time.groupBy(F.col("__w.start").alias("window_start"), F.col("__end").alias("end_us"), *self.by).agg(
            F.count(F.lit(1)).alias("n"), F.sum(self.value).alias("total_value"))
        sums.write.mode("overwrite").parquet(f"{self.out}/partial/batch={batch_id}")
        # a row without an event time is in no window: it is kept with the late ones
        (tagged.where(late).select(*batch.columns).unionByName(batch.where(F.col(self.ts).isNull()))
               .write.mode("overwrite").parquet(f"{self.out}/late/batch={batch_id}"))
        delay = F.expr(f"INTERVAL {self.delay}")
        seen = batch.agg(F.count(F.lit(1)).alias("rows"), micros(F.max(self.ts).cast("timestamp") - delay).alias("w")).first()
        after = max((x for x in (before, seen["w"]) if x is not None), default=None)
        closed = spark.createDataFrame([], sums.schema)
        if after is not None:
            part = spark.read.schema(sums.schema).parquet(*[f"{self.out}/partial/batch={b}" for b in self._ids(done, batch_id, before)])
            newly = F.col("end_us") <= F.lit(after)
            closed = part.where(newly if before is None else newly & (F.col("end_us") > F.lit(before)))
        (closed.groupBy("window_start", *self.by).agg(F.sum("n").alias("n"), F.sum("total_value").alias("total_value"))
               .write.mode("overwrite").parquet(f"{self.out}/rollup/batch={batch_id}"))
        late_rows = spark.read.schema("__none int").parquet(f"{self.out}/late/batch={batch_id}").count()
        open_us = spark.read.schema(sums.schema).parquet(f"{self.out}/partial/batch={batch_id}").agg(F.max("end_us")).first()[0]
        # last: a batch counts once this row is there
        spark.createDataFrame([(seen["rows"], late_rows, before, after, open_us)], BATCH).coalesce(1).write.mode("overwrite").parquet(f"{self.out}/batches/batch={batch_id}")

    @staticmethod
    def _ids(done: DataFrame | None, batch_id: int, before: int | None) -> list[int]:
        """Batches with partial sums of windows that were open before this one."""
        if done is None:
            return [batch_id]
        still = F.lit(True) if before is None else F.col("open_us") > F.lit(before)
        return sorted({batch_id, *(r["batch"] for r in done.where((F.col("batch") < batch_id) & still).select("batch").collect())})

    def start(self, stream: DataFrame, name: str, every_seconds: int | None = None) -> StreamingQuery:
        """Feed a stream into the rollup; progress lives under the shared checkpoint folder, so a restart goes on where it stopped."""
        ckpt = f"{checkpoint_dir(stream.sparkSession).rstrip('/')}/rollup_{name}"
        return _trigger(stream.writeStream.foreachBatch(self.add).option("checkpointLocation", ckpt), every_seconds).start()


def rollup(out: str, ts: str, by: Sequence[str], value: str, delay: str = "2 hours", window: str = "1 hour") -> Rollup:
    return Rollup(out.rstrip("/"), ts, tuple(by), value, delay, window)
