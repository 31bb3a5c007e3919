"""ST3: dedupe of re-sent rows across runs, by a durable index of seen keys.

``refresh.dedupe`` forgets a key when the watermark passes it; this index never
does.  Keys are kept as 128-bit hashes in runs: each micro-batch adds the hashes
of its new keys as one run, and when ``FANOUT`` runs of one level have gathered
they are written together as one run of the next, so n batches leave about
``FANOUT * log(n)`` runs and a hash is rewritten once a level.

A run is a generation of the bucketed store: bucketed and sorted by hash.  A
batch is staged in the same buckets, and then meets run after run by anti-joins
that move neither side.  With ``event_time``, each run also has the
least and greatest event time of its rows, and a batch asks only the runs that
overlap its own: a row sent again has the event time it had.

The list of runs after each batch is a small file, created once; a replayed batch
finds the list of the batch before, and gives the same rows again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from terrapanel.session import checkpoint_dir
from terrapanel.sources.buckets import BucketStore, Manifest, create_if_absent
from terrapanel.streaming.refresh import _trigger

FANOUT = 4
HASH = ("h1", "h2")
HASHES = StructType([StructField(h, LongType()) for h in HASH])
RUNS = "batch long, runs array<struct<gen:string,level:int,low:string,high:string,live:map<string,bigint>>>"


@dataclass(frozen=True)
class Run:
    gen: str
    level: int
    low: str | None     # least and greatest event time, null without one
    high: str | None
    live: dict[int, int]

    @property
    def rows(self) -> int:
        return sum(self.live.values())


class SeenKeys:
    """Keys seen so far, under ``path``; one stream feeds it."""

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], event_time: str | None = None, buckets: int = 64):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.event_time, self.buckets = event_time, buckets
        self.store = BucketStore(spark, self.path)

    def runs(self, before: int | None = None) -> list[Run]:
        """The runs after the newest batch, or after the newest one before this."""
        try:
            log = self.spark.read.schema(RUNS).json(f"{self.path}/runs")
            if before is not None:
                log = log.where(F.col("batch") < before)
            row = log.orderBy(F.col("batch").desc()).limit(1).collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = []
        return [Run(r["gen"], r["level"], r["low"], r["high"], {int(b): n for b, n in r["live"].items()}) for r in (row[0]["runs"] if row else [])]

    def _written(self, df: DataFrame) -> tuple[str, dict[int, int]]:
        return self.store.write(df.repartition(self.buckets, *HASH), HASH, self.buckets)

    def _generation(self, gen: str, live: dict[int, int], schema: StructType = HASHES) -> DataFrame:
        return self.store.read(Manifest("", self.buckets, HASH, schema, {b: (gen, n) for b, n in live.items()}), bucketed=True)

    def unseen(self, rows: DataFrame, runs: Sequence[Run]) -> DataFrame:
        """Rows (with their hashes, staged in the runs' buckets) that none of the runs has."""
        for r in runs:
            rows = rows.join(self._generation(r.gen, r.live), list(HASH), "left_anti")
        return rows

    def add(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The rows of ``batch`` whose key was never seen before (one a key), after their keys are noted.

        The frame reads written tables and may be used as often as needed; rows
        with a null in the key are keys like others.
        """
        named = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in self.key])
        digest = F.sha2(named, 256)
        half = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
        rest = F.struct(*batch.columns)
        one = batch.groupBy(half(1).alias("h1"), half(16).alias("h2")).agg(F.min(rest).alias("row"))
        gen, live = self._written(one)
        staged = self._generation(gen, live, one.schema)
        earlier = asked = self.runs(batch_id)
        low, high = self._span(staged.select("row.*"))
        if self.event_time:
            asked = [r for r in earlier if r.low is None or low is None or (r.low <= high and low <= r.high)]
        out = f"{self.path}/new/batch={batch_id}"
        self.unseen(staged, asked).write.mode("overwrite").parquet(out)
        new = self.spark.read.schema(one.schema).parquet(out)
        span = self._span(new.select("row.*"))
        gen, live = self._written(new.select(*HASH))
        after = self._compacted([*earlier, Run(gen, 0, *span, live)] if live else earlier)
        body = {"batch": batch_id, "runs": [asdict(r) for r in after]}
        create_if_absent(self.spark, f"{self.path}/runs/{batch_id:020d}.json", json.dumps(body) + "\n")
        self.store.forget()
        return new.select("row.*")

    def _span(self, rows: DataFrame) -> tuple[str | None, str | None]:
        if not self.event_time:
            return None, None
        t = F.col(f"`{self.event_time}`").cast("timestamp")
        # rows without a time may be in any run
        r = rows.agg(F.min(t).cast("string").alias("low"), F.max(t).cast("string").alias("high"), F.count_if(t.isNull()).alias("n")).first()
        return (None, None) if r["n"] else (r["low"], r["high"])

    def _compacted(self, runs: list[Run]) -> list[Run]:
        level = 0
        while any(r.level >= level for r in runs):
            same = [r for r in runs if r.level == level]
            if len(same) >= FANOUT:
                whole = None
                for r in same:
                    own = self._generation(r.gen, r.live)
                    whole = own if whole is None else whole.unionAll(own)
                gen, live = self._written(whole)
                known = all(r.low is not None for r in same)
                span = (min(r.low for r in same), max(r.high for r in same)) if known else (None, None)
                runs = [r for r in runs if r.level != level] + [Run(gen, level + 1, *span, live)]
            level += 1
        return runs


def dedupe_across_runs(stream: DataFrame, path: str, key: Sequence[str], sink: Callable[[DataFrame, int], None], name: str,
                       event_time: str | None = None, every_seconds: int | None = None) -> StreamingQuery:
    """Hand ``sink`` the rows of every micro-batch whose key no earlier batch, of this run or another, has had."""
    spark = stream.sparkSession
    ckpt = f"{checkpoint_dir(spark).rstrip('/')}/seen_{name}"
    seen = SeenKeys(spark, path, key, event_time)

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(seen.add(batch, batch_id), batch_id)

    return _trigger(stream.writeStream.foreachBatch(run).option("checkpointLocation", ckpt), every_seconds).start()
