"""Snapshots as manifests of hash-bucketed, key-sorted files.

Layout under the folder of one dataset:

* ``data/_gen=<id>/_b=<bucket>/`` — parquet files, written once by one attempt
  (generation) and never changed: one file for each bucket, sorted by key;
* ``_log/<seq>.json`` — one manifest per snapshot: bucket count, key, schema and,
  for every bucket, the generation whose file holds it.

A new snapshot names the generations of the buckets it rewrote and, for all
others, what the snapshot before named, so its cost is that of the buckets it
touches.  Files that no manifest names (of a crashed or beaten attempt) are never
read.

The buckets are Spark's own (``CLUSTERED BY``): a snapshot can be read through an
external table with one partition a bucket, each at the folder of its generation,
and two snapshots of one bucket count are compared by a merge join without an
exchange.  A plain read of the live files serves everything else.

Publishing is optimistic.  ``commit`` creates the manifest after the one the
publisher started from, and fails if another has created it; the publisher then
takes the new head as its base and tries again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows to a bucket when a snapshot is first laid out, and the most buckets.
ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 1 << 15
#: A load this many times larger than the layout was made for gets a new layout.
OUTGROWN = 4

LOG = "seq long, snapshot string, parent long, buckets int, key array<string>, schema string, live map<string,map<string,bigint>>, rejects string, published_at string"


def bucket_count(rows: int) -> int:
    """The power of two that gives buckets of about ``ROWS_PER_BUCKET`` rows at most."""
    n = 1
    while n * ROWS_PER_BUCKET < rows and n < MAX_BUCKETS:
        n *= 2
    return n


@dataclass(frozen=True)
class Manifest:
    """One snapshot: ``live`` maps a bucket to (generation, rows); empty buckets are not in it."""

    snapshot: str
    buckets: int
    key: tuple[str, ...]
    schema: StructType
    live: dict[int, tuple[str, int]] = field(default_factory=dict)
    seq: int = 0
    rejects: str | None = None

    @property
    def rows(self) -> int:
        """The row count, known without a scan."""
        return sum(n for _, n in self.live.values())

    def with_live(self, gen: str, rows: dict[int, int], emptied: Iterable[int] = ()) -> Manifest:
        """These buckets held by ``gen`` instead, and ``emptied`` ones by none."""
        live = {b: at for b, at in self.live.items() if b not in set(emptied)}
        return replace(self, live=live | {b: (gen, n) for b, n in rows.items()})


def _from_row(r) -> Manifest:
    live = {int(b): (gen, n) for gen, own in r["live"].items() for b, n in own.items()}
    return Manifest(r["snapshot"], r["buckets"], tuple(r["key"]), StructType.fromJson(json.loads(r["schema"])), live, r["seq"], r["rejects"])


class BucketStore:
    """Snapshots of one dataset under ``base``."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._tables: list[str] = []

    # -- the log --------------------------------------------------------------------------------
    def log(self) -> DataFrame | None:
        """All manifests, or None before the first; any other read error is raised."""
        try:
            return self.spark.read.schema(LOG).json(f"{self.base}/_log")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def state(self, snapshot: str | None = None) -> tuple[Manifest | None, bool]:
        """(current snapshot, whether one of this name was ever published), in one pass over the log."""
        log = self.log()
        if log is None:
            return None, False
        named = F.lit(False) if snapshot is None else F.col("snapshot") == snapshot
        row = log.agg(F.max_by(F.struct("*"), "seq").alias("head"), F.coalesce(F.max(named), F.lit(False)).alias("named")).first()
        return (None if row["head"] is None else _from_row(row["head"])), row["named"]

    def head(self) -> Manifest | None:
        """The current snapshot."""
        return self.state()[0]

    def find(self, snapshot: str) -> Manifest | None:
        """The snapshot of this name, current or earlier."""
        log = self.log()
        row = None if log is None else log.where(F.col("snapshot") == snapshot).orderBy("seq").limit(1).collect()
        return _from_row(row[0]) if row else None

    def commit(self, new: Manifest, base: Manifest | None) -> bool:
        """Make ``new`` the snapshot after ``base``; False if another came first."""
        seq = (base.seq if base else 0) + 1
        live: dict[str, dict[int, int]] = {}
        for b, (gen, n) in sorted(new.live.items()):
            live.setdefault(gen, {})[b] = n
        body = {"seq": seq, "snapshot": new.snapshot, "parent": base.seq if base else None, "buckets": new.buckets, "key": list(new.key),
                "schema": new.schema.json(), "live": live, "rejects": new.rejects,
                "published_at": self.spark.sql("SELECT CAST(current_timestamp() AS STRING)").first()[0]}
        return create_if_absent(self.spark, f"{self.base}/_log/{seq:020d}.json", json.dumps(body) + "\n")

    # -- the data -------------------------------------------------------------------------------
    def _register(self, schema: StructType, key: tuple[str, ...], buckets: int, folder: str) -> str:
        """A bucketed external table over ``folder``, one partition a bucket; the name is this store's own."""
        cols = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields])
        by = ", ".join(f"`{k}`" for k in key)
        name = f"buckets_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {name} ({cols}, `_b` INT) USING parquet PARTITIONED BY (`_b`) "
                       f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION {_quoted(folder)}")
        self._tables.append(name)
        return name

    def forget(self) -> None:
        """Drop the tables that this store registered; their files are external and stay."""
        while self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop()}")

    def write(self, df: DataFrame, key: tuple[str, ...], buckets: int) -> tuple[str, dict[int, int]]:
        """Write rows as a new generation, one sorted file a bucket if ``df`` lies in the buckets' order; (generation, rows by bucket).

        A generation is a folder and, while it is written, a table of its own, so
        that writers at once share no output folder.
        """
        gen = uuid.uuid4().hex
        folder = f"{self.base}/data/_gen={gen}"
        name = self._register(df.schema, key, buckets, folder)
        df.select("*", bucket_of(key, buckets).alias("_b")).write.insertInto(name)
        try:  # row counts come from the footers of what was committed
            done = self.spark.read.schema("_b int").parquet(folder)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return gen, {}
        return gen, {r["_b"]: r["n"] for r in done.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}

    def read(self, m: Manifest, buckets: Iterable[int] | None = None, bucketed: bool = False) -> DataFrame:
        """Rows of a snapshot, or of some of its buckets.

        ``bucketed``: through a table that names the live file of each bucket, so
        that Spark knows the buckets and joins on the key need no exchange; every
        bucket is then one task, the ones not asked for empty.  Such a frame can be
        used until ``forget``.
        """
        asked = m.live if buckets is None else {b: m.live[b] for b in buckets if b in m.live}
        if not asked:
            return self.spark.createDataFrame([], m.schema)
        if not bucketed:
            return self.spark.read.schema(m.schema).parquet(*[f"{self.base}/data/_gen={gen}/_b={b}" for b, (gen, _) in sorted(asked.items())])
        name = self._register(m.schema, m.key, m.buckets, f"{self.base}/data")
        places = [f"PARTITION (_b = {b}) LOCATION {_quoted(f'{self.base}/data/_gen={gen}/_b={b}')}" for b, (gen, _) in sorted(asked.items())]
        for at in range(0, len(places), 500):
            self.spark.sql(f"ALTER TABLE {name} ADD {' '.join(places[at:at + 500])}")
        return self.spark.table(name).select(*m.schema.names)


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bucket_of(key: tuple[str, ...], buckets: int) -> Column:
    """The bucket Spark gives a row: its hash partitioning by the key."""
    return F.pmod(F.hash(*key), F.lit(buckets)).cast("int")


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a whole file unless it exists; of several callers exactly one gets True.

    Local files are linked into place from a finished one, which fails if the
    name is taken.  Elsewhere the finished file is renamed, which HDFS refuses if
    the name is taken; a store without such a rename is no place for the log.
    """
    local, fs = None, None
    if getattr(spark, "_jvm", None) is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        whole = fs.makeQualified(p).toString()
        local = urlparse(whole).path if whole.startswith("file:") else None
    elif urlparse(path).scheme in ("", "file"):  # a Connect client reaches local folders only
        local = urlparse(path).path
    else:
        raise RuntimeError(f"publishing to {path} needs a session with a driver of its own")
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        held = os.path.join(os.path.dirname(local), f".{uuid.uuid4().hex}.tmp")
        with open(held, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(held, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(held)
    held = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}.tmp")
    out = fs.create(held, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.exists(p) and fs.rename(held, p):
        return True
    fs.delete(held, False)
    return False
