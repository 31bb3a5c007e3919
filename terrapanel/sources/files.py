"""File sources and sinks (S1, S4-S9, S11, S12, S15; A8 counts on the write).

Raw files are *appended* under ``raw/<dataset>/_run_id=<UTC stamp>``; nothing is
ever deleted.  "Only the latest pull counts" is a read rule: the run folders are
listed by name, and only the newest one is read.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

# Fixed value: run stamp format (UTC), e.g. 20240131T235959Z.
STAMP_FMT = "%Y%m%dT%H%M%SZ"
STAMP_SPARK = "yyyyMMdd'T'HHmmss'Z'"


def run_stamp(now: dt.datetime | None = None) -> str:
    now = now or dt.datetime.now(dt.timezone.utc)
    return now.astimezone(dt.timezone.utc).strftime(STAMP_FMT)


# -- S1: CSV scan with an explicit schema ------------------------------------------------------
def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Header CSV; with a schema, bad rows land in ``_corrupt`` instead of failing
    (inference only when no schema is given)."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is None:
        return r.option("inferSchema", True).csv(path)
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    schema = StructType(schema.fields + [StructType.fromDDL("_corrupt string").fields[0]])
    return r.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").csv(path)


# -- S8: lineage columns ---------------------------------------------------------------------------
def with_lineage(df: DataFrame, mode: str, run_id: str | None = None) -> DataFrame:
    """``_ingested_at``, ``_source_file`` (from the file metadata), ``_data_mode``,
    ``_run_id`` and ``_row_seq`` (file order within a split; deterministic on re-read)."""
    out = (df.withColumn("_ingested_at", F.current_timestamp())
             .withColumn("_source_file", F.col("_metadata.file_name"))
             .withColumn("_data_mode", F.lit(mode))
             .withColumn("_row_seq", F.monotonically_increasing_id()))
    if run_id is not None:
        out = out.withColumn("_run_id", F.lit(run_id))
    return out


# -- S5 / S6: land and read the latest run --------------------------------------------------------
def land(df: DataFrame, root: str, dataset: str, run_id: str) -> str:
    """Append one pull under ``root/raw/<dataset>/_run_id=<run_id>`` (never deletes)."""
    path = f"{root.rstrip('/')}/raw/{dataset}"
    df.withColumn("_run_id", F.lit(run_id)).write.mode("append").partitionBy("_run_id").parquet(path)
    return path


def read_latest_run(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """Rows of the newest ``_run_id`` only; one listing of the run folders, no file of an older run is opened."""
    path = f"{root.rstrip('/')}/raw/{dataset}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)
    runs = [s.getPath().getName() for s in found if s.getPath().getName().startswith("_run_id=")]
    if not runs:
        raise FileNotFoundError(f"no run has landed under {path}")
    return spark.read.option("basePath", path).parquet(f"{path}/{max(runs)}")


def read_run(spark: SparkSession, root: str, dataset: str, run_id: str) -> DataFrame | None:
    """Rows of one run, or None if it has not landed."""
    path = f"{root.rstrip('/')}/raw/{dataset}"
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/_run_id={run_id}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


# -- S7: source preference with fallback ------------------------------------------------------------
def first_available(readers: Sequence[tuple[str, Callable[[], DataFrame]]]) -> DataFrame:
    """Try the readers in order; the first that loads and has a row wins, tagged
    with its ``data_quality``.  The probe is ``isEmpty`` (reads one row)."""
    last_err: Exception | None = None
    for tag, read in readers:
        try:
            df = read()
            if not df.isEmpty():
                return df.withColumn("data_quality", F.lit(tag)) if tag else df
        except (AnalysisException, Py4JJavaError, OSError) as e:  # a source that can't be read; a bug is raised
            log.warning("source %s can't be read, trying the next: %s", tag, str(e)[:200])
            last_err = e
    raise RuntimeError(f"no source produced rows (last error: {last_err})")


# -- S9: route files to datasets by name ---------------------------------------------------------------
def route(df: DataFrame, routes: dict[str, str], file_col: str = "_source_file") -> DataFrame:
    """Adds ``_dataset``: the first route whose key occurs in the file name with
    underscores removed; null (→ reject table) when none matches."""
    name = F.lower(F.regexp_replace(F.col(file_col), "_", ""))
    expr = None
    for key, ds in routes.items():
        cond = name.contains(key.replace("_", "").lower())
        expr = F.when(cond, F.lit(ds)) if expr is None else expr.when(cond, F.lit(ds))
    return df.withColumn("_dataset", expr if expr is not None else F.lit(None).cast("string"))


# -- S4: JSON-stat document -----------------------------------------------------------------------------
def read_json_stat(spark: SparkSession, path: str) -> DataFrame:
    """Flatten a JSON-stat 2.0 dataset: one row per cell with its position, value
    and one category code per dimension (row-major strides over ``size``).
    ``id`` and ``size`` are document metadata (a handful of numbers) read once."""
    doc = spark.read.option("multiLine", True).json(path)
    meta = doc.select("id", "size").first()
    ids, sizes = list(meta["id"]), [int(s) for s in meta["size"]]
    strides = [1] * len(sizes)
    for i in range(len(sizes) - 2, -1, -1):
        strides[i] = strides[i + 1] * sizes[i + 1]
    val_type = dict(doc.dtypes)["value"]
    if val_type.startswith("array"):
        cells = doc.select(F.posexplode("value").alias("pos", "value"))
    else:  # sparse form: {"<pos>": value}
        cells = doc.select(F.explode(F.from_json(F.to_json("value"), "map<string,double>")).alias("k", "value")) \
                   .select(F.col("k").cast("long").alias("pos"), "value")
    out = cells
    for d, stride, size in zip(ids, strides, sizes):
        index = doc.select(F.to_json(F.col(f"dimension.`{d}`.category.index")).alias("j")).first()["j"]
        codes = _category_codes(index, size)
        arr = F.array(*[F.lit(c) for c in codes])
        out = out.withColumn(d, F.element_at(arr, (F.floor(F.col("pos") / stride) % size + 1).cast("int")))
    return out


def _category_codes(index_json: str | None, size: int) -> list[str]:
    import json

    if not index_json:
        return [str(i) for i in range(size)]
    idx = json.loads(index_json)
    if isinstance(idx, list):
        return [str(x) for x in idx]
    return [k for k, _ in sorted(idx.items(), key=lambda kv: kv[1])]


# -- S11 / S12 / S15: namespaces, full replace, CSV export ---------------------------------------------
def ensure_namespace(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def replace_table(df: DataFrame, table: str, fmt: str = "parquet") -> None:
    """Full replace with the new schema (``overwrite`` of a managed table)."""
    df.write.mode("overwrite").format(fmt).option("overwriteSchema", "true").saveAsTable(table)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> int:
    """Write and return the row count from an ``Observation`` filled by the
    write itself (no second scan of the data)."""
    obs = Observation("write_rows")
    df.observe(obs, F.count(F.lit(1)).alias("n")).write.format(fmt).mode(mode).save(path)
    return int(obs.get["n"])


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header; one part file per task (no single-file funnel)."""
    df.write.mode("overwrite").option("header", True).csv(path)
