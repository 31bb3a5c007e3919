"""Lazy access to the base tables of one data folder.

Tables are parquet; nothing is read until an action runs, and Catalyst prunes
columns and pushes filters into each scan.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from terrapanel.session import checkpoint_dir

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# Schema of each base table, read from the footer once per process: with a
# schema given, ``spark.read`` skips the inference job it otherwise runs on
# every call (the input tables are read-only).
_SCHEMAS: dict[str, StructType] = {}


class Tables:
    """``Tables(spark, dir).orders`` → DataFrame over ``dir/orders.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return os.path.join(self.root, f"{name}.parquet")

    def table(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(name)
        path = self.path(name)
        schema = _SCHEMAS.get(path)
        if schema is None:
            df = self.spark.read.parquet(path)
            _SCHEMAS[path] = df.schema
            return df
        return self.spark.read.schema(schema).parquet(path)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.table(name)
        raise AttributeError(name)


def tables(spark: SparkSession, root: str) -> Tables:
    return Tables(spark, root)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a parquet table under the shared checkpoint folder and
    return a DataFrame over the written files.

    Used for derived views that are small next to their inputs (aggregates of
    ``orders``) and that a query consumes more than once: every later use reads
    the written table instead of re-scanning and re-shuffling the base tables,
    the lineage is cut (a lost executor re-reads files, not the whole upstream
    plan), and AQE plans the consumers on the table's real size.  One write job;
    ``DataFrame.checkpoint`` would compute the plan twice without a cache.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
