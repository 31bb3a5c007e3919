"""Typed reading of delimited text files in which nothing is lost.

Files of one folder may have different headers.  ``read_text`` reads every field
as text under its own file's header.  ``intake`` routes the files to datasets by
name, checks every row against the contract as text, and gives typed valid rows
(defaults filled, unknown columns moved to ``_rescued``) and rejects with the
reason and the whole row; a file that no route takes is rejected row by row.
Rows in = valid rows + rejected rows.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from terrapanel.operators import quality as Q
from terrapanel.registry import Dataset
from terrapanel.sources.files import route

LINEAGE = ("_source_file", "_dataset", "_header")
REJECTS = "dataset string, source_file string, reason string, row map<string,string>"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, header): the first line of every file, found where its first block starts."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                                         F.monotonically_increasing_id().alias("at"), "value")
    return lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))


def _names(header: str) -> list[str]:
    """Column names of a header line; blank and repeated ones get a number."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([header.lstrip("﻿")]))):
        name = name.strip() or f"_c{i}"
        out.append(name if name.lower() not in {x.lower() for x in out} else f"{name}_{i}")
    return out


def _with(other: str, corrupt: str) -> Column:
    """The column of malformed lines, in a form that always reads another one too: Spark refuses to read it alone."""
    return F.when(F.length(F.coalesce(F.col(f"`{other}`"), F.lit(""))) >= 0, F.col(corrupt)).alias(corrupt)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """All rows of delimited files with a header each, every field as text, with ``_source_file``
    and the column names of the file (``_header``).

    One scan per distinct header; files that share one are read together.
    Columns that a file lacks are null; fields beyond its header go, with the
    line, to ``_corrupt``, like lines that can't be split.
    """
    groups: dict[str, list[str]] = {}
    for r in headers(spark, path).collect():  # one row a file
        groups.setdefault(r["header"], []).append(r["file"])
    out = None
    for header, files in sorted(groups.items()):
        schema = StructType([StructField(n, StringType()) for n in [*_names(header), "_corrupt"]])
        part = (spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt").csv(sorted(files))
                .select(*[f"`{n}`" for n in _names(header)], _with(_names(header)[0], "_corrupt"), F.col("_metadata.file_name").alias("_source_file"), F.array(*[F.lit(n) for n in _names(header)]).alias("_header")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "_corrupt string, _source_file string, _header array<string>")


def _column_type(ds: Dataset, c: str) -> str:
    return "bigint" if c in ds.int_cols else "double" if c in ds.bounds or c in ds.clamp or c in ds.measures else "string"


def typed(ds: Dataset, c: str) -> Column:
    """A text column as the contract has it; integers may be written as ``2020.0``."""
    t = _column_type(ds, c)
    x = F.col(f"`{c}`")
    if t == "bigint":
        return F.when(x.try_cast("bigint").isNotNull(), x.try_cast("bigint")).otherwise(x.try_cast("double").try_cast("bigint"))
    return x if t == "string" else x.try_cast(t)


@dataclass
class Intake:
    """``valid``: per dataset the typed rows with ``_rescued`` (unknown columns, null without any) and ``_source_file``; ``rejects``: all others."""

    valid: dict[str, DataFrame]
    rejects: DataFrame


def _map(columns: list[str]) -> Column:
    """The non-null ones of text columns as a map."""
    if not columns:
        return F.lit(None).cast("map<string,string>")
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").alias("value")) for c in columns])
    held = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    return F.when(F.size(held) > 0, held)


def intake(raw: DataFrame, routes: Mapping[str, Dataset]) -> Intake:
    """Split a text frame (``read_text``) into valid typed rows per dataset and rejects.

    ``routes``: part of a file name (underscores aside) → dataset; the first that
    matches takes the file.  Blank fields are null.  Columns that no contract
    column of the dataset names are its unknown columns.  A column that the
    contract gives a default is filled where the file lacks it; null where the
    file has it is an error, as for required columns.
    """
    fields = [c for c in raw.columns if c not in LINEAGE and c != "_corrupt"]
    blank = lambda c: F.when(F.trim(F.col(f"`{c}`")) == "", None).otherwise(F.col(f"`{c}`")).alias(c)
    text = raw.select(*[blank(c) for c in fields], "_corrupt", "_source_file", "_header")
    text = route(text, {k: ds.name for k, ds in routes.items()})
    whole = _map([*fields, "_corrupt"])
    valid: dict[str, DataFrame] = {}
    rejects = text.where(F.col("_dataset").isNull()).select(F.lit(None).cast("string").alias("dataset"), F.col("_source_file").alias("source_file"),
                                                            F.lit("no_route").alias("reason"), whole.alias("row"))
    for ds in {d.name: d for d in routes.values()}.values():
        own = text.where(F.col("_dataset") == ds.name)
        known = [c for c in ds.columns if c in fields]
        extra = [c for c in fields if c not in ds.columns]
        had = lambda c: F.array_contains("_header", c)
        given = [F.when(had(c), F.col(c)).otherwise(F.lit(ds.defaults[c])).alias(c) if c in ds.defaults else F.col(c) for c in known]
        rows = own.select(*given, _map(extra).alias("_rescued"), "_source_file", "_corrupt", whole.alias("_row"))
        rows = Q.validate(Q.to_contract(rows, ds, text=True), ds)
        reason = F.when(F.col("_corrupt").isNotNull(), F.lit("malformed")).otherwise(F.col("first_error"))
        ok = F.col("is_valid") & F.col("_corrupt").isNull()
        have = [c for c in ds.columns if c in rows.columns]
        valid[ds.name] = rows.where(ok).select(*[typed(ds, c).alias(c) for c in have], "_rescued", "_source_file")
        rejects = rejects.unionAll(rows.where(~ok).select(F.lit(ds.name), "_source_file", reason, "_row"))
    return Intake(valid, rejects)
