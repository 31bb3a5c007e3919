"""Serving functions (P11-P15, O1, O4, S3, S16, U1, U4, U5): parameterised,
lazy DataFrames, so Catalyst sees filter → aggregate → output as one plan and
pushes the filters into the parquet scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

ALL = ("ALL", "All")


def _and(conds: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conds) if conds else None


def panel(df: DataFrame, entity: str | None = None, year_from: int | None = None, year_to: int | None = None,
          entity_col: str = "entity", period_col: str = "period") -> DataFrame:
    """Optional filters (entity upper-cased; inclusive years; a falsy year
    means no bound), ordered by key."""
    conds = []
    if entity:
        conds.append(F.col(entity_col) == entity.strip().upper())
    if year_from:
        conds.append(F.col(period_col) >= int(year_from))
    if year_to:
        conds.append(F.col(period_col) <= int(year_to))
    c = _and(conds)
    out = df.where(c) if c is not None else df
    return out.orderBy(entity_col, period_col)


def firms(df: DataFrame, entity: str | None = None, sector: str | None = None) -> DataFrame:
    conds = []
    if entity:
        conds.append(F.col("entity") == entity.strip().upper())
    if sector:
        conds.append(F.col("sector") == sector)
    c = _and(conds)
    return (df.where(c) if c is not None else df).orderBy("firm_id")


def lookup_one(df: DataFrame, key: str, value) -> DataFrame:
    """The row with ``key == value`` (empty when not found)."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def multi_select(df: DataFrame, col: str, values: Sequence[str] | str, period_col: str | None = None,
                 lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Multi-select (``ALL``/``All`` means no filter) and a closed range."""
    conds = []
    vals = [values] if isinstance(values, str) else list(values)
    if vals and not any(v in ALL for v in vals):
        conds.append(F.col(col).isin(*vals))
    if period_col is not None and lo is not None and hi is not None:
        conds.append(F.col(period_col).between(lo, hi))
    c = _and(conds)
    return df.where(c) if c is not None else df


def pick_metric(df: DataFrame, ids: Sequence[str], measures: Sequence[str], metric: str) -> DataFrame:
    """Choose the value column by name via unpivot + filter."""
    long = df.unpivot(list(ids), list(measures), "metric", "value")
    return long.where(F.col("metric") == metric)


def page(df: DataFrame, order: Sequence[Column | str], page_no: int, size: int = 10) -> DataFrame:
    """One page of an ordered view (the page size is the feature)."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def to_records(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Row → JSON record."""
    return df.select(*key, F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))


def conform_sources(a: DataFrame, b: DataFrame, code_map: Mapping[str, str], keep_codes: Sequence[str],
                    rename_a: Mapping[str, str], rename_b: Mapping[str, str], target: Sequence[tuple[str, str]],
                    tag: str = "official") -> DataFrame:
    """S2 + S3 + P15: narrow two extracts to a code list, keep only mapped columns
    that exist, rename, inner-join on (code, year), map codes through a fixed
    dictionary (unmapped → dropped), add missing target columns as null, tag."""
    def prep(df, ren):
        cols = [c for c in ["iso_code", "year", *ren] if c in df.columns]
        return df.where(F.col("iso_code").isin(*keep_codes)).select(*cols).withColumnsRenamed(
            {k: v for k, v in ren.items() if k in df.columns})
    j = prep(a, rename_a).join(prep(b, rename_b), ["iso_code", "year"], "inner")
    m = F.create_map(*[x for k, v in code_map.items() for x in (F.lit(k), F.lit(v))])
    j = j.withColumn("country_code", m[F.col("iso_code")]).where(F.col("country_code").isNotNull())
    out = []
    for name, typ in target:
        out.append((F.col(name) if name in j.columns else F.lit(None)).cast(typ).alias(name))
    return j.select(*out, F.lit(tag).alias("data_quality"))


def sankey(df: DataFrame, ids: Sequence[str], sources: Sequence[str], target: str) -> DataFrame:
    """U4: node/edge list — each source column flows into one target node."""
    long = df.unpivot(list(ids), list(sources), "source", "value")
    return long.withColumn("target", F.lit(target))


def missing_codes(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Distinct codes of ``expected`` absent from ``observed`` (anti-join)."""
    e = expected.toDF("code").distinct()
    o = observed.toDF("code").distinct()
    return e.join(o, "code", "left_anti")


def surrogate_id(key: Column, prefix: str = "USR-") -> Column:
    """Content-derived id (a clock-based id collides within a second)."""
    return F.concat(F.lit(prefix), F.sha2(key.cast("string"), 256))
