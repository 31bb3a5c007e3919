"""Reconcile a new load against the last published snapshot.

Plan: one left join of new ⋈ previous on the natural key (previous made
key-unique first), one narrow stage that builds the array of per-column
anomalies, then anti/semi joins on the flagged keys.  Flagged keys are a
small fraction by design; they are joined back by key like any other side,
and AQE broadcasts them only when their measured size allows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from terrapanel.functions.clean import relative_change
from terrapanel.operators.window import latest_per_key
from terrapanel.registry import TOL_HIGH_VOLATILITY, Dataset

ANOMALY = "struct<column:string,previous_value:double,new_value:double,relative_change:double,tolerance:double>"


def volatility_tolerances(history: DataFrame, ds: Dataset, high: float = TOL_HIGH_VOLATILITY, share: float = 0.5) -> DataFrame:
    """V6: the tolerance of every series and check column from its own past, (entity, ``tol_<column>``...).

    A series is volatile when its median absolute change from period to period
    (robust: one bad pull doesn't move it) exceeds ``share`` of the dataset's
    tolerance, so that an ordinary move would come near the gate; it gets ``high``.
    The window and the median hold one series: its periods, however many rows fed them.
    """
    w = Window.partitionBy(ds.entity).orderBy(ds.period)
    moves = history.select(ds.entity, *[F.abs(relative_change(F.col(c), F.lag(c).over(w))).alias(c) for c in ds.check_cols])
    return moves.groupBy(ds.entity).agg(*[
        F.when(F.median(c) > F.lit(share * ds.tolerance), F.lit(max(high, ds.tolerance))).otherwise(F.lit(ds.tolerance)).alias(f"tol_{c}")
        for c in ds.check_cols])


def compare(new: DataFrame, previous: DataFrame | None, ds: Dataset,
            tolerance: float | Mapping[str, float] | DataFrame | None = None) -> DataFrame:
    """New rows with ``_anomalies``: one entry per check column whose relative
    change is *strictly* greater than the tolerance.  Null, missing previous and
    previous = 0 are skipped.  ``relative_change`` is rounded to 3 dp after the test.
    ``tolerance``: one for all columns, a map (a column it lacks takes the
    dataset's own), or a table per series (``volatility_tolerances``; series it
    lacks take the dataset's own)."""
    per_series = tolerance if isinstance(tolerance, DataFrame) else None
    if per_series is not None:
        tols = {c: F.coalesce(F.col(f"__tol_{c}"), F.lit(ds.tolerance)) for c in ds.check_cols}
    else:
        tols = {c: F.lit(float(tolerance.get(c, ds.tolerance) if isinstance(tolerance, Mapping) else ds.tolerance if tolerance is None else tolerance))
                for c in ds.check_cols}
    key = list(ds.key)
    if previous is None:
        return new.withColumn("_anomalies", F.array().cast(f"array<{ANOMALY}>")) \
                  .withColumn("_matched", F.lit(False))
    prev = previous.select(*key, *[F.col(c).alias(f"__prev_{c}") for c in ds.check_cols])
    # previous must be key-unique, or a duplicated key would be compared (and counted) twice
    prev = latest_per_key(prev, key, [f"__prev_{c}" for c in ds.check_cols])
    j = new.join(prev.withColumn("__hit", F.lit(True)), key, "left")
    if per_series is not None:
        j = j.join(per_series.select(ds.entity, *[F.col(f"tol_{c}").alias(f"__tol_{c}") for c in ds.check_cols]), ds.entity, "left")
    entries = []
    for c in ds.check_cols:
        rel, tol = relative_change(F.col(c), F.col(f"__prev_{c}")), tols[c]
        entries.append(F.when(rel > tol, F.struct(
            F.lit(c).alias("column"), F.col(f"__prev_{c}").cast("double").alias("previous_value"),
            F.col(c).cast("double").alias("new_value"), F.round(rel, 3).alias("relative_change"),
            tol.alias("tolerance"))))
    arr = F.filter(F.array(*entries), lambda x: x.isNotNull())
    return (j.withColumn("_anomalies", arr).withColumn("_matched", F.coalesce(F.col("__hit"), F.lit(False)))
             .drop("__hit", *[f"{p}_{c}" for p in ("__prev", "__tol") for c in ds.check_cols]))


def anomalies(compared: DataFrame, ds: Dataset) -> DataFrame:
    """One row per (row, column) anomaly: key, column, previous, new, change, tolerance."""
    return compared.select(*ds.key, F.explode("_anomalies").alias("a")).select(*ds.key, "a.*")


def safe_rows(compared: DataFrame) -> DataFrame:
    return compared.where(F.size("_anomalies") == 0).drop("_anomalies", "_matched")


def flagged_rows(compared: DataFrame) -> DataFrame:
    return compared.where(F.size("_anomalies") > 0).drop("_anomalies", "_matched")


def summary(compared: DataFrame, ds: Dataset, had_previous: bool = True) -> DataFrame:
    """Rows compared, anomaly count (per (row, column)), flagged rows, clean flag."""
    rows = F.count(F.lit(1)) if had_previous else F.lit(0).cast("long")
    g = compared.agg(rows.alias("rows_compared"),
                     F.coalesce(F.sum(F.size("_anomalies")), F.lit(0)).cast("long").alias("anomaly_count"),
                     F.sum((F.size("_anomalies") > 0).cast("long")).alias("flagged_rows"))
    return g.select(F.lit(ds.name).alias("dataset"), "rows_compared", "anomaly_count",
                    F.coalesce("flagged_rows", F.lit(0)).cast("long").alias("flagged_rows"),
                    (F.col("anomaly_count") == 0).alias("clean"))


def promote(compared: DataFrame, previous: DataFrame | None, ds: Dataset, on_flag: str = "keep_previous") -> DataFrame:
    """V4: the table to publish.

    ``keep_previous`` (default): safe new rows, plus the previous row of every
    flagged key, so good data is never replaced by a withheld value and the key
    keeps a baseline for the next run.  ``drop``: safe rows only (the observed
    behaviour of the delete-all + insert load).
    """
    safe = safe_rows(compared)
    if on_flag == "drop" or previous is None:
        return safe
    if on_flag != "keep_previous":
        raise ValueError(on_flag)
    flagged_keys = compared.where(F.size("_anomalies") > 0).select(*ds.key)
    kept = previous.join(flagged_keys, list(ds.key), "left_semi")
    return safe.unionByName(kept.select(*safe.columns))


def merge(new: DataFrame, previous: DataFrame, key: Sequence[str], withheld: DataFrame | None = None, keep_withheld: bool = True,
          keep_absent: bool = False) -> DataFrame:
    """The table to publish from both sides by one full outer merge join on the key.

    Rows of ``withheld`` keys keep their previous row (or go, without
    ``keep_withheld``); keys that only ``previous`` has stay with ``keep_absent``.
    Both sides are key-unique and have the same columns.  Tables bucketed by the
    key meet without an exchange, and the result lies in their buckets: the
    withheld keys join the new side before the two meet, so only they may move.
    """
    key = list(key)
    fresh = new.select(*key, F.struct(*new.columns).alias("__new"))
    if withheld is not None:
        fresh = fresh.join(withheld.select(*key, F.lit(True).alias("__held")), key, "left")
    else:
        fresh = fresh.withColumn("__held", F.lit(None).cast("boolean"))
    both = fresh.join(previous.select(*key, F.struct(*new.columns).alias("__old")), key, "full_outer")
    row = F.when(F.col("__held"), F.col("__old") if keep_withheld else F.lit(None))
    row = row.when(F.col("__new").isNotNull(), F.col("__new"))
    row = row.otherwise(F.col("__old") if keep_absent else F.lit(None))
    return both.select(row.alias("__row")).where("__row IS NOT NULL").select("__row.*")
