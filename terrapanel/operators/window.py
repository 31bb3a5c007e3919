"""Per-entity time-axis operators over a yearly panel.

The panel is already aggregated to (entity, period), so a window partitioned by
entity holds one row per period: bounded by the length of the time axis no
matter how much raw data fed it.  Operators over raw rows (the dedupe in W1)
use aggregates with map-side partials instead of windows, so a hot key never
lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _cols(c: str | Sequence[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


# -- W1 / A16: latest row per key -------------------------------------------------------------
def latest_per_key(df: DataFrame, key: str | Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """Keep, per key, the row with the greatest ``order_by`` tuple (ties broken by
    the later columns of ``order_by``; pass a row sequence last for a total order).

    Expressed as ``max(struct(order..., row))`` per key: an aggregate with
    map-side partials, so each task ships at most one candidate per key and a key
    holding a third of all rows costs no more than any other.
    """
    key, order_by = _cols(key), _cols(order_by)
    payload = [c for c in df.columns if c not in key]
    best = F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)],
                          F.struct(*payload).alias("__row"))).alias("__best")
    return df.groupBy(*key).agg(best).select(*key, "__best.__row.*").select(*df.columns)


# -- W5: rows of the latest period -------------------------------------------------------------
def latest_rows(df: DataFrame, period: str, entity: str | None = None, mode: str = "global") -> DataFrame:
    """``mode="global"``: rows whose period equals the max period of the whole
    table (a one-row aggregate joined back; no driver round trip).
    ``mode="per_entity"``: each entity's own latest period."""
    if mode == "global":
        latest = df.agg(F.max(period).alias("__latest"))
        return df.join(latest, F.col(period) == F.col("__latest")).drop("__latest")
    if mode == "per_entity":
        if entity is None:
            raise ValueError("per_entity needs the entity column")
        latest = df.groupBy(F.col(entity).alias("__e")).agg(F.max(period).alias("__latest"))
        return (df.join(latest, (F.col(entity) == F.col("__e")) & (F.col(period) == F.col("__latest")))
                  .drop("__e", "__latest"))
    raise ValueError(f"unknown mode {mode!r}")


# -- W2 / W3: change to the previous period -----------------------------------------------------
def period_change(df: DataFrame, entity: str, period: str, value: str, padded: bool = False,
                  prefix: str | None = None) -> DataFrame:
    """Adds ``<prefix>_diff`` (x - previous x) and ``<prefix>_pct`` ((x - prev)/prev*100).

    The previous value is the value of the previous row in period order (R form).
    ``padded=True`` carries the last non-null value forward first, which is what
    the older pandas ``pct_change`` default does.  Division by zero gives null.
    """
    p = prefix or value
    w = Window.partitionBy(entity).orderBy(period)
    cur = F.col(value)
    if padded:
        cur = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        prev = F.lag(cur).over(w)
    else:
        prev = F.lag(value).over(w)
    diff = F.col(value) - prev
    return df.withColumn(f"{p}_diff", diff).withColumn(
        f"{p}_pct", F.try_divide(cur - prev, prev) * F.lit(100.0))


# -- W4: extreme absolute change ----------------------------------------------------------------
def extreme_change(df: DataFrame, entity: str, period: str, change: str, mode: str = "per_group") -> DataFrame:
    """Rows whose |change| is the largest.

    ``per_group``: every entity's maximum row(s), first by period within the entity.
    ``first_by_year``: among the per-entity maxima, the one with the earliest period
    (the rule the reference actually applies).  ``global``: the single largest
    |change| overall (earliest period, then entity, on ties).
    """
    absc = F.abs(F.col(change))
    nn = df.where(F.col(change).isNotNull())
    if mode == "per_group":
        w = Window.partitionBy(entity).orderBy(absc.desc(), F.col(period))
        return nn.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
    per = extreme_change(df, entity, period, change, "per_group")
    if mode == "first_by_year":
        return per.orderBy(F.col(period), F.col(entity)).limit(1)
    if mode == "global":
        return per.orderBy(absc.desc(), F.col(period), F.col(entity)).limit(1)
    raise ValueError(mode)


# -- W6: chronological split --------------------------------------------------------------------
def chrono_split(df: DataFrame, by: str | Sequence[str], period: str, test_share: float = 0.2) -> DataFrame:
    """Flags the last ``ceil(test_share * n)`` rows of each series as test."""
    by = _cols(by)
    w = Window.partitionBy(*by).orderBy(period)
    wa = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(wa)
    return (df.withColumn("__rn", F.row_number().over(w)).withColumn("__n", n)
              .withColumn("is_test", F.col("__rn") > F.col("__n") - F.ceil(F.col("__n") * F.lit(test_share)))
              .drop("__rn", "__n"))


# -- W7: ordinal ring layout --------------------------------------------------------------------
def ring_layout(df: DataFrame, entity: str, member: str, radius: float = 1.3) -> DataFrame:
    """k-th of n members of an entity (ordered by name) gets angle 2*pi*(k-1)/n
    on a ring of ``radius`` around the entity centre (offsets dx, dy).  Positions
    come from ``group_positions``, so an entity with a third of all members is
    still spread over many tasks."""
    from terrapanel.operators.rank import group_positions

    p = group_positions(df, entity, member)
    ang = F.lit(2 * 3.141592653589793) * (F.col("pos") - 1) / F.col("grp_n")
    return (p.withColumn("ring_pos", F.col("pos").cast("int")).withColumn("ring_n", F.col("grp_n").cast("int"))
              .withColumn("angle", ang)
              .withColumn("dx", F.lit(radius) * F.cos("angle"))
              .withColumn("dy", F.lit(radius) * F.sin("angle"))
              .drop("pos", "grp_n"))


# -- W8: running stack --------------------------------------------------------------------------
def running_sum(df: DataFrame, value: str, order_by: str | Sequence[str], partition_by: Sequence[str] = (),
                name: str = "running") -> DataFrame:
    """Running sum of ``value`` in ``order_by`` order within each ``partition_by``
    group.  A partition key is required: a window without one runs in a single
    task over all rows."""
    if not partition_by:
        raise ValueError("running_sum needs partition_by; an unpartitioned window is one task")
    w = Window.partitionBy(*partition_by).orderBy(*_cols(order_by))
    return df.withColumn(name, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


# -- W9: stable hash holdout --------------------------------------------------------------------
def hash_split(df: DataFrame, key: str, test_pct: int = 25, seed: int = 42) -> DataFrame:
    """Deterministic random holdout: the first 32 bits of ``md5("<seed>:<key>")``
    modulo 100 below ``test_pct``.  Stable under repartitioning and
    re-execution (a lost executor recomputes the same split), and the same
    function exists in SQL engines, so the split can be checked independently."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10)
    return df.withColumn("is_test", F.pmod(h.cast("bigint"), F.lit(100)) < F.lit(test_pct))


def ordered(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
