"""Positions, ranks and exact quantiles within groups, without one task per group.

``Window.partitionBy(group)`` sends a whole group to one task; with a group that
holds a third of all rows that task sorts a third of the data.  Here the rows
are range-partitioned on (group, order), so a hot group becomes many slices, and
the ranged rows are written once with the number of their slice: every later use
reads the same slices.  A window numbers the rows of a slice, and a table of one
row per (slice, group) holds how many rows of the group stand in earlier slices.

Ranks and quantiles need values only: they range-partition the distinct
(group, value, count), so a value that many rows share is one row there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from terrapanel.sources.tables import materialize


def _cols(c: str | Sequence[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


def _same(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> Column:
    """Equality of ``cols`` with null equal to null; ``right`` has them prefixed by ``__k_``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[f"__k_{c}"])
    return cond


def _join(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on ``cols`` that keeps null groups; ``cols`` once."""
    for c in cols:
        right = right.withColumnRenamed(c, f"__k_{c}")
    return left.join(right, _same(left, right, cols)).drop(*[f"__k_{c}" for c in cols])


def _sliced(df: DataFrame, order: list[str], num_partitions: int | None, label: str) -> DataFrame:
    """``df`` range-partitioned on ``order`` and written, with the slice number in ``__slice``."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(n, *order).withColumn("__slice", F.spark_partition_id()), label)


def _before(slices: DataFrame, by: list[str], rows: Column) -> DataFrame:
    """Per (slice, group): rows of the group in earlier slices and in all; at most one row per slice and group."""
    per = slices.groupBy("__slice", *by).agg(rows.alias("__c"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    per = (per.withColumn("__off", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
              .withColumn("grp_n", F.sum("__c").over(group)).drop("__c"))
    return materialize(per, "rank_offsets")


def group_positions(df: DataFrame, by: str | Sequence[str], order: str | Sequence[str],
                    num_partitions: int | None = None) -> DataFrame:
    """Adds ``pos`` (1-based position in ``order`` within the group) and ``grp_n``."""
    by, order = _cols(by), _cols(order)
    # Tie-break: a hash of the whole row.  Range bounds on (group, order) alone
    # cannot split a hot group whose order values are all equal; with the hash
    # such a run still spreads over many slices.  Equal (group, order) rows
    # are interchangeable for every caller (quantiles, ranks, ordinal layout).
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, MapType)]
    tie = F.xxhash64(*[F.col(c) for c in hashable]) if hashable else F.lit(0)
    s = _sliced(df.withColumn("__tie", tie), [*by, *order, "__tie"], num_partitions, "ranged")
    within = Window.partitionBy("__slice", *by).orderBy(*order, "__tie")
    numbered = s.withColumn("__rn", F.row_number().over(within))
    out = _join(numbered, _before(s, by, F.count(F.lit(1))), ["__slice", *by])
    return out.withColumn("pos", (F.col("__off") + F.col("__rn")).cast("long")).drop("__slice", "__rn", "__off", "__tie")


def value_ranks(df: DataFrame, by: str | Sequence[str], value: str, num_partitions: int | None = None) -> DataFrame:
    """One row per distinct (group, value): ``n`` rows, ``before`` rows with a smaller value, ``grp_n`` in the group."""
    by = _cols(by)
    d = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    s = _sliced(d, [*by, value], num_partitions, "ranged_values")
    within = Window.partitionBy("__slice", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    numbered = s.withColumn("__b", F.coalesce(F.sum("n").over(within), F.lit(0)))
    out = _join(numbered, _before(s, by, F.sum("n")), ["__slice", *by])
    return out.withColumn("before", F.col("__off") + F.col("__b")).drop("__slice", "__b", "__off")


def group_percent_rank(df: DataFrame, by: str | Sequence[str], value: str, num_partitions: int | None = None) -> DataFrame:
    """SQL ``percent_rank()`` over (partition by ``by`` order by ``value``):
    (rank - 1) / (n - 1), 0 for single-row groups; equal values share the rank."""
    by = _cols(by)
    ranks = materialize(value_ranks(df, by, value, num_partitions).drop("n"), "value_ranks")
    out = _join(df, ranks, [*by, value])
    pr = F.when(F.col("grp_n") <= 1, F.lit(0.0)).otherwise(F.col("before").cast("double") / (F.col("grp_n") - 1))
    return out.withColumn("percent_rank", pr).drop("before")


def group_quantiles(df: DataFrame, by: str | Sequence[str], value: str,
                    probs: Sequence[float], num_partitions: int | None = None) -> DataFrame:
    """Exact continuous quantiles (linear interpolation, type 7) per group.

    Returns one row per group with columns ``q_<i>`` in ``probs`` order.  Only the
    one or two distinct values that hold a quantile's positions survive the
    filter, so the final aggregate sees at most 2*len(probs) rows per group.
    """
    by = _cols(by)
    p = value_ranks(df.where(F.col(value).isNotNull()), by, value, num_partitions)
    holds = lambda pos: (F.col("before") <= pos) & (pos < F.col("before") + F.col("n"))
    picks = []
    for i, q in enumerate(probs):
        h = F.lit(float(q)) * (F.col("grp_n") - 1)
        picks.append(F.struct(F.lit(i).alias("i"), (h - F.floor(h)).alias("frac"),
                              holds(F.floor(h)).alias("is_lo"), holds(F.ceil(h)).alias("is_hi")))
    tagged = p.withColumn("__pick", F.explode(F.array(*picks))).where("__pick.is_lo OR __pick.is_hi")
    agg = tagged.groupBy(*by, "__pick.i").agg(
        F.max(F.when(F.col("__pick.is_lo"), F.col(value))).alias("__vlo"),
        F.max(F.when(F.col("__pick.is_hi"), F.col(value))).alias("__vhi"),
        F.max("__pick.frac").alias("__frac"))
    agg = agg.withColumn("__q", F.col("__vlo") + F.col("__frac") * (F.col("__vhi") - F.col("__vlo")))
    return agg.groupBy(*by).agg(*[F.max(F.when(F.col("i") == i, F.col("__q"))).alias(f"q_{i}")
                                  for i in range(len(probs))])
