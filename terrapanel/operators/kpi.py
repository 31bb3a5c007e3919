"""KPI tables and rollups (J2, A1-A18, U3/U4 helpers).

All aggregates here are algebraic (sum, count, min, max, avg, bool_or), so Spark
runs a map-side partial aggregate before the shuffle: the exchange carries one
partial row per group per task, whatever the skew of the groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from terrapanel.operators.rank import group_percent_rank, group_quantiles
from terrapanel.operators.window import latest_rows


def _cols(c: str | Sequence[str]) -> list[str]:
    return [c] if isinstance(c, str) else list(c)


# -- J2: star rollup -------------------------------------------------------------------------
def country_summary(panel: DataFrame, sites: DataFrame, firms: DataFrame, latest: str = "global",
                    digits: int = 6) -> DataFrame:
    """Latest panel row per entity ⋈ mean site score ⋈ mean firm readiness.

    Sides are aggregated before the join (one row per entity each), so the joins
    never fan out; an entity missing from any input drops out (inner joins).
    """
    latest_panel = latest_rows(panel, "period", "entity", mode=latest)
    risk = sites.groupBy("entity").agg(F.avg("composite_score").alias("avg_risk"))
    ready = firms.groupBy("entity").agg(F.avg("readiness_score").alias("avg_readiness"))
    return (latest_panel.join(risk, "entity").join(ready, "entity")
            .select("entity", "period", "level_mt", "share_a_pct",
                    F.round("avg_risk", digits).alias("avg_risk"),
                    F.round("avg_readiness", digits).alias("avg_readiness")))


# -- A2 / A3: grouped means and sums --------------------------------------------------------------
def mean_by(df: DataFrame, by: str | Sequence[str], measures: Sequence[str], digits: int | None = None) -> DataFrame:
    aggs = [F.avg(m) for m in measures]
    if digits is not None:
        aggs = [F.round(a, digits) for a in aggs]
    return df.groupBy(*_cols(by)).agg(*[a.alias(f"avg_{m}") for a, m in zip(aggs, measures)])


def sum_by(df: DataFrame, by: str | Sequence[str], measures: Sequence[str], strict: bool = False) -> DataFrame:
    """Grouped sums.  ``strict=True`` is R's ``sum`` without ``na.rm``: null when
    any input is null (Spark and SQL skip nulls)."""
    def one(m):
        s = F.sum(F.col(m).cast("decimal(38,6)")).cast("double")
        return F.when(F.count(m) == F.count(F.lit(1)), s) if strict else s
    return df.groupBy(*_cols(by)).agg(*[one(m).alias(f"sum_{m}") for m in measures])


# -- A4: waterfall (per-measure totals, running base, grand total) -----------------------------------
def waterfall(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """One row per measure (step 1..k) with its total and running base, plus a
    ``total`` row (step k+1).  The k totals come from one global aggregate (map-side
    partial sums, one row per task exchanged); the running bases are sums of the
    earlier totals within that one row, so no window runs at all."""
    dec = "decimal(38,6)"
    totals = df.agg(*[F.sum(F.col(m).cast(dec)).alias(m) for m in measures])
    zero = F.lit(0).cast(dec)
    steps = [F.struct(F.lit(i + 1).alias("step"), F.lit(m).alias("measure"), F.col(m).alias("amount"),
                      sum((F.col(x) for x in measures[:i]), zero).alias("base"))
             for i, m in enumerate(measures)]
    grand = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    steps.append(F.struct(F.lit(len(measures) + 1).alias("step"), F.lit("total").alias("measure"),
                          grand.alias("amount"), zero.alias("base")))
    out = totals.select(F.inline(F.array(*steps)))
    return out.select("step", "measure", F.col("amount").cast("double").alias("amount"),
                      F.col("base").cast("double").alias("base"))


# -- A5: two-level hierarchy -------------------------------------------------------------------------
def hierarchy(df: DataFrame, parent: str, measures: Sequence[str], leaf_name: str = "scope") -> DataFrame:
    """Parent totals and (parent, leaf) totals in one pass: unpivot the measures
    and aggregate with grouping sets; ``level`` is 0 for leaves, 1 for parents."""
    long = df.unpivot([parent], list(measures), leaf_name, "amount")
    g = (long.groupingSets([[parent], [parent, leaf_name]], parent, leaf_name)
             .agg(F.sum(F.col("amount").cast("decimal(38,6)")).cast("double").alias("amount"),
                  F.grouping_id().alias("gid")))
    return g.select(parent, leaf_name, "amount", F.col("gid").cast("int").alias("level"))


# -- A6: scorecard -----------------------------------------------------------------------------------
def scorecard(df: DataFrame, entity: str, period: str, measures: Sequence[str]) -> DataFrame:
    """Rows, completeness % over ``measures`` (1 dp) and latest period per entity."""
    filled = sum((F.col(m).isNotNull().cast("int") for m in measures[1:]),
                 F.col(measures[0]).isNotNull().cast("int"))
    return df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.lit(100.0) * F.sum(filled) / (F.count(F.lit(1)) * F.lit(len(measures))), 1).alias("completeness_pct"),
        F.max(period).alias("latest_period"))


# -- A7: null profile in one pass ------------------------------------------------------------------
def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    cols = list(columns or df.columns)
    agg =df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    long = agg.unpivot(["__n"], cols, "column", "nulls")
    return long.select("column", F.col("nulls").cast("long").alias("nulls"),
                       F.round(F.try_divide(F.col("nulls").cast("double"), F.col("__n")), 6).alias("null_rate"))


# -- A9: KPI means, 1 dp ---------------------------------------------------------------------------
def kpi_means(df: DataFrame, measures: Sequence[str], by: str | Sequence[str] | None = None, digits: int = 1) -> DataFrame:
    aggs = [F.round(F.avg(m), digits).alias(f"mean_{m}") for m in measures]
    return df.groupBy(*_cols(by)).agg(*aggs) if by else df.agg(*aggs)


# -- A12: average total per entity ------------------------------------------------------------------
def avg_total_per_entity(df: DataFrame, entity: str, measures: Sequence[str], digits: int = 6) -> DataFrame:
    tot = sum((F.coalesce(F.col(m).cast("decimal(38,6)"), F.lit(0)) for m in measures[1:]),
              F.coalesce(F.col(measures[0]).cast("decimal(38,6)"), F.lit(0)))
    return df.groupBy(entity).agg(
        F.round(F.sum(tot).cast("double") / F.greatest(F.count(F.lit(1)), F.lit(1)), digits).alias("avg_total"))


# -- A13: five-number summary and outliers --------------------------------------------------------------
def box_summary(df: DataFrame, by: str, value: str, digits: int = 6) -> DataFrame:
    """min, q1, median, q3, max, IQR fences and outlier count per group, with
    exact type-7 quantiles computed without collecting any group."""
    # min and max are the type-7 quantiles at 0 and 1 (positions 1 and n): one pass
    q = group_quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0]).select(
        by, F.col("q_0").alias("min"), F.col("q_1").alias("q1"), F.col("q_2").alias("median"),
        F.col("q_3").alias("q3"), F.col("q_4").alias("max"))
    s = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    s = (s.withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
          .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    flagged = (df.join(s.select(by, "lower_fence", "upper_fence"), by)
                 .groupBy(by).agg(F.sum(((F.col(value) < F.col("lower_fence")) |
                                         (F.col(value) > F.col("upper_fence"))).cast("long")).alias("outliers")))
    out = s.join(flagged, by)
    return out.select(by, *[F.round(c, digits).alias(c) for c in
                            ("min", "q1", "median", "q3", "max", "lower_fence", "upper_fence")], "outliers")


# -- A17: report extract -----------------------------------------------------------------------------
def report_extract(panel: DataFrame, entity: str, period: str, measures: Sequence[str], digits: int = 6) -> DataFrame:
    """Latest period, the value at the latest period (``max_by``, not file order)
    and the mean of each measure, per entity."""
    aggs = [F.max(period).alias("latest_period")]
    for m in measures:
        aggs.append(F.max_by(m, period).alias(f"latest_{m}"))
        aggs.append(F.round(F.avg(m), digits).alias(f"mean_{m}"))
    return panel.groupBy(entity).agg(*aggs)


def report_summary(panel: DataFrame, sites: DataFrame, firms: DataFrame, entity: str, period: str, latest: Sequence[str], risk: str,
                   readiness: str, digits: int = 1) -> DataFrame:
    """The figures at the head of an entity's report: latest period and values, mean risk of its sites, mean readiness
    of its firms, as the report rounds them.  Sites and firms are aggregated before they meet the panel."""
    head = panel.groupBy(entity).agg(F.max(period).alias("latest_period"), *[F.round(F.max_by(m, period), digits).alias(f"latest_{m}") for m in latest])
    mean = lambda df, c: df.groupBy(entity).agg(F.round(F.avg(c), digits).alias(f"mean_{c}"), F.count(F.lit(1)).alias(f"n_{c}"))
    return head.join(mean(sites, risk), entity, "left").join(mean(firms, readiness), entity, "left")


def report_details(df: DataFrame, entity: str, columns: Sequence[str], values: Sequence[str] | str | None = None) -> DataFrame:
    """A detail table of the report (its columns, for one entity, several, or all), in key order of the reader's choice."""
    if values is not None:
        df = df.where(F.col(entity).isin(*([values] if isinstance(values, str) else list(values))))
    return df.select(entity, *columns)


# -- A18: sector benchmark ---------------------------------------------------------------------------
def sector_benchmark(firms: DataFrame, sector: str, value: str, key: str, digits: int = 6) -> DataFrame:
    """Each firm's percent rank of ``value`` in its sector, and the sector mean."""
    pr = group_percent_rank(firms.select(key, sector, value), sector, value)
    means = firms.groupBy(sector).agg(F.avg(value).alias("sector_mean"))
    return (pr.join(means, sector)
              .select(key, sector, value, F.round("percent_rank", digits).alias("percent_rank"),
                      F.round("sector_mean", digits).alias("sector_mean"), F.col("grp_n").alias("sector_n")))


# -- A14: pass rate and gate ---------------------------------------------------------------------------
def pass_rate(valid: F.Column) -> F.Column:
    return F.coalesce(F.avg(valid.cast("double")), F.lit(0.0))
