"""Raw ("landed") versions of the driver views, with deterministic defects.

The base tables are clean, so the cleaning and gating operators get inputs
derived from them by fixed rules (identical in Spark and in the oracle SQL):
padded / lower-cased / tab-prefixed codes, junk in a numeric text column,
shares outside 0..100, missing shares, and a stale earlier batch for a third of
the keys.  No row is dropped by the derivation; every base row appears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _k(entity: str = "entity", period: str = "period"):
    return F.col(period) * 7 + F.length(entity)


def raw_panel(panel: DataFrame) -> DataFrame:
    k = _k()
    ent = (F.when(k % 3 == 0, F.concat(F.lit("  "), F.lower("entity")))
            .when(k % 7 == 0, F.concat(F.lit("\t"), F.col("entity")))
            .otherwise(F.col("entity")))
    cur = panel.select(
        ent.alias("entity"), "period",
        F.when(k % 17 == 0, F.lit("n/a")).otherwise(F.col("level_mt").cast("string")).alias("level_txt"),
        F.when(k % 11 == 0, F.lit(None).cast("double"))
         .when(k % 13 == 0, F.col("share_a_pct") * 2.5).otherwise(F.col("share_a_pct")).alias("share_a_pct"),
        F.when(k % 5 == 0, -F.col("share_b_pct")).otherwise(F.col("share_b_pct")).alias("share_b_pct"),
        "share_c_pct", "volume",
        F.lit(2).alias("_batch"), k.cast("bigint").alias("_row_seq"))
    stale = panel.where(k % 3 == 0).select(
        "entity", "period", (F.col("level_mt") * 1.1).cast("string").alias("level_txt"),
        "share_a_pct", "share_b_pct", "share_c_pct", "volume",
        F.lit(1).alias("_batch"), k.cast("bigint").alias("_row_seq"))
    return cur.unionByName(stale)


RAW_PANEL_SQL = r"""
raw_panel AS (
  SELECT CASE WHEN (period*7+length(entity)) % 3 = 0 THEN concat('  ', lower(entity))
              WHEN (period*7+length(entity)) % 7 = 0 THEN concat(chr(9), entity) ELSE entity END AS entity,
         period,
         CASE WHEN (period*7+length(entity)) % 17 = 0 THEN 'n/a' ELSE CAST(level_mt AS VARCHAR) END AS level_txt,
         CASE WHEN (period*7+length(entity)) % 11 = 0 THEN NULL
              WHEN (period*7+length(entity)) % 13 = 0 THEN share_a_pct * 2.5 ELSE share_a_pct END AS share_a_pct,
         CASE WHEN (period*7+length(entity)) % 5 = 0 THEN -share_b_pct ELSE share_b_pct END AS share_b_pct,
         share_c_pct, volume, 2 AS _batch, CAST(period*7+length(entity) AS BIGINT) AS _row_seq
  FROM panel
  UNION ALL
  SELECT entity, period, CAST(level_mt * 1.1 AS VARCHAR), share_a_pct, share_b_pct, share_c_pct, volume,
         1, CAST(period*7+length(entity) AS BIGINT)
  FROM panel WHERE (period*7+length(entity)) % 3 = 0
)"""


def raw_sites(sites: DataFrame) -> DataFrame:
    """Sites with padded site names and scores pushed outside 0..10 for some rows."""
    k = F.length("site") + F.length("entity")
    return sites.select(
        F.when(k % 4 == 0, F.lower("entity")).otherwise(F.col("entity")).alias("entity"),
        F.when(k % 3 == 0, F.concat(F.lit(" "), F.col("site"), F.lit(" "))).otherwise(F.col("site")).alias("site"),
        F.when(k % 5 == 0, F.col("physical_score") + 5).otherwise(F.col("physical_score")).alias("physical_score"),
        F.when(k % 7 == 0, -F.col("transition_score")).otherwise(F.col("transition_score")).alias("transition_score"),
        "flood_score", "heat_score", "composite_score")


RAW_SITES_SQL = r"""
raw_sites AS (
  SELECT CASE WHEN (length(site)+length(entity)) % 4 = 0 THEN lower(entity) ELSE entity END AS entity,
         CASE WHEN (length(site)+length(entity)) % 3 = 0 THEN concat(' ', site, ' ') ELSE site END AS site,
         CASE WHEN (length(site)+length(entity)) % 5 = 0 THEN physical_score + 5 ELSE physical_score END AS physical_score,
         CASE WHEN (length(site)+length(entity)) % 7 = 0 THEN -transition_score ELSE transition_score END AS transition_score,
         flood_score, heat_score, composite_score
  FROM sites
)"""


def previous_panel(panel: DataFrame) -> DataFrame:
    """A previous snapshot of every key: level scaled by 1 + ((period*7+len)%5)/10
    (0..40% moves), share scaled by 0.7 for every 4th key, level missing for every
    9th key (no previous value → skipped) and zero for every 23rd (relative
    change undefined → skipped)."""
    k = _k()
    factor = F.lit(1.0) + (k % 5).cast("double") / F.lit(10.0)
    return panel.select(
        "entity", "period",
        F.when(k % 9 == 0, F.lit(None).cast("double")).when(k % 23 == 0, F.lit(0.0))
         .otherwise(F.col("level_mt") * factor).alias("level_mt"),
        F.when(k % 4 == 0, F.col("share_a_pct") * 0.7).otherwise(F.col("share_a_pct")).alias("share_a_pct"),
        "share_b_pct", "share_c_pct", "volume")


PREVIOUS_PANEL_SQL = r"""
previous_panel AS (
  SELECT entity, period,
         CASE WHEN (period*7+length(entity)) % 9 = 0 THEN NULL
              WHEN (period*7+length(entity)) % 23 = 0 THEN 0.0
              ELSE level_mt * (1.0 + CAST((period*7+length(entity)) % 5 AS DOUBLE) / 10.0) END AS level_mt,
         CASE WHEN (period*7+length(entity)) % 4 = 0 THEN share_a_pct * 0.7 ELSE share_a_pct END AS share_a_pct,
         share_b_pct, share_c_pct, volume
  FROM panel
)"""
