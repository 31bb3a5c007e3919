"""Label lookup with fallback (J9): requested language → English → the key itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# ---------------------------------------------------------------------------
# Display labels (EN, DE) used by the KPI and forecast outputs.
# ---------------------------------------------------------------------------
LABELS = {
    "kpi_co2": ("CO2 Emissions (Mt)", "CO2-Emissionen (Mt)"),
    "kpi_renewable": ("Renewable Share (%)", "Anteil Erneuerbare (%)"),
    "kpi_climate_risk": ("Climate Risk Score", "Klimarisiko-Score"),
    "kpi_esg_readiness": ("ESG Readiness", "ESG-Bereitschaft"),
    "kpi_csrd_readiness": ("CSRD Readiness", "CSRD-Bereitschaft"),
    "kpi_reporting_gaps": ("Reporting Gaps", "Berichtslücken"),
    "sub_co2_predictor": ("CO2 Emissions Predictor", "CO2-Emissionsprognose"),
    "sub_renewable_pred": ("Renewable Energy Predictor", "Prognose erneuerbare Energien"),
    "sub_price_predictor": ("Electricity Price Predictor", "Strompreisprognose"),
}
# which label and which predictor title belong to each panel measure
METRIC_LABEL = {"level_mt": "kpi_co2", "share_a_pct": "kpi_renewable", "share_b_pct": "kpi_price"}
METRIC_TITLE = {"level_mt": "sub_co2_predictor", "share_a_pct": "sub_renewable_pred",
                "share_b_pct": "sub_price_predictor"}


def label_rows() -> list[tuple[str, str, str]]:
    return [(k, lang, txt) for k, (en, de) in LABELS.items() for lang, txt in (("en", en), ("de", de))]


def label_table(spark: SparkSession) -> DataFrame:
    """(key, lang, text): a fixed table of 2 × len(LABELS) rows."""
    return spark.createDataFrame(label_rows(), "key string, lang string, text string")


def lookup(df: DataFrame, key: str, lang: str, out: str = "label") -> DataFrame:
    """Adds ``out`` = label of ``key`` in ``lang``, else English, else the key.
    Two left joins against the fixed label table, broadcast (its size is fixed)."""
    lab = F.broadcast(label_table(df.sparkSession))
    want = lab.select(F.col("key").alias("__k1"), F.col("lang").alias("__l1"), F.col("text").alias("__t1"))
    en = lab.where("lang = 'en'").select(F.col("key").alias("__k2"), F.col("text").alias("__t2"))
    j = (df.join(want, (F.col(key) == F.col("__k1")) & (F.col(lang) == F.col("__l1")), "left")
           .join(en, F.col(key) == F.col("__k2"), "left"))
    return j.withColumn(out, F.coalesce("__t1", "__t2", F.col(key))).drop("__k1", "__l1", "__t1", "__k2", "__t2")


def metric_key_expr(metric: str, mapping: dict[str, str]):
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(metric)], F.col(metric))
