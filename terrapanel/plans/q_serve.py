"""Registered queries: serving filters, lookups, pages, records, source conforming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrapanel.operators import quality as Q
from terrapanel.operators import serve as S
from terrapanel.plans.catalog import Ctx, query
from terrapanel.session import checkpoint_dir
from terrapanel.sources.pages import Pages
from terrapanel.plans.landing import RAW_PANEL_SQL, raw_panel

# Fixed parameters of the registered serving queries (what a caller would pass).
PANEL_ENTITY, YEAR_FROM, YEAR_TO = " nation_7 ", 1996, 0          # 0 = no upper bound
FIRM_ENTITY, FIRM_SECTOR = "nation_3", "BUILDING"
FIRM_ID = 42
MULTI_ENTITIES, MULTI_LO, MULTI_HI = ["NATION_1", "NATION_2", "NATION_3"], 1997, 1999
# extract narrowing and code dictionary (codes outside it are dropped)
CODE_MAP = {"NATION_6": "FR", "NATION_7": "DE", "NATION_19": "RO", "NATION_22": "RU", "NATION_23": "GB"}
KEEP_CODES = ["NATION_6", "NATION_7", "NATION_19", "NATION_22", "NATION_23", "NATION_0"]


@query("serve_panel", ("P11", "O1", "P4"), """
SELECT * FROM panel WHERE entity = 'NATION_7' AND period >= 1996
""")
def serve_panel(spark, d):
    return S.panel(Ctx(spark, d).panel_years(YEAR_FROM, YEAR_TO), PANEL_ENTITY, YEAR_FROM, YEAR_TO)


@query("serve_firms", ("P11", "O1"), """
SELECT * FROM firms WHERE entity = 'NATION_3' AND sector = 'BUILDING'
""")
def serve_firms(spark, d):
    return S.firms(Ctx(spark, d).firms, FIRM_ENTITY, FIRM_SECTOR)


@query("serve_firm", ("P12", "O2"), "SELECT * FROM firms WHERE firm_id = 42")
def serve_firm(spark, d):
    return S.lookup_one(Ctx(spark, d).firms, "firm_id", FIRM_ID)


@query("multi_select", ("P13",), """
SELECT entity, period, level_mt FROM panel WHERE entity IN ('NATION_1', 'NATION_2', 'NATION_3') AND period BETWEEN 1997 AND 1999
""")
def multi_select(spark, d):
    p = Ctx(spark, d).panel_years(MULTI_LO, MULTI_HI).select("entity", "period", "level_mt")
    return S.multi_select(p, "entity", MULTI_ENTITIES, "period", MULTI_LO, MULTI_HI)


@query("multi_select_all", ("P13",), """
SELECT entity, period, level_mt FROM panel WHERE period BETWEEN 1997 AND 1999
""")
def multi_select_all(spark, d):
    p = Ctx(spark, d).panel_years(MULTI_LO, MULTI_HI).select("entity", "period", "level_mt")
    return S.multi_select(p, "entity", "ALL", "period", MULTI_LO, MULTI_HI)


@query("metric_picker", ("P14", "U3", "P23"), """
SELECT entity, period, 'share_a_pct' AS metric, share_a_pct AS value FROM panel
""")
def metric_picker(spark, d):
    p = Ctx(spark, d).panel
    return S.pick_metric(p, ["entity", "period"], ["level_mt", "share_a_pct", "share_b_pct"], "share_a_pct")


@query("paged_view", ("O4",), """
SELECT firm_id, sector, readiness_score FROM firms WHERE sector = 'MACHINERY'
ORDER BY readiness_score DESC, firm_id LIMIT 10 OFFSET 20
""")
def paged_view(spark, d):
    f = Ctx(spark, d).firms.where(F.col("sector") == "MACHINERY").select("firm_id", "sector", "readiness_score")
    return S.page(f, [F.col("readiness_score").desc(), F.col("firm_id")], page_no=3, size=10)


@query("json_records", ("S16",), """
SELECT firm_id, to_json({'firm_id': firm_id, 'firm_name': firm_name, 'entity': entity, 'sector': sector,
                         'gaps_count': gaps_count}) AS record FROM firms
""")
def json_records(spark, d):
    f = Ctx(spark, d).firms.select("firm_id", "firm_name", "entity", "sector", "gaps_count")
    return S.to_records(f, ["firm_id"])


@query("conformed_sources", ("S2", "S3", "P15", "J1", "P3"), """
WITH a AS (SELECT entity AS iso_code, period AS year, level_mt AS co2, level_mt / 10 AS co2_per_capita FROM panel),
b AS (SELECT entity AS iso_code, period AS year, share_a_pct AS renewables_share_energy,
             share_b_pct AS fossil_share_energy, CAST(volume AS DOUBLE) AS electricity_generation FROM panel),
j AS (SELECT a.iso_code, a.year, co2, co2_per_capita, renewables_share_energy, fossil_share_energy, electricity_generation
      FROM a JOIN b ON a.iso_code = b.iso_code AND a.year = b.year
      WHERE a.iso_code IN ('NATION_6', 'NATION_7', 'NATION_19', 'NATION_22', 'NATION_23', 'NATION_0')),
m(iso_code, country_code) AS (VALUES ('NATION_6', 'FR'), ('NATION_7', 'DE'), ('NATION_19', 'RO'), ('NATION_22', 'RU'),
                                     ('NATION_23', 'GB'))
SELECT m.country_code, CAST(year AS INT) AS year, co2 AS co2_emissions_mt, co2_per_capita AS co2_per_capita_t,
       renewables_share_energy AS renewable_share_pct, fossil_share_energy AS fossil_share_pct,
       CAST(NULL AS DOUBLE) AS nuclear_share_pct, electricity_generation AS electricity_generation_twh,
       CAST(NULL AS DOUBLE) AS electricity_price_eur_mwh, 'official' AS data_quality
FROM j JOIN m ON m.iso_code = j.iso_code
""")
def conformed_sources(spark, d):
    p = Ctx(spark, d, shared=("panel",)).panel
    a = p.select(F.col("entity").alias("iso_code"), F.col("period").alias("year"), F.col("level_mt").alias("co2"),
                 (F.col("level_mt") / 10).alias("co2_per_capita"))
    b = p.select(F.col("entity").alias("iso_code"), F.col("period").alias("year"),
                 F.col("share_a_pct").alias("renewables_share_energy"), F.col("share_b_pct").alias("fossil_share_energy"),
                 F.col("volume").cast("double").alias("electricity_generation"))
    target = [("country_code", "string"), ("year", "int"), ("co2_emissions_mt", "double"),
              ("co2_per_capita_t", "double"), ("renewable_share_pct", "double"), ("fossil_share_pct", "double"),
              ("nuclear_share_pct", "double"), ("electricity_generation_twh", "double"),
              ("electricity_price_eur_mwh", "double")]
    return S.conform_sources(
        a, b, CODE_MAP, KEEP_CODES,
        rename_a={"co2": "co2_emissions_mt", "co2_per_capita": "co2_per_capita_t"},
        rename_b={"renewables_share_energy": "renewable_share_pct", "fossil_share_energy": "fossil_share_pct",
                  "nuclear_share_energy": "nuclear_share_pct", "electricity_generation": "electricity_generation_twh"},
        target=target)


PANEL_SCHEMA = {"entity": "string", "period": "int", "level_mt": "double", "share_a_pct": "double",
                "data_quality": "string"}


@query("schema_conform", ("P20", "P5", "D4", "D5"), f"""
WITH {RAW_PANEL_SQL.strip()}
SELECT TRY_CAST(entity AS VARCHAR) AS entity, TRY_CAST(period AS INT) AS period, CAST(NULL AS DOUBLE) AS level_mt,
       TRY_CAST(share_a_pct AS DOUBLE) AS share_a_pct, CAST(NULL AS VARCHAR) AS data_quality
FROM raw_panel
""")
def schema_conform(spark, d):
    raw = raw_panel(Ctx(spark, d, shared=("panel",)).panel)
    return Q.conform(raw, PANEL_SCHEMA)


def _order_pages(spark, d) -> Pages:
    o = Ctx(spark, d).t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    path = f"{checkpoint_dir(spark).rstrip('/')}/pages/{uuid.uuid4().hex}"
    return Pages(spark, path, [("o_totalprice", False), ("o_orderkey", True)]).write(o)


@query("deep_page", ("O4", "O1"), """
WITH r AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey, o_totalprice FROM r WHERE pos // 25 = n // 50
""", views=False)
def deep_page(spark, d):
    """The page of 25 in the middle of all orders by price, read from the slice that holds it."""
    p = _order_pages(spark, d)
    return p.page(p.rows // 50 + 1, 25)


@query("page_after_key", ("O4", "P12"), """
WITH m AS (SELECT arg_max(o_orderkey, o_orderkey) AS k FROM orders), a AS (SELECT o_totalprice AS price, o_orderkey AS k FROM orders, m WHERE o_orderkey = m.k)
SELECT o_orderkey, o_custkey, o_totalprice FROM orders, a WHERE o_totalprice < price OR o_totalprice = price AND o_orderkey > a.k
ORDER BY o_totalprice DESC, o_orderkey LIMIT 25
""", views=False)
def page_after_key(spark, d):
    """The 25 orders that follow the newest order in the list by price."""
    last = Ctx(spark, d).t.orders.agg(F.max_by(F.struct("o_totalprice", "o_orderkey"), "o_orderkey").alias("k")).first()["k"]
    return _order_pages(spark, d).page_after(last.asDict(), 25)
