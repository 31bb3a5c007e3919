"""Registered queries: landing, lineage, fallback, documents, export, managed tables and the scheduled refresh.

Each writes what the source or sink needs below the shared checkpoint folder (or
the warehouse) and returns what a reader then finds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, functions as F

from terrapanel.plans.catalog import Ctx, query
from terrapanel.registry import PANEL
from terrapanel.session import checkpoint_dir
from terrapanel.sources import files as FS
from terrapanel.sources import publish as P
from terrapanel.streaming import refresh as ST


def _folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/landed/{uuid.uuid4().hex}"


@query("landed_latest_run", ("S5", "S6", "S8"), """
SELECT c_custkey, c_acctbal + 1 AS c_acctbal, '20240102T000000Z' AS run_id, 'live' AS data_mode, true AS has_source FROM customer
""", views=False)
def landed_latest_run(spark, d):
    """Customers landed twice under two stamps: the newer pull is the one that counts, with where it came from."""
    t, root = Ctx(spark, d).t, _folder(spark)
    for stamp, plus in (("20240101T000000Z", 0), ("20240102T000000Z", 1)):
        pulled = FS.with_lineage(t.customer, "live").withColumn("c_acctbal", F.col("c_acctbal") + plus)
        FS.land(pulled, root, "customer", stamp)
    got = FS.read_latest_run(spark, root, "customer")
    return got.select("c_custkey", "c_acctbal", F.col("_run_id").alias("run_id"), F.col("_data_mode").alias("data_mode"),
                      F.col("_source_file").startswith("customer").alias("has_source"))


@query("source_fallback", ("S7",), """
SELECT n_nationkey, n_name, 'sample' AS data_quality FROM nation
""", views=False)
def source_fallback(spark, d):
    """The live source is missing and the official one empty: the sample is read and says so."""
    t, root = Ctx(spark, d).t, _folder(spark)
    cols = ("n_nationkey", "n_name")
    return FS.first_available([("live", lambda: spark.read.parquet(f"{root}/live")), ("official", lambda: t.nation.limit(0).select(*cols)),
                               ("sample", lambda: t.nation.select(*cols))])


@query("json_stat_cells", ("S4",), """
WITH o AS (SELECT n_regionkey AS k, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
SELECT r_name AS region, s.status, coalesce(o.n, 0)::BIGINT AS value
FROM region CROSS JOIN (VALUES ('F'), ('O'), ('P')) s(status) LEFT JOIN o ON o.k = r_regionkey AND o.status = s.status
""", views=False)
def json_stat_cells(spark, d):
    """Orders by region and status, written as one JSON-stat document and flattened again."""
    t, path = Ctx(spark, d).t, f"{_folder(spark)}/doc"
    per = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
           .groupBy(F.col("n_regionkey").alias("k"), F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n")))
    statuses = F.array(F.lit("F"), F.lit("O"), F.lit("P"))
    cells = t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("region"), F.posexplode(statuses).alias("at", "status"))
    cells = cells.join(per, ["k", "status"], "left")
    # the document is one cell for each region and status: a handful, whatever the orders
    ordered = F.sort_array(F.collect_list(F.struct("k", "at", "region", F.coalesce("n", F.lit(0)).alias("n"))))
    doc = cells.agg(ordered.alias("c")).select(F.to_json(F.struct(
        F.lit("2.0").alias("version"), F.lit("dataset").alias("class"), F.array(F.lit("region"), F.lit("status")).alias("id"),
        F.array((F.size("c") / 3).cast("int"), F.lit(3)).alias("size"),
        F.struct(F.struct(F.struct(F.array_distinct(F.col("c.region")).alias("index")).alias("category")).alias("region"),
                 F.struct(F.struct(statuses.alias("index")).alias("category")).alias("status")).alias("dimension"),
        F.col("c.n").alias("value"))).alias("value"))
    doc.coalesce(1).write.text(path)
    return FS.read_json_stat(spark, path).select("region", "status", F.col("value").cast("long").alias("value"))


@query("csv_round_trip", ("S15", "S1", "S16"), """
SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer
""", views=False)
def csv_round_trip(spark, d):
    """Customers exported as CSV and read back under a schema."""
    cols, path = ("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), f"{_folder(spark)}/csv"
    FS.export_csv(Ctx(spark, d).t.customer.select(*cols), path)
    return FS.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").select(*cols)


@query("replaced_table", ("S11", "S12"), """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal > 0 AS in_credit FROM supplier
""", views=False)
def replaced_table(spark, d):
    """A managed table written with one schema and replaced under another."""
    s = Ctx(spark, d).t.supplier
    name = f"landed_{uuid.uuid4().hex}"
    FS.ensure_namespace(spark, name)
    FS.replace_table(s.select("s_suppkey", "s_name"), f"`{name}`.`supplier`")
    FS.replace_table(s.select("s_suppkey", "s_name", "s_nationkey", (F.col("s_acctbal") > 0).alias("in_credit")), f"`{name}`.`supplier`")
    return spark.table(f"`{name}`.`supplier`")


@query("stream_refresh", ("ST1", "ST5", "S13"), """
WITH y AS (SELECT max(period) AS last FROM panel)
SELECT entity, period, level_mt, share_a_pct, share_b_pct, share_c_pct, volume FROM panel, y WHERE period <> last - 1
UNION ALL
SELECT a.entity, a.period, CASE WHEN far THEN a.level_mt ELSE a.level_mt * 1.1 END, a.share_a_pct, a.share_b_pct, a.share_c_pct, a.volume
FROM (SELECT *, entity < 'NATION_2' AND level_mt <> 0 AS far FROM panel, y WHERE period = last - 1) a
""")
def stream_refresh(spark, d):
    """The scheduled job over two landings: the second brings the newest year and restates the year before, by 10% for most
    entities and by 30% for some, which the reconciliation withholds."""
    p, folder = Ctx(spark, d, shared=("panel",)).panel, _folder(spark)
    last = p.agg(F.max("period")).first()[0]
    factor = F.when(F.col("entity") < "NATION_2", 1.3).otherwise(1.1)
    again = p.where(F.col("period") == last - 1).withColumn("level_mt", F.col("level_mt") * factor)
    schema = p.schema
    for n, part in enumerate((p.where(F.col("period") < last), p.where(F.col("period") == last).unionByName(again))):
        part.write.parquet(f"{folder}/in/part={n}")
        stream = ST.landing_stream(spark, f"{folder}/in/*", schema)
        ST.refresh(stream, f"{folder}/out", PANEL, clean=lambda b: b.drop("_ingested_at", "_source_file", "_row_seq"), name=folder.rsplit("/", 1)[-1]).awaitTermination()
    return P.read_current(spark, f"{folder}/out", PANEL).select(*p.columns)
