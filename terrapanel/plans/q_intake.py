"""Registered queries: delimited text files read by their own headers, typed, routed, nothing lost."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from terrapanel.operators import quality as Q
from terrapanel.plans.catalog import Ctx, query
from terrapanel.plans.q_quality import RAW_CURRENT_SQL, _raw_current
from terrapanel.registry import NONNEG, PANEL, Bound, Dataset
from terrapanel.session import checkpoint_dir
from terrapanel.sources import rescue

#: Accounts as customers and suppliers send them: some overdrawn, some with a segment where a rate should be.
ACCOUNT = Dataset(name="account", key=("account_id",), entity="nation_key", required=("balance",), optional=("nation_key", "rate", "data_quality"),
                  int_cols=("nation_key",), bounds={"balance": NONNEG, "nation_key": NONNEG, "rate": Bound(0.0, 100.0)},
                  defaults={"data_quality": "sample"}, closed=True)


def _files(spark, d) -> rescue.Intake:
    t = Ctx(spark, d).t
    folder = f"{checkpoint_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"
    text = lambda *cols: [c.cast("string").alias(n) for n, c in cols]
    customer = t.customer.select(*text(("account_id", F.concat(F.lit("C"), F.col("c_custkey"))), ("nation_key", F.col("c_nationkey")),
                                       ("balance", F.col("c_acctbal").cast("decimal(18,2)")), ("segment", F.col("c_mktsegment"))))
    # another header: other order, no nation, the segment in the place of a rate
    wrong = t.customer.where(F.col("c_mktsegment") == "BUILDING").select(*text(
        ("balance", F.col("c_acctbal").cast("decimal(18,2)")), ("rate", F.col("c_mktsegment")), ("account_id", F.concat(F.lit("R"), F.col("c_custkey")))))
    supplier = t.supplier.select(*text(("account_id", F.concat(F.lit("S"), F.col("s_suppkey"))), ("balance", F.col("s_acctbal").cast("decimal(18,2)")),
                                       ("data_quality", F.lit("official")), ("rate", F.lit("12.5"))))
    regions = t.region.select(*text(("r_regionkey", F.col("r_regionkey")), ("r_name", F.col("r_name"))))
    frames = {"account_customer": customer, "account_rates": wrong, "supplier_account": supplier, "regions": regions}
    for name, df in frames.items():
        df.write.option("header", True).csv(f"{folder}/{name}")
    raw = None
    for name in frames:  # the folder of a pull names its file
        part = rescue.read_text(spark, f"{folder}/{name}").withColumn("_source_file", F.lit(f"{name}.csv"))
        raw = part if raw is None else raw.unionByName(part, allowMissingColumns=True)
    return rescue.intake(raw, {"account": ACCOUNT})


FILES_SQL = """
WITH c AS (SELECT 'C' || c_custkey AS account_id, c_nationkey::BIGINT AS nation_key, c_acctbal::DECIMAL(18,2) AS balance, c_mktsegment AS seg FROM customer),
s AS (SELECT 'S' || s_suppkey AS account_id, s_acctbal::DECIMAL(18,2) AS balance FROM supplier),
r AS (SELECT 'R' || c_custkey AS account_id, c_acctbal::DECIMAL(18,2) AS balance, c_mktsegment AS seg FROM customer WHERE c_mktsegment = 'BUILDING')
"""


@query("file_intake_valid", ("S1", "S9", "V1", "V2", "P20"), f"""{FILES_SQL.strip()}
SELECT account_id, balance::DOUBLE AS balance, nation_key, NULL::DOUBLE AS rate, 'sample' AS data_quality, seg AS segment, 'account_customer.csv' AS source_file
FROM c WHERE balance >= 0
UNION ALL
SELECT account_id, balance::DOUBLE, NULL, 12.5, 'official', NULL, 'supplier_account.csv' FROM s WHERE balance >= 0
""", views=False)
def file_intake_valid(spark, d):
    v = _files(spark, d).valid["account"]
    return v.select("account_id", "balance", "nation_key", "rate", "data_quality", F.col("_rescued")["segment"].alias("segment"),
                    F.col("_source_file").alias("source_file"))


@query("file_intake_rejects", ("S9", "V1", "V2", "D17"), f"""{FILES_SQL.strip()}
SELECT 'account_customer.csv' AS source_file, 'balance:below_min' AS reason, account_id, balance::VARCHAR AS balance, NULL AS rate FROM c WHERE balance < 0
UNION ALL SELECT 'supplier_account.csv', 'balance:below_min', account_id, balance::VARCHAR, '12.5' FROM s WHERE balance < 0
UNION ALL SELECT 'account_rates.csv', CASE WHEN balance < 0 THEN 'balance:below_min' ELSE 'rate:not_a_number' END, account_id, balance::VARCHAR, seg FROM r
UNION ALL SELECT 'regions.csv', 'no_route', NULL, NULL, NULL FROM region
""", views=False)
def file_intake_rejects(spark, d):
    r = _files(spark, d).rejects
    return r.select("source_file", "reason", *[F.col("row")[c].alias(c) for c in ("account_id", "balance", "rate")])


@query("headline_null_gate", ("V5", "A7"), f"""
WITH {RAW_CURRENT_SQL}
SELECT 'panel' AS dataset, count(*) AS "rows", round(greatest(avg((entity IS NULL)::INT), avg((period IS NULL)::INT), avg((level_mt IS NULL)::INT)), 6) AS max_key_null_rate,
       count(*) > 0 AND greatest(avg((entity IS NULL)::INT), avg((period IS NULL)::INT), avg((level_mt IS NULL)::INT)) <= 0.05 AS passed
FROM cur
""")
def headline_null_gate(spark, d):
    """The gate over key and headline measure, before cleaning drops anything."""
    return Q.key_null_gate(_raw_current(Ctx(spark, d)), replace(PANEL, max_key_null_rate=0.05))
