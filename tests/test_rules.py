"""The rule table: every rule from one scan, right under copies, blanks, hot keys and empty frames."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from conftest import SF_SMALL
from terrapanel.operators import quality as Q
from terrapanel.plans.catalog import load_all
from terrapanel.registry import REGIONAL_RISK, Dataset

DS = Dataset(name="t", key=("id",), entity="code", required=("name",), text_cols=("name",), row_bounds=(1, 10))
DDL = "id long, code string, name string, _source_file string"


def rules(df, ds=DS, **kw):
    return {r.rule: (r.observed, r.passed) for r in Q.rule_table(df, ds, 2003, complete=True, **kw).collect()}


def codes(spark, *c):
    return spark.createDataFrame([(x,) for x in c], "c string")


def test_every_rule_counts_what_it_says(spark):
    f = "owid_20240131T235959Z.csv"
    rows = [(1, "DE", "a", f), (1, "DE", "a", f), (1, "AT", "b", f), (2, "CH", "  ", "owid.csv"), (3, "DE", None, "owid_20190101T000000Z.csv"),
            (None, "XX", "c", "owid_20241399T000000Z.csv"), (4, None, "d", f)]
    got = rules(spark.createDataFrame(rows, DDL), expected=codes(spark, "DE", "FR", "CH"), parent_codes=codes(spark, "DE", "AT", "CH"),
                source_columns=("id", "elevation"), as_of="2024-02-10")
    assert got["row_count_min"] == (7.0, True) and got["row_count_max"] == (7.0, True)
    assert got["duplicate_key_rows"] == (3.0, False) and got["duplicate_rows"] == (2.0, False)
    assert got["nulls_id"] == (1.0, False) and got["nulls_name"] == (1.0, False) and got["blank_name"] == (1.0, False)
    assert got["missing_expected"] == (1.0, False) and got["orphan_codes"] == (2.0, False)  # XX and the null code
    assert got["file_stamp_invalid"] == (3.0, False) and got["file_age_days"][1] is False
    assert got["missing_source_columns"] == (1.0, False) and got["missing_contract_columns"] == (0.0, True)
    assert got["personal_column_names"] == (0.0, True) and got["personal_fields"] == (0.0, True)
    assert got["valid_share"] == (round(5 / 7, 6), False)


def test_column_names_are_rules(spark):
    df = spark.createDataFrame([("DE", "r", "x", "y")], "country_code string, region string, Email string, home_address_2 string")
    got = rules(df, REGIONAL_RISK)
    assert got["personal_column_names"] == (2.0, False) and got["personal_fields"] == (1.0, False) and got["missing_contract_columns"][0] == 7.0


def test_empty_frame(spark):
    got = rules(spark.createDataFrame([], DDL), expected=codes(spark, "DE"), parent_codes=codes(spark, "DE"))
    assert got["row_count_min"] == (0.0, False) and got["valid_share"] == (0.0, False) and got["missing_expected"] == (1.0, False)
    assert got["duplicate_key_rows"] == (0.0, True) and got["orphan_codes"] == (0.0, True)


def test_hot_key_with_many_codes(spark):
    """A third of 90,000 rows have one key and thousands of codes: nothing is collected, copies count over all codes."""
    df = spark.range(90_000).select(F.when(F.col("id") < 30_000, 7).otherwise(F.col("id")).alias("id"),
                                    F.concat(F.lit("c"), F.col("id") % 5000).alias("code"), F.lit("n").alias("name"), F.lit("f").alias("_source_file"))
    got = rules(df, parent_codes=df.select("code").distinct())
    assert got["duplicate_key_rows"] == (30_000.0, False) and got["duplicate_rows"] == (30_000.0, False) and got["orphan_codes"] == (0.0, True)


def test_rules_read_their_frame_once(spark):
    for name, table in (("dq_rules_sites", "supplier"), ("dq_rules_files", "orders"), ("dq_rules_firms", "view_firms"), ("dq_rules_panel", "view_panel")):
        plan = load_all()[name].fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"Location: [^\n]*/{table}[^/\n]*", plan)) == 1, name
