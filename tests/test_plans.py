"""Physical-plan checks: pruning and pushdown reach the scans, no plan has a
Cartesian product, no returned plan runs Python (the isolation forest's Python
runs once, while its scores are written), large tables are scanned once."""

from __future__ import annotations

import contextlib
import io

import pytest

from conftest import SF_SMALL
from terrapanel.plans.catalog import load_all

QUERIES = load_all()
# the forest grows and scores in Python while its scores are written (materialize);
# the plans returned by every query, the forest's included, run no Python
PYTHON_OK: set[str] = set()


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON_OK))
def test_no_cartesian_and_no_python(frame, name):
    p = plan(frame(name))
    assert "CartesianProduct" not in p
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert node not in p, f"{name} runs Python: {node}"


def test_filters_reach_the_scan(spark):
    p = plan(QUERIES["serve_panel"].fn(spark, SF_SMALL))
    assert "EqualTo(n_name,NATION_7)" in p


def test_scan_reads_only_needed_columns(spark):
    p = plan(QUERIES["panel_kpi"].fn(spark, SF_SMALL))
    assert "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in p
    assert "o_orderpriority" not in p


def test_dedupe_is_an_aggregate_not_a_window(spark):
    p = plan(QUERIES["panel_clean"].fn(spark, SF_SMALL))
    assert "HashAggregate" in p or "ObjectHashAggregate" in p or "SortAggregate" in p
    assert "Window " not in p.split("\n(")[0]


def test_view_aggregate_has_partial_and_final(spark):
    p = plan(QUERIES["panel_kpi"].fn(spark, SF_SMALL))
    assert "partial_sum" in p and p.count("Exchange") >= 1


def test_shared_view_is_written_once_to_the_checkpoint_folder(spark):
    from terrapanel.plans.catalog import Ctx

    c = Ctx(spark, SF_SMALL, shared=True)
    assert c.panel is c.panel
    p = plan(QUERIES["country_summary"].fn(spark, SF_SMALL))
    # the panel aggregate is read back from the shared folder, orders is not re-scanned
    assert "orders.parquet" not in p
    assert spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/tables/view_panel-" in p


def test_single_use_view_stays_lazy(spark):
    p = plan(QUERIES["sector_benchmark"].fn(spark, SF_SMALL))
    # only customer-side columns are used: the orders aggregate is pruned away
    assert "orders.parquet" not in p and "customer.parquet" in p


def test_no_unpartitioned_running_window(spark):
    from terrapanel.operators.window import running_sum

    df = spark.range(3).withColumnRenamed("id", "v")
    with pytest.raises(ValueError):
        running_sum(df, "v", "v")
    p = plan(QUERIES["scope_waterfall"].fn(spark, SF_SMALL))
    assert "Window" not in p


def test_forest_scores_once(spark):
    # the pandas UDF ran during the write of the scores; the returned frame reads them
    p = plan(QUERIES["isolation_forest"].fn(spark, SF_SMALL))
    assert "/tables/iforest_scores-" in p
    for node in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert node not in p


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_large_tables_scanned_at_most_once(frame, name):
    """orders and lineitem are the tables that grow fastest: no query plan may read
    either twice (views a query reuses are written once, see Ctx.shared)."""
    import re

    df = frame(name)
    scans = re.findall(r"file:[^\]]*/(\w+)\.parquet", df._jdf.queryExecution().executedPlan().toString())
    for table in ("orders", "lineitem"):
        assert scans.count(table) <= 1, f"{name} scans {table} {scans.count(table)} times"
