"""Every registered query against its DuckDB oracle (the driver's check), at
sf0.001 so the suite stays quick; queries without SQL run and must return rows
with a stable schema."""

from __future__ import annotations

import pytest

from conftest import SF_SMALL
from oracle import compare, duck
from terrapanel.plans.catalog import load_all

QUERIES = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, frame, con, name):
    q = QUERIES[name]
    if q.sql is None:
        df = frame(name)
        assert df.count() >= 0 and df.schema == q.fn(spark, SF_SMALL).schema
        return
    r = compare(spark, con, name, lambda *_: frame(name), q.sql, SF_SMALL)
    assert r["cols_match"], r.get("cols")
    assert r["spark_rows"] == r["duck_rows"]
    assert r["hash_match"], r.get("diff")


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
