"""The reference's runtime bounds, on more rows than it times.

The reference bounds cleaning 5,000 rows and validating 2,000 rows at 5 s each
(one pandas process).  Here the whole sf0.1 ``firms`` view (15,000 rows from
orders ⋈ customer ⋈ nation) is cleaned (codes, clamps, drop-missing, dedupe by
key) and validated against its row contract.  The view is written once first,
so the bound times the operators, not the orders aggregation; each timing is
the best of two runs through the ``noop`` sink after a warm-up.
"""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from terrapanel.operators import clean as C
from terrapanel.operators import quality as Q
from terrapanel.plans import views as V
from terrapanel.registry import FIRMS
from terrapanel.sources.tables import Tables, materialize

SF_BENCH = "/root/testdata/sf0.1"
BOUND_SECONDS = 5.0


def _best(make, runs: int = 2) -> float:
    make().write.format("noop").mode("overwrite").save()  # warm-up
    best = float("inf")
    for _ in range(runs):
        t0 = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - t0)
    return best


@pytest.fixture(scope="module")
def firms(spark):
    f = materialize(V.firms(Tables(spark, SF_BENCH)), "bound_firms")
    assert f.count() >= 5000
    return f


def test_clean_within_reference_bound(firms):
    raw = firms.select(F.lower("entity").alias("entity"), *[c for c in firms.columns if c != "entity"],
                       F.lit(1).alias("_batch"), F.col("firm_id").alias("_row_seq"))
    assert _best(lambda: C.clean(raw, FIRMS)) < BOUND_SECONDS


def test_validate_within_reference_bound(firms):
    assert _best(lambda: Q.validation_report(Q.validate(firms, FIRMS), FIRMS)) < BOUND_SECONDS
    assert _best(lambda: Q.validate(firms, FIRMS)) < BOUND_SECONDS
