from __future__ import annotations

import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="terrapanel-test-ckpt-")
    s = (SparkSession.builder.master("local[*]").appName("terrapanel-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def frame(spark):
    """Frames of the registered queries over the small tables, each built once a session (building one may run jobs)."""
    from terrapanel.plans.catalog import load_all

    held = {}

    def get(name):
        if name not in held:
            held[name] = load_all()[name].fn(spark, SF_SMALL)
        return held[name]

    return get


@pytest.fixture()
def tmp_dir():
    return tempfile.mkdtemp(prefix="terrapanel-test-")
