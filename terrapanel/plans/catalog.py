"""Registered queries: name → (Spark callable, DuckDB oracle SQL or None).

Each callable takes ``(spark, data_dir)`` and returns a DataFrame over the whole
base tables of that folder; building it may run jobs (shared views are written,
models are fitted).  The oracle SQL runs in DuckDB on the same
parquet files (tables pre-registered as views) and must return the same
columns, aliased the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrapanel.plans import views as V
from terrapanel.sources.tables import Tables, materialize


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def query(name: str, operators: tuple[str, ...] | str, sql: str | None = None, views: bool = True):
    """Register a query; ``sql`` is prefixed with the view CTEs unless ``views=False``."""
    ops = (operators,) if isinstance(operators, str) else tuple(operators)
    full = None if sql is None else (V.with_views(sql) if views else sql.strip())

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, full, ops)
        return fn
    return deco


class Ctx:
    """Tables and driver views of one data folder.

    ``panel`` and ``firms`` aggregate ``orders`` (the large table) down to a
    small result; a query touches them several times (self-joins, the sampling
    pass of a range shuffle, model fit then scoring), so each is written once
    per query to the shared checkpoint folder on first use and read back after
    (``materialize``) when the query names it in ``shared``.  A query that
    reads a view once keeps it lazy, so its filters still reach the base scans
    through the view, and columns it does not use are pruned away (a query that
    needs only customer-side columns of ``firms`` never touches ``orders``).  ``sites`` is a narrow projection of ``supplier``: a copy
    would cost as much as the scan, so it always stays lazy.
    """

    def __init__(self, spark: SparkSession, root: str, shared: bool | tuple[str, ...] = False):
        self.spark = spark
        self.t = Tables(spark, root)
        # True: both aggregated views; a tuple: only the named ones
        self.shared = ("panel", "firms") if shared is True else tuple(shared or ())
        self._views: dict[str, DataFrame] = {}

    def _view(self, name: str, build) -> DataFrame:
        if name not in self.shared:
            return build(self.t)
        if name not in self._views:
            self._views[name] = materialize(build(self.t), f"view_{name}")
        return self._views[name]

    @property
    def panel(self) -> DataFrame:
        return self._view("panel", V.panel)

    def panel_years(self, lo: int | None = None, hi: int | None = None) -> DataFrame:
        """The panel of the years ``lo`` to ``hi`` only; the bounds reach the scan of ``orders``."""
        return V.panel(self.t, lo, hi)

    @property
    def sites(self) -> DataFrame:
        return V.sites(self.t)

    @property
    def firms(self) -> DataFrame:
        return self._view("firms", V.firms)


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from terrapanel.plans import (  # noqa: F401
        q_kpi, q_quality, q_reshape, q_serve, q_text, q_trend, q_models, q_sources, q_bands, q_intake, q_landed, q_snapshots, q_streams,
    )
    return QUERIES
