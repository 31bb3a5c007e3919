"""Registry-driven cleaning: codes, coercion, clamps, drop-missing, dedupe.

One narrow stage of column expressions, then one aggregate for the dedupe
(``latest_per_key``).  Order follows the local pipeline: clamp, drop rows with a
missing required value, keep the latest row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from terrapanel.functions.clean import clamp, code, nan_to_null, strip, to_number
from terrapanel.operators.window import latest_per_key
from terrapanel.registry import Dataset


def clean(df: DataFrame, ds: Dataset, order_by: Sequence[str] = ("_batch", "_row_seq"),
          numeric_text: dict[str, str] | None = None, null_as_lower: bool = False,
          dropna: Sequence[str] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Clean a landed frame of dataset ``ds``.

    ``numeric_text`` maps a raw text column to the numeric column it becomes
    (coerced, bad → null); measures and bounded columns that land as text under their own
    name are coerced too, so an all-text frame cleans.  ``null_as_lower`` selects the silver clamp (P7).
    ``dropna`` defaults to the registry's required set for the local stage.
    The result keeps ``keep`` columns (default: every non-lineage column).
    """
    numeric_text = numeric_text or {}
    cols, types = {}, dict(df.dtypes)
    for c in df.columns:
        e = F.col(c)
        if c in ds.code_cols:
            e = code(c)
        elif c in ds.text_cols:
            e = strip(c)
        if c in numeric_text:
            cols[numeric_text[c]] = to_number(c)
            continue
        if types[c] == "string" and (c in ds.bounds or c in ds.clamp or c in ds.int_cols or c in ds.measures):
            e = to_number(c)
            if c in ds.int_cols:
                e = F.when(e == F.floor(e), e.cast("bigint"))
        cols[c] = e
    for c, b in ds.clamp.items():
        if c in cols:
            cols[c] = clamp(nan_to_null(cols[c]) if not null_as_lower else cols[c], b.lo, b.hi,
                            null_as_lower=null_as_lower)
    out = df.select(*[e.alias(n) for n, e in cols.items()])
    need = [c for c in (dropna if dropna is not None else ds.dropna) if c in out.columns]
    if need:
        out = out.na.drop(subset=need)
    order = [c for c in order_by if c in out.columns]
    if order:
        out = latest_per_key(out, list(ds.key), order)
    keep = list(keep) if keep is not None else [c for c in out.columns if not c.startswith("_")]
    return out.select(*keep)
