"""Helpers shared by the operators of this package.

``grouped`` walks the sorted rows of one task group by group, so a task that
holds many small groups pays no per-group serialisation; ``tiles`` deals the
members of large groups to square blocks of a bounded number of rows.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.sources.tables import materialize

__all__ = ["materialize", "grouped", "tiles", "long_list", "worker_state", "with_row", "WORD"]

#: A word: a run of characters other than space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps from task to task (tokenizers, caches of a bounded size)."""
    kept = sys.modules.setdefault("_terrapanel_worker", types.ModuleType("_terrapanel_worker"))
    if not hasattr(kept, name):
        setattr(kept, name, make())
    return getattr(kept, name)


def with_row(df: DataFrame, **cols: Column) -> DataFrame:
    """``cols`` beside the whole input row as struct ``row``: names of the input can't clash with them."""
    return df.select(*[c.alias(k) for k, c in cols.items()], F.struct("*").alias("row"))


def long_list(arrays: list[np.ndarray]) -> pa.ListArray:
    """One list<int64> value for each array."""
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int64, copy=False)))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups of one key each; rows must come sorted by ``keys``.

    Holds one Arrow batch and the rows of the group that crosses its end.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        start = 0
        for cut in cuts:
            held.append(batch.slice(start, cut - start))
            start = cut
            if cut < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def tiles(rows: DataFrame, key: str, member: Column, sizes: DataFrame, side: int) -> DataFrame:
    """Deal the rows of each ``key`` to blocks ``(tile_i, tile_j)``, ``tile_i <= tile_j``.

    ``sizes`` has (key, members).  A key of m rows gets ``ceil(m / side)`` chunks
    by the hash of ``member``; every pair of chunks is one block, so each pair of
    rows of a key meets in exactly one block, and no block holds much more than
    ``2 * side`` rows however many rows a key has.  ``chunk`` is the row's own.
    """
    n = F.ceil(F.col("members") / F.lit(side)).cast("int")
    dealt = (rows.join(sizes, key)
             .withColumn("chunks", n)
             .withColumn("chunk", F.pmod(F.xxhash64(member), F.col("chunks").cast("long")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    return (dealt.withColumn("other", other)
            .withColumn("tile_i", F.least("chunk", "other"))
            .withColumn("tile_j", F.greatest("chunk", "other"))
            .drop("members", "chunks", "other"))
