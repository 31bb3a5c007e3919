"""Pages of a sorted table that cost the same at any depth.

``write`` sorts a table once: range-partitioned by the order columns (and a tie
number, so that rows with equal keys spread too), each slice sorted and written
to a folder of its own, beside an index with the rows of each slice and the range of its
keys.  ``page`` finds in the index which slices hold the asked positions and reads
only those, so page 100,000 opens one small file; ``page_after`` continues from a
key instead of a number, which stays right when rows were added elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows to a slice: what a page reads at most twice of.
SLICE_ROWS = 50_000
TIE = "__tie"


def _order(by: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in by]


class Pages:
    """A table sorted by ``by`` (column, ascending) under ``path``."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[tuple[str, bool]]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), [(c, bool(up)) for c, up in by]

    def write(self, df: DataFrame, rows: int | None = None) -> Pages:
        """Sort and write ``df``; ``rows``: its row count, where known.  A path is written once."""
        n = df.count() if rows is None else rows
        slices = max(1, -(-n // SLICE_ROWS))
        order = [*_order(self.by), F.col(TIE)]
        ranged = df.withColumn(TIE, F.monotonically_increasing_id()).repartitionByRange(slices, *order)
        (ranged.withColumn("__slice", F.spark_partition_id()).sortWithinPartitions("__slice", *order)
               .write.mode("errorifexists").partitionBy("__slice").parquet(f"{self.path}/rows"))
        done = self.spark.read.parquet(f"{self.path}/rows") if n else df.withColumn("__slice", F.lit(0))
        ends = [f(c).alias(f"{name}_{c}") for c, _ in self.by for f, name in ((F.min, "min"), (F.max, "max"))]
        index = done.groupBy("__slice").agg(F.count(F.lit(1)).alias("rows"), *ends)
        index.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/index")
        df.limit(0).write.mode("errorifexists").parquet(f"{self.path}/schema")
        return self

    def slices(self) -> list[tuple[int, int, int]]:
        """(slice, rows before it, its rows): one entry per ``SLICE_ROWS`` rows."""
        before, out = 0, []
        for r in sorted(self.spark.read.parquet(f"{self.path}/index").select("__slice", "rows").collect()):
            out.append((r["__slice"], before, r["rows"]))
            before += r["rows"]
        return out

    @property
    def rows(self) -> int:
        return sum(n for *_, n in self.slices())

    def _read(self, slices: Sequence[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/__slice={s}" for s in slices])

    def _none(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/schema")

    def page(self, number: int, size: int = 10) -> DataFrame:
        """Page ``number`` (from 1) in order; fewer rows on the last page, none beyond it."""
        if number < 1 or size < 1:
            raise ValueError("pages and their size count from 1")
        start = (number - 1) * size
        held = [(s, before) for s, before, n in self.slices() if before < start + size and start < before + n]
        if not held:
            return self._none()
        part = self._read([s for s, _ in held])
        skip = start - held[0][1]
        return part.orderBy("__slice", *_order(self.by), TIE).offset(skip).limit(size).drop("__slice", TIE)

    def page_after(self, key: dict[str, object] | None, size: int = 10) -> DataFrame:
        """The ``size`` rows after the row with this key (None: the first), for an order without ties.

        Slices that end before the key are not read; of the others only as many as
        hold ``size`` rows beyond it.
        """
        if key is None:
            return self.page(1, size)
        after = F.lit(False)
        for i, (c, up) in enumerate(self.by):
            same = F.lit(True)
            for d, _ in self.by[:i]:
                same = same & F.col(d).eqNullSafe(F.lit(key[d]))
            v = F.lit(key[c])
            if key[c] is None:  # nulls come first going up, last going down
                beyond = F.col(c).isNotNull() if up else F.lit(False)
            else:
                beyond = F.col(c) > v if up else F.col(c).isNull() | (F.col(c) < v)
            after = after | (same & beyond)
        lead, up = self.by[0]
        index = self.spark.read.parquet(f"{self.path}/index")
        end, value = F.col(f"max_{lead}" if up else f"min_{lead}"), F.lit(key[lead])
        passed = F.lit(False) if key[lead] is None else F.coalesce(end < value if up else end > value, F.lit(up))
        if not up:  # nulls come last: a slice that may hold some isn't passed
            passed = passed & end.isNotNull()
        left = [r["__slice"] for r in sorted(index.where(~passed).select("__slice", "rows").collect())]
        counts = {s: n for s, _, n in self.slices()}
        out, held = None, 0
        for at in range(len(left)):
            # the first slice may lie before the key in part, or wholly where many rows share its lead
            out = self._read(left[:at + 1]).where(after)
            held += counts[left[at]]
            if held - counts[left[0]] >= size or at + 1 == len(left):
                if out.limit(size).count() >= size or at + 1 == len(left):
                    break
        if out is None:
            return self._none()
        return out.orderBy("__slice", *_order(self.by), TIE).limit(size).drop("__slice", TIE)
