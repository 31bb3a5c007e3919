"""Exact top-k search by inner product with a pivot-distance index.

Method: every vector is keyed by its nearest pivot and its distance to it.  A
query knows its distance to each pivot, so by the triangle inequality no vector
of an annulus [low, high] around pivot p is nearer than
``max(d(q, p) - high, low - d(q, p), (d(q, p) - min d(q, .)) / 2)``.  Annuli are
searched in the order of that bound: first the nearest ones, which give every
query a k-th best score so far, then only those whose bound can still reach it.

Largest inner product is smallest distance once every vector v has one more
component ``sqrt(M - |v|^2)``, M the largest squared norm, and queries have 0
there: then ``d(q, v)^2 = |q|^2 + M - 2 q.v``.

Pivots are a bounded sample (at most ``PIVOTS`` rows by hash of the id); all rows
are indexed.  The directory of annuli has at most ``PIVOTS * RINGS`` entries.
An annulus of many rows, and the queries that visit it, are dealt to blocks of
about ``SIDE`` rows each, so no task holds a whole annulus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrapanel.llm.common import grouped, materialize
from terrapanel.llm.embed_neardup import matrix, vector_rows

PIVOTS, RINGS, SIDE = 64, 32, 1024
#: Bounds are relaxed by this share, and by ten times it of the largest norm, for rounding in distances.
SLACK = 1e-6
SEED = 3


def scaled(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(id, is_query, vec: floor(scale * x) as doubles, norm2, dim) of the rows that take part."""
    for b in batches:
        at, raw, norm, dim = [], [], [], []
        for i, x in vector_rows(b.column("vec"), np.float64):
            v = np.floor(scale * x)
            if b.column("id")[i].is_valid and np.isfinite(v).all():
                at.append(i)
                raw.append(v.tobytes())
                norm.append(float(v @ v))
                dim.append(len(v))
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("id").take(rows), b.column("is_query").take(rows), pa.array(raw, pa.binary()),
                                          pa.array(norm, pa.float64()), pa.array(dim, pa.int32())], ["id", "is_query", "vec", "norm2", "dim"])


def _lift(v: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the component that makes all norms equal."""
    return np.c_[v, np.sqrt(np.maximum(most - (v * v).sum(axis=1), 0.0))]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T), 0.0))


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products: exact in double precision where they must be, else in big integers, cut to the long range."""
    if q.shape[1] * np.abs(q).max(initial=0) * np.abs(v).max(initial=0) < 2**53:
        return (q @ v.T).astype(np.int64)
    big = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in v], dtype=object).T
    return np.clip(big, -2**63, 2**63 - 1).astype(np.int64)


def top(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int):
    """Per query the k best of ``v`` at or over its floor, never its own id; ties to the smaller id."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    s = scores(q, v)
    ok = (s >= floor[:, None]) & (q_ids[:, None] != v_ids[None, :])
    for i in np.flatnonzero(ok.any(axis=1)).tolist():
        at = np.flatnonzero(ok[i])
        if len(at) > k:
            cut = np.partition(s[i, at], len(at) - k)[len(at) - k]
            at = at[s[i, at] >= cut]
        best = at[np.argsort(-s[i, at].astype(np.float64) if abs(int(s[i, at].min())) < 2**53 and abs(int(s[i, at].max())) < 2**53
                             else [-int(x) for x in s[i, at]], kind="stable")][:k]
        yield i, v_ids[best], s[i, best]


def _best(rows: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, scale: float = 64.0,
           pivots: int = PIVOTS, rings: int = RINGS, side: int = SIDE, seed: int = SEED) -> DataFrame:
    """The k highest scores of every query row over all rows but its own.

    Score: inner product of ``floor(scale * x)``.  Returns (query_id, rank from 1,
    vec_id, score); ties go to the smaller vec_id; fewer than k candidates give
    fewer rows.

    Edge cases: rows with a null id, or a vector that is null, empty, or holds
    null or non-finite components, take no part.  Vectors of another length are
    no candidates of a query.  Rows that repeat an id are the query's own row
    and no candidates of it; as candidates of others, each (id, vector) counts
    once.  Scores beyond the long range are cut to it.  An empty table, or one
    without queries, gives no rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vec_col).alias("vec"))
    rows = materialize(rows.mapInArrow(lambda it: scaled(it, scale), "id long, is_query boolean, vec binary, norm2 double, dim int")
                       .dropDuplicates(["id", "vec"]), "search_rows")
    shapes = {r["dim"]: (r["n"], r["most"]) for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).collect()}
    out = None
    for dim, (n, most) in sorted(shapes.items()):
        found = _search(rows.filter(F.col("dim") == dim), n, most, k, pivots, rings, side, seed)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _search(rows: DataFrame, n: int, most: float, k: int, pivots: int, rings: int, side: int, seed: int) -> DataFrame:
    """``search`` over rows of one length; ``most`` is the largest squared norm."""
    count = max(1, min(pivots, math.ceil(math.sqrt(n) / 8)))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "id", "vec")).limit(count).select("vec").collect()  # at most PIVOTS vectors
    p = _lift(np.unique(np.stack([np.frombuffer(r["vec"], dtype=np.float64) for r in picked]), axis=0), most)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_lift(matrix(b.column("vec"), np.float64), most), p)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], [*b.schema.names, "pivot", "distance"])

    keyed = materialize(rows.select("id", "is_query", "vec")
                        .mapInArrow(key, "id long, is_query boolean, vec binary, pivot int, distance double"), "search_keyed")
    cells = {r["pivot"]: r for r in keyed.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high")).collect()}
    width = {c: (r["low"], max(r["high"] - r["low"], 1e-9) / min(rings, math.ceil(r["n"] / side)) * (1 + 1e-9)) for c, r in cells.items()}
    low = F.create_map(*[F.lit(x) for c, (a, _) in width.items() for x in (c, a)])
    step = F.create_map(*[F.lit(x) for c, (_, w) in width.items() for x in (c, w)])
    ring = (F.col("pivot") * rings + F.least(F.lit(rings - 1), F.floor((F.col("distance") - low[F.col("pivot")]) / step[F.col("pivot")]))).cast("int")
    index = keyed.select("id", "vec", "distance", "pivot", ring.alias("ring"))
    annuli = sorted(tuple(r) for r in index.groupBy("ring", "pivot").agg(F.count(F.lit(1)), F.min("distance"), F.max("distance")).collect())
    a_ring, a_pivot, a_n = (np.array([a[i] for a in annuli], dtype=np.int64) for i in range(3))
    a_low, a_high = (np.array([a[i] for a in annuli]) for i in (3, 4))

    def visits(batches: Iterator[pa.RecordBatch], first: bool) -> Iterator[pa.RecordBatch]:
        """(ring, id, vec, floor) for the annuli of the first round, or for the others that can still matter."""
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                q = matrix(part.column("vec"), np.float64)
                d = _distances(np.c_[q, np.zeros(len(q))], p)
                own = d[:, a_pivot]
                bound = np.maximum(np.maximum(own - a_high, a_low - own), (own - d.min(axis=1, keepdims=True)) / 2)
                bound = np.maximum(bound * (1 - SLACK) - 10 * SLACK * (1 + math.sqrt(most)), 0.0)
                order = np.argsort(bound, axis=1, kind="stable")
                before = np.take_along_axis(np.broadcast_to(a_n, bound.shape), order, axis=1)
                before = np.cumsum(before, axis=1) - before
                go = np.zeros(bound.shape, dtype=bool)
                np.put_along_axis(go, order, before < k + 1, axis=1)
                floor = np.full(len(q), -2**63, dtype=np.int64)
                if not first:
                    got = part.column("floor")
                    floor[:] = got.fill_null(-2**63).to_numpy(zero_copy_only=False)
                    reach = (q * q).sum(axis=1) + most - 2.0 * floor
                    go = ~go & (bound**2 <= reach[:, None] * (1 + SLACK) + SLACK)
                i, j = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([pa.array(a_ring[j].astype(np.int32)), part.column("id").take(pa.array(i)),
                                                  part.column("vec").take(pa.array(i)), pa.array(floor[i])], ["ring", "id", "vec", "floor"])

    def run(queries: DataFrame, first: bool) -> DataFrame:
        """(query_id, vec_id, score): per query and block the k best at or over the floor."""
        seen = materialize(queries.mapInArrow(lambda it: visits(it, first), "ring int, id long, vec binary, floor long"), "search_visits")
        # per annulus: chunks of its rows and of its visitors; at most PIVOTS * RINGS rows
        askers = {r["ring"]: r["c"] for r in seen.groupBy("ring").agg(F.count(F.lit(1)).alias("c")).collect()}
        if not askers:
            return None
        held = {int(r): math.ceil(int(c) / side) for r, c in zip(a_ring, a_n, strict=True)}
        v_parts = F.create_map(*[F.lit(x) for r in askers for x in (r, held[r])])[F.col("ring")]
        q_parts = F.create_map(*[F.lit(x) for r, c in askers.items() for x in (r, math.ceil(c / side))])[F.col("ring")]
        chunk = lambda parts: F.pmod(F.xxhash64(F.lit(seed), "id"), parts.cast("long")).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), parts - 1))
        v = (index.filter(q_parts.isNotNull()).select("ring", "id", "vec", chunk(v_parts).alias("i"), q_parts.alias("m"))
             .select("ring", "i", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"), F.lit(False).alias("asks"), "id", "vec", F.lit(0).cast("long").alias("floor")))
        q = seen.select("ring", every(v_parts).alias("i"), chunk(q_parts).alias("j"), F.lit(True).alias("asks"), "id", "vec", "floor")

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in grouped(batches, ["ring", "i", "j"]):
                asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
                if asks.all() or not asks.any():
                    continue
                ids, vec, floor = np.asarray(t["id"]), matrix(t["vec"], np.float64), np.asarray(t["floor"])
                q_ids = ids[asks]
                for s in range(0, len(q_ids), side):
                    w = slice(s, s + side)
                    out = [(np.full(len(c), q_ids[w][i]), c, x) for i, c, x in top(q_ids[w], vec[asks][w], floor[asks][w], ids[~asks], vec[~asks], k)]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

        return (v.unionByName(q).repartition("ring", "i", "j").sortWithinPartitions("ring", "i", "j")
                .mapInArrow(blocks, "query_id long, vec_id long, score long"))

    queries = keyed.filter("is_query").select("id", "vec")
    got = run(queries, True)
    if got is None:
        return df_empty(rows)
    got = materialize(_best(got.distinct(), k), "search_first")
    floors = got.filter(F.col("rank") == k).select(F.col("query_id"), F.col("score").alias("floor"))
    more = run(queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "vec", "floor"), False)
    if more is None:
        return got
    return _best(got.drop("rank").unionByName(more).distinct(), k)


def df_empty(rows: DataFrame) -> DataFrame:
    return rows.limit(0).select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.col("id").alias("score"), F.lit(0).alias("rank"))
