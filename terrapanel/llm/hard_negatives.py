"""Hard-negative mining by segment summary filtering.

Method: every vector is stored with the mean and the deviation (the length of
what remains after taking the mean off) of each of its segments, at several
levels: one segment, then four times as many at every further level.  For a
segment of L components the inner product lies within

    L * mean(q) * mean(v)  -/+  deviation(q) * deviation(v)

by Cauchy-Schwarz, and the sums over the segments bound the whole score.  A
search starts with the coarsest level: pairs whose bounds can't reach the wanted
interval, or can't beat the k-th best found so far, go; the others are bounded
again on finer segments; what is left after the last level is scored exactly.
The k-th best is known from lower bounds first, from scores later.

Two rounds use it: an anchor's positives (the best rows of its own label) and,
per positive, the best rows of other labels inside the margin.  Anchors are a
stated query set; they and the rows are dealt to blocks of about ``SIDE``
anchors and ``ROWS`` rows by hash, so no label, however many rows it has, is held
by one task, and a block returns at most k rows per search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrapanel.llm.common import grouped, materialize
from terrapanel.llm.embed_neardup import matrix, vector_rows
from terrapanel.llm.pivot_search import scores

SIDE, ROWS = 2048, 8192
#: Anchors and rows that are bounded at a time within a block.
TILE_Q, TILE_V = 256, 2048
#: Bounds are relaxed by this share of the vectors' lengths, for rounding.
SLACK = 1e-9


def segments(dim: int) -> list[np.ndarray]:
    """Starts of the segments of each level: 1, 4, 16, ... of them while a segment keeps four components or more."""
    levels, n = [], 1
    while n == 1 or dim // n >= 4:
        levels.append(np.arange(n) * dim // n)
        n *= 4
    return levels


def summarise(x: np.ndarray) -> np.ndarray:
    """Rows of segment means and deviations, level after level."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        for starts in segments(x.shape[1]):
            size = np.diff([*starts, x.shape[1]])
            mean = np.add.reduceat(x, starts, axis=1) / size
            rest = x - np.repeat(mean, size, axis=1)
            out += [mean, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))]
    return np.concatenate(out, axis=1)


def bounds(q: np.ndarray, v: np.ndarray, dim: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all scores between summaries ``q`` and ``v``, from one level of them."""
    levels = segments(dim)
    starts = levels[level]
    at, n = 2 * sum(len(s) for s in levels[:level]), len(starts)
    size = np.diff([*starts, dim])
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = q[:, at:at + n] * np.sqrt(size), v[:, at:at + n] * np.sqrt(size)
        c, d = q[:, at + n:at + 2 * n], v[:, at + n:at + 2 * n]
        long_q, long_v = (np.sqrt((m * m).sum(axis=1) + (r * r).sum(axis=1)) for m, r in ((a, c), (b, d)))
        middle, reach = a @ b.T, c @ d.T + SLACK * (1 + long_q[:, None] * long_v[None, :])
        low, high = middle - reach, middle + reach
    # sums beyond the range of doubles say nothing; scores are cut to the long range, and so are their bounds
    return (np.clip(np.where(np.isfinite(low), low, -np.inf), -2.0**63, 2.0**63),
            np.clip(np.where(np.isfinite(high), high, np.inf), -2.0**63, 2.0**63))


def _kth(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; -inf where there are fewer."""
    if x.shape[1] < k:
        return np.full(len(x), -np.inf)
    return np.partition(x, x.shape[1] - k, axis=1)[:, x.shape[1] - k]


class Searches:
    """Searches of one block: row of their anchor, wanted interval, k-th best so far, and what was found."""

    def __init__(self, owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int):
        self.owner, self.lo, self.hi, self.k = owner, lo.astype(np.float64), hi.astype(np.float64), k
        self.floor = np.full(len(owner), -np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pairs = self.scored = 0

    def tile(self, which: np.ndarray, q: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray, np.ndarray], may: np.ndarray) -> None:
        """Candidates ``v`` = (ids, vectors, summaries) for the searches ``which``; ``may``: anchor row x candidate."""
        ids, vec, summary = v
        open_, cols, alive = which, np.arange(len(ids)), may[self.owner[which]]
        dim = vec.shape[1]
        self.pairs += int(alive.sum())
        for level in range(len(segments(dim))):
            keep, left = alive.any(axis=1), alive.any(axis=0)
            open_, cols, alive = open_[keep], cols[left], alive[np.ix_(keep, left)]
            if not len(open_):
                return
            rows, back = np.unique(self.owner[open_], return_inverse=True)
            low, high = (b[back] for b in bounds(q[1][rows], summary[cols], dim, level))
            lo, hi = self.lo[open_, None], self.hi[open_, None]
            sure = alive & (low >= lo) & (high <= hi)
            self.floor[open_] = np.maximum(self.floor[open_], _kth(np.where(sure, low, -np.inf), self.k))
            alive &= (high >= np.maximum(lo, self.floor[open_, None])) & (low <= hi)
        keep, left = alive.any(axis=1), alive.any(axis=0)
        open_, cols, alive = open_[keep], cols[left], alive[np.ix_(keep, left)]
        if not len(open_):
            return
        rows, back = np.unique(self.owner[open_], return_inverse=True)
        self.scored += len(rows) * len(cols)
        s = scores(q[0][rows], vec[cols])[back]
        f = s.astype(np.float64)
        alive &= (f >= self.lo[open_, None]) & (f <= self.hi[open_, None]) & (f >= self.floor[open_, None])
        self.floor[open_] = np.maximum(self.floor[open_], _kth(np.where(alive, f, -np.inf), self.k))
        alive &= f >= self.floor[open_, None]
        i, j = np.nonzero(alive)
        self.found.append((open_[i], ids[cols[j]], s[i, j]))

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, id, score): the k best of each search, ties to the smaller id."""
        if not self.found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        which, ids, s = (np.concatenate(c) for c in zip(*self.found, strict=True))
        order = np.lexsort((ids, ~s, which))  # ~s falls as s rises, and can't overflow
        which, ids, s = which[order], ids[order], s[order]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        rank = np.arange(len(which)) - np.repeat(first, np.diff(np.r_[first, len(which)]))
        at = rank < self.k
        return which[at], ids[at], s[at]


def run_block(found: Searches, anchors: dict[str, np.ndarray], rows: dict[str, np.ndarray], same_label: bool):
    """All searches of one block over all its rows; returns ``found.best()``."""
    order = np.argsort(found.owner, kind="stable")
    for a in range(0, len(anchors["id"]), TILE_Q):
        which = order[(found.owner[order] >= a) & (found.owner[order] < a + TILE_Q)]
        for b in range(0, len(rows["id"]), TILE_V):
            w = slice(b, b + TILE_V)
            may = np.zeros((len(anchors["id"]), len(rows["id"][w])), dtype=bool)
            own = slice(a, a + TILE_Q)
            same = anchors["label"][own, None] == rows["label"][None, w]
            may[own] = (same if same_label else ~same) & (anchors["id"][own, None] != rows["id"][None, w])
            found.tile(which, (anchors["vec"], anchors["summary"]), (rows["id"][w], rows["vec"][w], rows["summary"][w]), may)
    return found.best()


def prepared(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """Rows that take part, with ``floor(scale * x)`` as doubles and the stored summaries."""
    for b in batches:
        at, vec, summary, dim = [], [], [], []
        for i, x in vector_rows(b.column("vec"), np.float64):
            v = np.floor(scale * x)
            if b.column("id")[i].is_valid and b.column("label")[i].is_valid and np.isfinite(v).all():
                at.append(i)
                vec.append(v.tobytes())
                summary.append(summarise(v[None, :])[0].tobytes())
                dim.append(len(v))
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c).take(rows) for c in ("id", "label", "asks")), pa.array(dim, pa.int32()), pa.array(vec, pa.binary()), pa.array(summary, pa.binary())],
            ["id", "label", "asks", "dim", "vec", "summary"])


def _blocks(rows: DataFrame, anchors: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """Rows and anchors of each key dealt to blocks (i: chunk of rows, j: chunk of anchors), and the tasks for them."""
    n = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("parts_v"))
    m = anchors.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / SIDE).cast("int").alias("parts_q"))
    sizes = materialize(n.join(m, keys), "negatives_sizes")
    blocks = sizes.agg(F.sum(F.col("parts_v").cast("long") * F.col("parts_q"))).first()[0] or 0
    part = lambda of: F.pmod(F.xxhash64(F.lit(11), "id"), F.col(of).cast("long")).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    v = rows.withColumn("asks", F.lit(False)).join(sizes, keys).withColumn("i", part("parts_v")).withColumn("j", every("parts_q"))
    q = anchors.withColumn("asks", F.lit(True)).join(sizes, keys).withColumn("j", part("parts_q")).withColumn("i", every("parts_v"))
    dealt = v.unionByName(q, allowMissingColumns=True).drop("parts_v", "parts_q")
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(blocks, max(least, blocks // 8)))
    at = [*keys, "i", "j"]
    return dealt.repartition(tasks, *at).sortWithinPartitions(*at), tasks


def _side(t: pa.Table, at: np.ndarray) -> dict[str, np.ndarray]:
    rows = t.take(pa.array(at))
    return {"id": np.asarray(rows["id"]), "label": np.asarray(rows["label"]),
            "vec": matrix(rows["vec"], np.float64), "summary": matrix(rows["summary"], np.float64)}


def _ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def mine(df: DataFrame, is_anchor: Column, label: Column | str = "label", id_col: str = "vec_id", vec_col: str = "embedding",
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """Hard negatives of every anchor row and each of its best positives.

    Score: inner product of ``floor(scale * x)``.  An anchor's positives are the
    ``positives`` highest rows of its label; a positive's negatives are the
    ``negatives`` highest rows of other labels with ``low * p <= 100 * n <= high * p``
    (p, n: scores of positive and negative).  Ties go to the smaller id; fewer
    rows where there are fewer.  Returns (anchor_id, positive_id, rank from 1,
    negative_id, positive_score, negative_score).

    Edge cases: rows with a null id or label, or a vector that is null, empty, or
    holds null or non-finite components, take no part.  Only vectors of one
    length are compared.  Of rows that share an id, the smallest by (label,
    vector) counts.  A positive of negative score has no negatives (the interval
    is empty).  Scores beyond the long range are cut to it.  An empty table, or
    one without anchors, gives no rows; other columns are ignored.
    """
    label = F.col(label) if isinstance(label, str) else label
    rows = df.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                     F.coalesce(is_anchor, F.lit(False)).alias("asks"), F.col(vec_col).alias("vec"))
    rows = rows.mapInArrow(lambda it: prepared(it, scale), "id long, label long, asks boolean, dim int, vec binary, summary binary")
    rows = materialize(rows.groupBy("id").agg(F.min(F.struct("label", "vec", "summary", "dim")).alias("r"), F.max("asks").alias("asks"))
                       .select("id", "r.*", "asks"), "negatives_rows")
    v = rows.select("id", "label", "dim", "vec", "summary")
    anchors = rows.filter("asks").select("id", "label", "dim", "vec", "summary")

    def own_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["dim", "label", "i", "j"]):
            asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            q = _side(t, np.flatnonzero(asks))
            n = len(q["id"])
            found = Searches(np.arange(n), np.full(n, -np.inf), np.full(n, np.inf), positives)
            which, ids, s = run_block(found, q, _side(t, np.flatnonzero(~asks)), True)
            yield pa.RecordBatch.from_arrays([pa.array(q["id"][which]), pa.array(ids), pa.array(s)], ["id", "other", "score"])

    dealt, _ = _blocks(v, anchors, ["dim", "label"])
    best = materialize(_ranked(dealt.mapInArrow(own_label, "id long, other long, score long"), ["id"], positives), "negatives_positives")
    wanted = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "score"))).alias("p"))  # at most ``positives`` each
    wanted = anchors.join(wanted.select("id", F.col("p.other").alias("p_ids"), F.col("p.score").alias("p_scores")), "id")

    def other_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["dim", "i", "j"]):
            asks = t["asks"].to_numpy(zero_copy_only=False).astype(bool)
            if asks.all() or not asks.any():
                continue
            at = np.flatnonzero(asks)
            q = _side(t, at)
            p_ids, p_scores = (t[c].take(pa.array(at)).to_pylist() for c in ("p_ids", "p_scores"))
            pairs = [(i, p, s, -((-low * s) // 100), high * s // 100) for i, (ps, ss) in enumerate(zip(p_ids, p_scores, strict=True))
                     for p, s in zip(ps, ss, strict=True)]
            pairs = [x for x in pairs if x[3] <= x[4]]
            if not pairs:
                continue
            owner, p, s, lo, hi = (np.array(c, dtype=np.int64) for c in zip(*pairs, strict=True))
            which, ids, n = run_block(Searches(owner, lo, hi, negatives), q, _side(t, np.flatnonzero(~asks)), False)
            ok = (n >= lo[which]) & (n <= hi[which])
            which, ids, n = which[ok], ids[ok], n[ok]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q["id"][owner[which]], p[which], s[which], ids, n)],
                                             ["anchor_id", "positive_id", "positive_score", "other", "score"])

    dealt, _ = _blocks(v, wanted, ["dim"])
    dealt = dealt.mapInArrow(other_labels, "anchor_id long, positive_id long, positive_score long, other long, score long")
    out = _ranked(dealt, ["anchor_id", "positive_id"], negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))
