"""Near-duplicate embeddings by Euclidean p-stable hashing.

Method: vectors are scaled to unit length; a table hashes a vector with
``width`` random Gaussian projections, each shifted and cut into slots of
``slot``, and the slot numbers together name its bucket; vectors that share a
bucket in any table are compared by exact cosine in double precision.

Unit vectors with cosine c lie ``sqrt(2 - 2c)`` apart, so the chance that one
projection puts two of them in one slot is known.  ``plan`` derives the number
of projections from the row count (unrelated vectors then share a bucket with
about ``BUCKET`` others at any size) and the number of tables from the wanted
recall at exactly the threshold; closer pairs are missed far more rarely.

Equal vectors are one class and are compared once.  A bucket of many classes is
dealt to blocks of at most about ``2 * SIDE`` rows.  Blocks are first formed of
class numbers and ``BITS`` signs of further projections alone: a pair at the
threshold differs in few signs, and only members of a pair within ``SIGMAS``
standard deviations of that go on, joined with their vectors, to the exact check
(the chance to lose a pair at exactly the threshold is below 1e-7; one in ten
thousand unrelated pairs goes on).  A block returns a count of links per vector
and one edge per vector to the smallest id of its local component, never the
pairs.  A pair that meets in several tables is counted in the first of them: a
block recomputes the earlier buckets of linked vectors in exact integer
arithmetic.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import grouped, materialize, tiles
from terrapanel.llm.components import components

SEED = 20_241
SLOT = 2.4
RECALL = 0.995
BUCKET = 256
SIDE = 1024
BITS, SIGMAS = 128, 6.0
#: Cosines this near the threshold are computed again in one fixed order, so that every block judges a pair alike.
BORDER = 1e-12
#: Unit components and projections are rounded to multiples of these: products
#: and sums of them are exact in double precision in any order of addition.
UNIT, GAUSS = 2.0**24, 2.0**10


def slot_chance(distance: float, slot: float) -> float:
    """Chance that a shifted Gaussian projection puts two points this far apart in one slot."""
    r = slot / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, recall: float = RECALL, slot: float = SLOT) -> tuple[int, int]:
    """(projections per table, tables) for this many rows."""
    near = slot_chance(max(math.sqrt(max(2 - 2 * threshold, 0.0)), 1e-3), slot)
    far = slot_chance(math.sqrt(2), slot)
    width = max(2, math.ceil(math.log(max(rows, 2 * BUCKET) / BUCKET) / -math.log(far)))
    return width, max(1, math.ceil(math.log(1 - recall) / math.log1p(-near**width)))


class Hasher:
    """Bucket numbers of vectors, the same whatever other vectors share the call."""

    def __init__(self, dim: int, width: int, tables: int, slot: float, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.a = np.rint(rng.standard_normal((dim, tables * width)) * GAUSS)
        self.b = np.floor(rng.random(tables * width) * slot * UNIT * GAUSS)
        self.mul = rng.integers(1, 2**62, size=width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.slot, self.width, self.tables = slot * UNIT * GAUSS, width, tables
        self.signs = rng.standard_normal((dim, BITS))

    def keys(self, unit: np.ndarray, tables: int | None = None) -> np.ndarray:
        """unit: rows of unit length; returns a 64-bit bucket number per row and table, of the first ``tables`` tables."""
        tables = self.tables if tables is None else tables
        n = tables * self.width
        slots = np.floor((np.rint(unit * UNIT) @ self.a[:, :n] + self.b[:n]) / self.slot).astype(np.int64).view(np.uint64)
        x = (slots.reshape(len(unit), tables, self.width) * self.mul).sum(axis=2, dtype=np.uint64)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        return x.view(np.int64)


    def sketch(self, unit: np.ndarray) -> np.ndarray:
        """The signs of ``BITS`` projections per row, as 64-bit words."""
        return np.packbits(unit @ self.signs >= 0, axis=1).view(np.int64)


def sign_cut(threshold: float) -> int:
    """The most signs in which a pair at the threshold may differ and still be compared."""
    p = math.acos(min(max(threshold, -1.0), 1.0)) / math.pi
    return math.ceil(BITS * p + SIGMAS * math.sqrt(BITS * p * (1 - p)) + 2)


def links(unit: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of rows have cosine >= threshold; a pair is judged alike whatever other rows share the call."""
    cosine = unit @ unit.T
    near = cosine >= threshold
    i, j = np.nonzero(np.triu(np.abs(cosine - threshold) <= BORDER, 1))
    if len(i):
        near[i, j] = near[j, i] = (unit[i] * unit[j]).sum(axis=1) >= threshold
    np.fill_diagonal(near, False)
    return near


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to unit length; the largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def vector_rows(col: pa.Array, dtype: type) -> Iterator[tuple[int, np.ndarray]]:
    """(row, vector) of the rows whose vector has components, all of them finite."""
    for i, v in enumerate(col):
        if not v.is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(dtype)
        if np.isfinite(x).all():
            yield i, x


def matrix(col: pa.Array | pa.ChunkedArray, dtype: type) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    cut = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset:col.offset + len(col) + 1]
    flat = np.frombuffer(col.buffers()[2], dtype=np.uint8)[cut[0]:cut[-1]]
    return flat.view(dtype).reshape(len(col), -1)


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                    threshold: float = 0.9, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """Links between all rows with cosine >= ``threshold``.

    Returns one row per row of ``df``: id, ``n_links`` (other rows linked
    directly), ``component_id`` (smallest id reachable, its own included),
    ``kept`` (its id is the component's).

    Edge cases: vectors that are null, empty or zero, or hold null or non-finite
    components, and rows with a null id, link with nothing (0 links, own id,
    kept; a null id stays null and is not kept).  Vectors of different lengths
    are never linked.  Equal vectors, repeated rows included, are linked with
    one another.  An id on several rows is one node of the components, and each
    of its rows counts the links of its own vector.  An empty table gives no
    rows; other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    single = rows.schema["vec"].dataType.simpleString() == "array<float>"
    dtype = np.float32 if single else np.float64

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vecs, names = [None] * b.num_rows, [None] * b.num_rows
            for i, x in vector_rows(b.column("vec"), dtype):
                if x.any() and b.column("id")[i].is_valid:
                    vecs[i] = x.tobytes()
                    names[i] = hashlib.blake2b(vecs[i], digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.binary()), pa.array(vecs, pa.binary())],
                                             ["id", "digest", "vec"])

    member = materialize(rows.mapInArrow(digests, "id long, digest binary, vec binary"), "emb_rows")
    grouped_rows = member.filter("digest is not null").groupBy("digest").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    classes = materialize(
        grouped_rows.withColumn("dim", (F.octet_length("vec") / np.dtype(dtype).itemsize).cast("int"))
        .withColumn("cls", F.monotonically_increasing_id()), "emb_classes")
    n = classes.count()
    width, tables = plan(n, threshold, recall)
    args = (width, tables, SLOT, seed)
    words = [f"s{i}" for i in range(BITS // 64)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for d in np.unique(dims).tolist():
                h = hashers.setdefault(d, Hasher(d, *args))
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                for s in range(0, part.num_rows, 512):
                    p = part.slice(s, 512)
                    unit = units(matrix(p.column("vec"), dtype).astype(np.float64))
                    k, signs = h.keys(unit) + np.int64(d), h.sketch(unit)
                    r = np.repeat(np.arange(p.num_rows), tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), p.num_rows)), pa.array(k.ravel()), p.column("cls").take(pa.array(r)),
                         *(pa.array(signs[r, i]) for i in range(len(words)))], ["table", "slot", "cls", *words])

    keyed = materialize(
        classes.select("cls", "dim", "vec").mapInArrow(hashed, f"table int, slot long, cls long, {', '.join(f'{w} long' for w in words)}")
        .select(F.xxhash64("table", "slot").alias("bucket"), "table", "cls", *words), "emb_keys")
    sizes = materialize(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "emb_sizes")
    dealt = tiles(keyed, "bucket", F.col("cls"), sizes, SIDE)
    block, most = ["bucket", "tile_i", "tile_j"], sign_cut(threshold)
    spread = lambda df: df.repartition(*block).sortWithinPartitions(*block)

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a block that differ from another in few enough signs."""
        for t in grouped(batches, block):
            signs = [np.asarray(t[w]).view(np.uint64) for w in words]
            differ = sum(np.bitwise_count(x[:, None] ^ x[None, :]).astype(np.uint16) for x in signs)
            near = differ <= most
            np.fill_diagonal(near, False)
            if t["tile_i"][0].as_py() != t["tile_j"][0].as_py():
                chunk = np.asarray(t["chunk"])
                near &= chunk[:, None] != chunk[None, :]
            at = np.flatnonzero(near.any(axis=1))
            if len(at):
                yield from t.select([*block, "chunk", "table", "cls"]).take(pa.array(at)).combine_chunks().to_batches()

    maybe = materialize(spread(dealt.select(*block, "chunk", "table", "cls", *words)).mapInArrow(
        sieve, "bucket long, tile_i int, tile_j int, chunk int, table int, cls long"), "emb_maybe")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers: dict[int, Hasher] = {}
        for t in grouped(batches, block):
            i, j = t["tile_i"][0].as_py(), t["tile_j"][0].as_py()
            # one bucket number can stand for two tables or dimensions only by chance
            for (table, dim), own in _parts(t):
                if own.num_rows < 2:
                    continue
                unit = units(matrix(own["vec"], dtype).astype(np.float64))
                rep, copies = np.asarray(own["rep"]), np.asarray(own["copies"])
                near = links(unit, threshold)
                if i != j:
                    chunk = np.asarray(own["chunk"])
                    near &= chunk[:, None] != chunk[None, :]
                if not (at := np.flatnonzero(near.any(axis=1))).size:
                    continue
                near, rep, copies = near[np.ix_(at, at)], rep[at], copies[at]
                first = near.copy()
                if table:
                    h = hashers.setdefault(dim, Hasher(dim, *args))
                    keys = np.concatenate([h.keys(unit[at[s:s + 512]], table) for s in range(0, len(at), 512)])
                    for k in range(table):
                        first &= keys[:, k, None] != keys[None, :, k]
                low = rep.copy()
                while True:  # smallest id within the block's own components
                    now = np.minimum(low, np.where(near, low[None, :], np.iinfo(np.int64).max).min(axis=1))
                    if (now == low).all():
                        break
                    low = now
                yield pa.RecordBatch.from_arrays(
                    [own["cls"].combine_chunks().take(pa.array(at)), pa.array(rep), pa.array(low), pa.array((first * copies[None, :]).sum(axis=1))],
                    ["cls", "rep", "low", "links"])

    found = materialize(
        spread(maybe.join(classes.select("cls", "rep", "dim", "vec", "copies"), "cls"))
        .mapInArrow(blocks, "cls long, rep long, low long, links long")
        .groupBy("cls", "rep").agg(F.sum("links").alias("links"), F.collect_set("low").alias("lows")), "emb_links")
    # equal vectors are links between their ids too
    same = member.join(classes.filter("copies > 1").select("digest", "rep"), "digest").select(F.col("id").alias("u"), F.col("rep").alias("v"))
    comp = materialize(components(found.select(F.col("rep").alias("u"), F.explode("lows").alias("v")).union(same)), "emb_comp")
    per = classes.select("cls", "digest", "copies").join(found.select("cls", "links"), "cls", "left")
    per = materialize(per.select("digest", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
                      .filter("n_links > 0"), "emb_counts")
    named = member.filter("digest is not null").select("id", "digest").join(per, "digest", "left").select("id", "n_links")
    out = (named.unionByName(member.filter("digest is null").select("id", F.lit(None).cast("long").alias("n_links")))
           .join(comp.withColumnRenamed("node", "id"), "id", "left"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                      F.coalesce("component", "id").alias("component_id"),
                      (F.col("id").isNotNull() & (F.coalesce("component", "id") == F.col("id"))).alias("kept"))


def _parts(t: pa.Table) -> Iterator[tuple[tuple[int, int], pa.Table]]:
    table, dim = np.asarray(t["table"]), np.asarray(t["dim"])
    if (table == table[0]).all() and (dim == dim[0]).all():
        yield (int(table[0]), int(dim[0])), t
        return
    for pair in {*zip(table.tolist(), dim.tolist(), strict=True)}:
        yield pair, t.filter(pa.array((table == pair[0]) & (dim == pair[1])))
