"""Near-duplicate documents by bottom-k sketches of one hash function.

Method: a document's set of word shingles is hashed once; the sketch retains the
``K`` smallest hashes.  Inverted lists of retained values generate the overlaps,
the sketch of the union estimates a pair's similarity and filters, and links are
confirmed by exact Jaccard similarity of the full sets.

What keeps this linear where lists are long:

* equal sets are one class and are compared once;
* linked documents share at least ``shared_floor(size)`` retained values (five
  standard deviations under the expectation at the threshold), so a document
  with fewer values that any other document retains has no link and enters no
  list: a passage that many otherwise different documents share opens none;
* the others enter the lists of their ``LISTED`` smallest values only.  Each of
  the smallest values of a linked pair's union is shared with a chance of 0.75
  or more, so a pair without a common list has a chance of 0.25 ** LISTED;
* round 1 compares every document of a list with the list's smallest id only;
  confirmed links join into components, which settles groups of copies in one
  comparison per document;
* round 2 takes the lists that still hold several components, deals them to
  blocks of at most about ``2 * SIDE`` documents, and compares every pair of
  different components there by sketches of ``WIDE`` values.  Sets that fit
  their sketch are compared exactly; of their links a block returns one for
  each two components.

No pair is capped or dropped: round 2 covers all that round 1 leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import grouped, long_list, materialize, tiles
from terrapanel.llm.components import components, merge_components

WORDS = 5
K = 64
#: Retained values whose lists a document enters; size of the sketches that filter pairs.
LISTED, WIDE = 12, 256
#: Standard deviations between the expected overlap at the threshold and the filter.
SIGMAS = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
SIDE = 768
#: Fixed odd multipliers of the shingle hash.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles.

    Words are the runs between bytes 0x20 and 0x09 to 0x0D, A-Z lower-cased;
    with fewer than ``words``, the whole sequence is the one shingle.
    """
    import xxhash

    found = text.lower().split()
    if not found:
        return np.empty(0, dtype=np.int64)
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), 1)], dtype=np.uint64).view(np.int64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    n = len(h) - words + 1
    x = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        x += (h[i:i + n] ^ (h[i:i + n] >> np.uint64(31 - i))) * np.uint64(MULTIPLIERS[i % 5] + 2 * (i // 5))
    x ^= x >> np.uint64(33)
    x *= np.uint64(MULTIPLIERS[4])
    x ^= x >> np.uint64(29)
    return np.unique(x.view(np.int64))


def shared_floor(size: Column) -> Column:
    """Values of a union sketch of this size that linked documents share, ``SIGMAS`` standard deviations below the mean."""
    p = PERCENT / 100
    return F.greatest(F.lit(1), F.floor(size * p - SIGMAS * F.sqrt(size * (p * (1 - p))))).cast("int")


def _sketches(words: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            sets = [shingles(t.as_py() or b"", words) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 long_list([s[:k] for s in sets])], ["doc_id", "n", "digest", "sketch"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), long_list([shingles(t.as_py() or b"", words) for t in b.column(1)])], ["doc_id", "items"])

    return run


def union_passes(a: Column, b: Column, k: int) -> Column:
    """Whether enough of the ``k`` smallest values of the union are in both of two sorted sets."""
    low_a, low_b = F.slice(a, 1, k), F.slice(b, 1, k)
    low = F.slice(F.array_sort(F.array_union(low_a, low_b)), 1, k)
    return F.size(F.array_intersect(low, F.array_intersect(low_a, low_b))) >= shared_floor(F.size(low))


def confirm(pairs: DataFrame, sets: DataFrame, k: int = WIDE) -> DataFrame:
    """Pairs (u, v) that pass the union sketch and have 100 * intersection >= PERCENT * union of the full sets."""
    both = (pairs.join(sets.select(F.col("doc_id").alias("u"), F.col("items").alias("a")), "u")
            .join(sets.select(F.col("doc_id").alias("v"), F.col("items").alias("b")), "v")
            .filter(union_passes(F.col("a"), F.col("b"), k))
            .withColumn("same", F.size(F.array_intersect("a", "b"))))
    return materialize(both.filter(100 * F.col("same") >= PERCENT * (F.size("a") + F.size("b") - F.col("same")))
                       .select("u", "v").distinct(), "nd_links")


def overlap_floor(small: np.ndarray, large: np.ndarray, wide: int) -> np.ndarray:
    """Values that the sketches of linked sets share, by the sets' sizes.

    Of the larger set's sketch, the smaller set holds a share of
    intersection / large; at the threshold that is p / (1 + p) * (1 + small / large).
    """
    p = PERCENT / 100
    share = p / (1 + p) * (1 + small / large)
    size = np.minimum(large, wide)
    return np.maximum(1, np.floor(size * share - SIGMAS * np.sqrt(size * share * (1 - share))))


def block_pairs(comp: np.ndarray, n: np.ndarray, flat: np.ndarray, lens: np.ndarray, ok: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs (rows, rows) among ``ok`` of one block; ``flat`` holds the rows' sorted sketches one after another."""
    own = np.repeat(np.arange(len(n)), lens)
    _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    dense, keep = np.cumsum(often > 1) - 1, often[at] > 1
    marks = np.zeros((len(n), max(1, int((often > 1).sum()))), dtype=np.float32)
    marks[own[keep], dense[at[keep]]] = 1
    shared = marks @ marks.T  # whole numbers, at most ``wide``
    size = n.astype(np.float32)
    both = size[:, None] + size[None, :]
    whole = n <= wide
    exact = whole[:, None] & whole[None, :]
    i, j = np.nonzero(ok & exact & (100 * shared >= PERCENT * (both - shared)))
    if len(i):  # exact links: one for each two components
        two = np.stack([np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])])
        _, first = np.unique(two, axis=1, return_index=True)
        i, j = i[first], j[first]
    x, y = np.nonzero(ok & ~exact & (shared > 0))
    near = shared[x, y] >= overlap_floor(np.minimum(n[x], n[y]), np.maximum(n[x], n[y]), wide)
    return np.concatenate([i, x[near]]), np.concatenate([j, y[near]])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, k: int = K,
                    listed: int = LISTED, wide: int = WIDE) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of 0.75 or more.

    Returns one row per row of ``df``: doc_id, ``n_shingles`` (size of its set),
    ``component_id`` (smallest doc_id reachable by links, its own included),
    ``kept`` (doc_id = component_id).

    Edge cases: a null, empty or blank text has no shingles and links with
    nothing.  Rows with a null doc_id keep a null doc_id, are never kept, and
    have the component of equal texts if there are any (else null).  Rows that
    share a doc_id are one node.  An empty table gives no rows; other columns
    are ignored.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    rows = materialize(docs.mapInArrow(_sketches(words, k), "doc_id long, n long, digest binary, sketch array<long>"), "nd_sketches")

    # equal sets: one representative each
    classes = materialize(rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
                          .filter("copies > 1 and rep is not null").select("digest", "rep"), "nd_classes")
    named = rows.filter("n > 0").select("doc_id", "n", "digest").join(classes, "digest", "left")
    named = materialize(named.select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "nd_named")

    # inverted lists: values that several rows retain, of documents with enough of them
    held = rows.filter("n > 0 and doc_id is not null").select("doc_id", F.posexplode("sketch").alias("pos", "value"))
    often = materialize(held.groupBy("value").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("value"), "nd_values")
    mine = held.join(often, "value").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("common"),
        F.collect_set(F.when(F.col("pos") < listed, F.col("value"))).alias("values"))
    reps = named.filter("doc_id = rep").select("doc_id", "n").distinct()
    lists = materialize(
        mine.join(reps, "doc_id").filter(F.col("common") >= shared_floor(F.least("n", F.lit(k))))
        .select("doc_id", "n", F.explode("values").alias("value")), "nd_lists")
    first = materialize(lists.groupBy("value").agg(F.min(F.struct("doc_id", "n")).alias("first"), F.count(F.lit(1)).alias("members"))
                        .filter("members > 1"), "nd_firsts")
    lists = materialize(lists.join(first.select("value"), "value"), "nd_lists")
    ids = materialize(lists.select("doc_id").distinct(), "nd_ids")
    sets = materialize(docs.join(ids, "doc_id", "left_semi").mapInArrow(_sets(words), "doc_id long, items array<long>"), "nd_sets")

    # round 1: every document of a list with the smallest id of the list
    star = (lists.join(first, "value").filter("doc_id <> first.doc_id")
            .filter(100 * F.least("n", F.col("first.n")) >= PERCENT * F.greatest("n", F.col("first.n")))
            .select(F.col("first.doc_id").alias("u"), F.col("doc_id").alias("v")).distinct())
    links = confirm(materialize(star, "nd_star"), sets, wide)
    known = components(links).withColumnRenamed("node", "doc_id")

    # round 2: what is left between components
    part = materialize(lists.join(known, "doc_id", "left").select("value", "doc_id", "n", F.coalesce("component", "doc_id").alias("comp")), "nd_parts")
    mixed = materialize(part.groupBy("value").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("members"))
                        .filter("low < high").select("value", "members"), "nd_mixed")
    # the upper halves of the smallest hashes: in order, and distinct enough to filter by
    small = sets.select("doc_id", F.transform(F.slice("items", 1, wide), lambda x: F.shiftright(x, 32).cast("int")).alias("sketch"))
    dealt = tiles(part, "value", F.col("doc_id"), mixed, SIDE).join(small, "doc_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, ["value", "tile_i", "tile_j"]):
            doc, comp, n = (np.asarray(t[c]) for c in ("doc_id", "comp", "n"))
            ok = comp[:, None] != comp[None, :]
            ok &= doc[:, None] < doc[None, :]
            ok &= 100 * np.minimum(n[:, None], n[None, :]) >= PERCENT * np.maximum(n[:, None], n[None, :])
            if t["tile_i"][0].as_py() != t["tile_j"][0].as_py():
                chunk = np.asarray(t["chunk"])
                ok &= chunk[:, None] != chunk[None, :]
            if not ok.any():
                continue
            col = t["sketch"].combine_chunks()
            flat, lens = np.asarray(col.flatten()), np.diff(np.asarray(col.offsets))
            i, j = block_pairs(comp, n, flat, lens, ok, wide)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(doc[j])], ["u", "v"])

    more = (dealt.select("value", "tile_i", "tile_j", "chunk", "doc_id", "n", "comp", "sketch")
            .repartition("value", "tile_i", "tile_j").sortWithinPartitions("value", "tile_i", "tile_j")
            .mapInArrow(blocks, "u long, v long").distinct())
    links2 = confirm(materialize(more, "nd_more"), sets, wide)
    comp = merge_components(known.withColumnRenamed("doc_id", "node"), links2)
    out = named.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "n", F.coalesce("component", "rep").alias("component_id"))
    out = out.unionByName(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id",
                      F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
