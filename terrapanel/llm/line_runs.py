"""Line deduplication against levelled sorted runs of line hashes.

Method: the store of lines seen so far is a list of runs, tables of 128-bit line
hashes sorted by hash.  Each new batch of documents merge-anti-joins its own
lines with the runs: lines found there are repeats; the rest are new, belong to
the batch's smallest document that holds them, and become a new run.  When a
level has ``FANOUT`` runs they are merged into one run of the next level, so a
store of n batches holds about ``FANOUT * log(n)`` runs and rewrites each hash
once per level.

Only DataFrame operations run.  Texts are read twice: once for the hashes of
their lines, which are written by batch, and once to drop the repeated lines.  A
line that a third of all documents hold is one row per task after partial
aggregation.  Documents meet the positions of their dropped lines in a join on
the document; texts are never exploded into shuffled lines.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.common import materialize, with_row
from terrapanel.session import checkpoint_dir

MIN_CHARS = 10
FANOUT = 4
BATCHES = 4
#: Bytes stripped at both ends of a line's key.
BLANKS = "\t\n\x0b\x0c\r "
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line with blanks stripped at both ends and A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(BLANKS)), _UPPER, _LOWER)


class LineRuns:
    """The levelled store.  ``levels[i]`` lists the runs of level i, oldest first."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def without_known(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...) that no run holds."""
        for run in self.runs():
            keys = keys.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, keys: DataFrame) -> None:
        """Add the distinct hashes (h1, h2), none of them in a run yet, as a run; compact full levels."""
        new = materialize(keys.select("h1", "h2").sortWithinPartitions("h1", "h2"), "line_run")
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)
            self.levels[level] = []
            parts = max(1, self.spark.sparkContext.defaultParallelism)
            new = materialize(merged.repartition(parts, "h1", "h2").sortWithinPartitions("h1", "h2"), "line_run")


def _key_columns(id_col: str, text_col: str) -> dict[str, Column]:
    """did: the id (null: after all others); tag: a hash that tells rows of one id apart; lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {"did": F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)), "tag": F.xxhash64(text), "lines": F.split(text, "\n", -1)}


def line_hashes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(did, tag, pos, h1, h2): every line whose key has at least ``min_chars`` code points, by a 128-bit hash of the key.

    The hash of one argument is the seed of the next: with the constant first,
    h2 runs over the key with a seed of its own; with the key first it would
    follow from h1.
    """
    lines = docs.select(*[c.alias(k) for k, c in _key_columns(id_col, text_col).items()])
    return (lines.select("did", "tag", F.posexplode("lines").alias("pos", "line"))
            .withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
            .select("did", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), "key").alias("h2")))


def dedup_batch(hashes: DataFrame, store: LineRuns) -> DataFrame:
    """Find the batch's repeated lines and add its new ones to ``store``.

    ``hashes``: ``line_hashes`` of documents whose ids exceed those of earlier
    batches.  Returns (did, tag, drop: positions of repeated lines), for documents
    that have any.
    """
    owner = hashes.groupBy("h1", "h2").agg(F.min("did").alias("first"), F.max("did").alias("last"))
    if store.runs():
        owner = materialize(owner, "line_keys")
        new = materialize(store.without_known(owner), "line_new")
        seen = owner.join(new.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        repeated = new.filter("first < last").unionByName(seen.withColumn("first", F.lit(None).cast("long"))).select("h1", "h2", "first")
    else:
        new = materialize(owner, "line_new")
        repeated = new.filter("first < last").select("h1", "h2", "first")
    repeated = materialize(repeated, "line_repeated")
    drops = (hashes.join(repeated.hint("merge"), ["h1", "h2"]).filter("first is null or did <> first")
             .groupBy("did", "tag").agg(F.collect_set("pos").alias("drop")))
    drops = materialize(drops, "line_drops")
    store.add(new)
    return drops


def drop_lines(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_lines, n_dropped, kept_text): the documents without the lines at the positions in ``drops``."""
    split = with_row(docs, **_key_columns(id_col, text_col))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    text = F.when(F.col("drop").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.element_at("lines", i + 1)), "\n"))
    return (split.drop("lines").join(drops.hint("merge"), ["did", "tag"], "left")
            .withColumn("lines", F.split(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")), "\n", -1))
            .select("row", F.size("lines").cast("long").alias("n_lines"),
                    F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), text.alias("kept_text")))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Deduplicate all lines of ``docs``, taken in ``batches`` ranges of the id, smallest ids first.

    A key of at least ``min_chars`` code points found in two documents or more
    loses its lines everywhere but in the smallest id that holds it (all of them
    stay there).  Returns (row, n_lines, n_dropped, kept_text).

    Edge cases: a null or empty text is one empty line.  A null id counts as one
    document after all others.  Rows that share an id are one document.  An empty
    table gives no rows.  The input row is carried whole as ``row``, so extra
    columns can't clash.
    """
    spark = docs.sparkSession
    cuts = []
    if batches > 1:  # where the batches part; the result does not depend on it
        shares = ", ".join(str(i / batches) for i in range(1, batches))
        ids = docs.select(F.expr(f"percentile_approx(cast(`{id_col}` as bigint), array({shares}), 1000)").alias("c"))
        cuts = sorted({int(x) for x in ids.first()["c"] or []})
    batch = sum((F.when(F.col("did") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/line_hashes-{uuid.uuid4().hex}"
    hashes = line_hashes(docs, id_col, text_col, min_chars).withColumn("batch", batch)
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    store = LineRuns(spark, fanout)
    drops = dedup_batch(hashes.filter("batch = 0").drop("batch"), store)
    for b in range(1, len(cuts) + 1):
        drops = drops.unionByName(dedup_batch(hashes.filter(F.col("batch") == b).drop("batch"), store))
    return drop_lines(docs, drops, id_col, text_col)
