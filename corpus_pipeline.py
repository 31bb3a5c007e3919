"""Corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet into the shared checkpoint folder and hands the
reread table to the next.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm import line_runs, minhash_bottomk, packing, pairwise_quality, pivotal_mix
from terrapanel.llm.common import materialize, with_row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on the labelled documents outside the held-out rows."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    scored = pairwise_quality.score(docs, pairwise_quality.train(docs, labels))
    return scored.filter(F.col("score") >= pairwise_quality.CUT).select("row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a smaller doc_id holds too; ``n_chars`` follows the text. No document goes."""
    done = line_runs.dedup_lines(docs)
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text")),
           "n_chars": F.when(F.col("row.n_chars").isNotNull(), F.length("kept_text")).cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (a null id only if none has one).

    Every row is a node of its own by a number written with it, so rows without
    a doc_id, or with one that others have too, are grouped by their texts like all others.
    """
    rows = materialize(with_row(docs, node=F.monotonically_increasing_id()), "pipeline_rows")
    groups = minhash_bottomk.near_duplicates(rows.select("node", F.col("row.text").alias("text")), id_col="node")
    groups = materialize(groups.select("node", "component_id"), "pipeline_groups")
    several = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component_id")
    member = groups.join(several, "component_id").join(rows.select("node", F.col("row.doc_id").alias("doc_id")), "node")
    member = materialize(member, "pipeline_members")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"].alias("first"))
    gone = materialize(member.join(first, "component_id").filter("node <> first").select("node"), "pipeline_gone")
    return rows.join(gone, "node", "left_anti").select("row.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return pivotal_mix.mixed(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
          ("mixing sources", mixture), ("best-fit packing", sequences)]

#: The classifier's fit and the rounding draws have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name.replace(' ', '_')}")
    return docs
