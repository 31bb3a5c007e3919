"""Connected components of a distributed edge list by hooking and contraction.

Each round hooks every node to its smallest neighbour (or itself), follows the
hooks to their roots by repeated squaring, and replaces both ends of each edge
by their roots; edges within a root go.  A root that keeps an edge hooks in the
next round, so the roots of a component at least halve and rounds grow with the
logarithm of the nodes.  A node's component is where the rounds' hooks lead, the
smallest id of all.

Every step is a grouped minimum (pre-aggregated, so a hub of many edges costs
one row per task) or an equi-join of written tables, which Spark can split at a
hub; lineage is cut by tables in the shared checkpoint folder.  No edge reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.common import materialize

ROUNDS = 64


def _hooks(e: DataFrame) -> DataFrame:
    """(node, root): where following each node's smallest neighbour ends."""
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hook = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "cc_hooks")
    for _ in range(ROUNDS):
        nxt = hook.select(F.col("node").alias("root"), F.col("root").alias("next"))
        far = hook.join(nxt, "root").select("node", "root", "next")
        if far.filter("root <> next").isEmpty():
            return hook
        hook = materialize(far.select("node", F.col("next").alias("root")), "cc_hooks")
    raise RuntimeError("hooks did not end")


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``u``, ``v`` (long, either order, repeats and loops allowed).

    Returns (node, component): every node that has an edge to another node, with
    the smallest id reachable.  Null ends are ignored; no edges give no rows.
    """
    e = materialize(edges.select("u", "v").filter("u is not null and v is not null and u <> v"), "cc_edges")
    out = None
    for _ in range(ROUNDS):
        if e.isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")) if out is None else out
        hook = _hooks(e)
        step = hook.select(F.col("node").alias("component"), F.col("root").alias("next"))
        if out is None:
            out = hook.withColumnRenamed("root", "component")
        else:
            out = out.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            out = materialize(out, "cc_nodes")
        a, b = hook.select(F.col("node").alias("u"), F.col("root").alias("a")), hook.select(F.col("node").alias("v"), F.col("root").alias("b"))
        e = materialize(e.join(a, "u").join(b, "v").filter("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")), "cc_edges")
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")


def merge_components(known: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, component) after more ``edges`` (u, v) between their nodes or new ones."""
    name = lambda c, to: known.select(F.col("node").alias(c), F.col("component").alias(to))
    between = (edges.join(name("u", "a"), "u", "left").join(name("v", "b"), "v", "left")
               .select(F.coalesce("a", "u").alias("u"), F.coalesce("b", "v").alias("v")))
    more = components(between)
    if more.isEmpty():
        return known
    old = known.join(more.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left")
    old = old.select("node", F.coalesce("next", "component").alias("component"))
    new = more.join(known.select("node"), "node", "left_anti")
    return materialize(old.unionByName(new.select("node", "component")), "cc_nodes")
