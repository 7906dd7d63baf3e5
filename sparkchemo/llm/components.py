"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkchemo.llm.common import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of the stored ``edges``, whose table goes: neighbours hang on the least of a node's neighbours and itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Read from a table, so that the planner can split a hub's rows in the join.
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "component-least")
    hung = both.join(least, "a")
    if large:  # larger neighbours go to the least
        out = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # smaller neighbours and the node itself go to the least
        out = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b")
    out = stored(out.distinct(), "component-edges")
    release(edges, least)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): each node of ``edges`` and the least node it reaches; rounds grow with the log of the nodes.

    Loops and repeated edges are allowed, null ends are dropped; no edges give no rows. Sums
    before shuffles are partial, so a hub sends a row per task; each round is written
    to the shared folder.
    """
    edges = edges.select(F.col(a).cast("bigint").alias("a"), F.col(b).cast("bigint").alias("b")).where("a is not null and b is not null")
    loops = edges.where("a = b").select(F.col("a").alias("id"))
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-edges")
    seen = None
    for _ in range(max_rounds):
        edges = _star(_star(edges, True), False)
        mark = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("id")).distinct()
    alone = loops.distinct().join(found.select("id").union(roots), "id", "left_anti")
    return found.union(roots.union(alone).select("id", F.col("id").alias("component")))
