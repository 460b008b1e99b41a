"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Each round points every node at its smallest neighbour, follows the pointers once more, and replaces each edge's
    ends by what they point at; loops and repeats go. The smallest node of a component always points at itself, so it
    is what is left. Every round is written to the shared folder: the lineage stays one round long, and an executor's
    loss costs its tasks only. Rounds end when no edge is left.
    """
    live = scratch.materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = scratch.materialize(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "nodes")
    while not live.isEmpty():
        both = live.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*")
        first = scratch.materialize(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("p")), "pointers")
        second = first.select(F.col("u").alias("mid"), F.col("p").alias("far"))
        jumped = scratch.materialize(first.join(second, F.col("p") == F.col("mid")).select("u", F.col("far").alias("p")), "jumped")
        by = lambda end: jumped.select(F.col("u").alias(end), F.col("p").alias(f"{end}_to"))  # noqa: B023, E731
        moved = live.join(by("a"), "a").join(by("b"), "b").where("a_to <> b_to")
        live = scratch.materialize(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
        found = scratch.materialize(found.join(jumped.select(F.col("u").alias("root"), "p"), "root", "left").select("node", F.coalesce("p", "root").alias("root")), "nodes")
    return found
