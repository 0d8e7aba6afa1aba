"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholion.functions.shared import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (a, b): each node with the least node that it can reach.

    In a round each node points to its least neighbour, pointers are followed twice, and the
    edges move on to where their ends point; a path of n nodes takes about log n rounds.  Edges
    within a component go, so the table shrinks from round to round.
    """
    edges = cut_lineage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "component-edges")
    where = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("to")), "component-to")
        for _ in range(2):
            to = cut_lineage(to.join(to.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")), "component-to")
        moved = to.select(F.col("node").alias("component"), "to")
        if where is None:
            where = to.select("node", F.col("to").alias("component"))
        else:
            where = cut_lineage(where.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "component-where")
        one, two = (to.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        ends = edges.join(one, "a").join(two, "b").where("to_a <> to_b")
        edges = cut_lineage(ends.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "component-edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if where is None else where
