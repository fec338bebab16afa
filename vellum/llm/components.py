"""Connected components of an edge table by repeated contraction.

Every round maps each node to the smallest of itself and its neighbours (a map-side combined
``min``) and rewrites the edges with that map; edges inside a component vanish. A star collapses in
one round and rounds grow with the logarithm of the longest chain. Tables are written between
rounds, and both sides of every join are plain shuffles, so adaptive execution can split a hot node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import free, persist


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges (a, b)`` to ``(node, root)`` for every node on an edge; root is one node of its component."""
    edges = persist(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    total = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = persist(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")), "step")
        if total is None:
            total = persist(step.withColumnRenamed("to", "root"), "roots")
        else:
            moved = total.join(step.withColumnRenamed("node", "root"), "root", "left")
            total, old = persist(moved.select("node", F.coalesce("to", "root").alias("root")), "roots"), total
            free(old)
        a, b = (step.select(F.col("node").alias(x), F.col("to").alias(f"{x}2")) for x in ("a", "b"))
        half = edges.join(a, "a").select("a2", "b")
        mapped = half.join(b, "b").where("a2 <> b2")
        edges, old = persist(mapped.select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct(), "edges"), edges
        free(old, step)
    if total is None:
        total = persist(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots")
    free(edges)
    return total
