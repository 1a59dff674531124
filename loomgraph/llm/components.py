"""Connected components of an edge table by contraction; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of every node of ``links(a, b)``: component is the least node that is reachable.

    Each round points every node at its least neighbour, shortens the pointers twice and contracts the edges; the number of
    rounds grows with the logarithm of the nodes. Every round is a written table, so its lineage is short. No edges: no rows.
    """
    edges = C.staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    label: DataFrame | None = None
    for _ in range(most):
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = C.staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")), "up")
        for _ in range(2):
            over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
            up = up.join(over, "up").select("node", F.col("over").alias("up"))
        up = C.staged(up, "up")
        if label is None:
            label = up.select("node", F.col("up").alias("component"))
        else:
            step = up.select(F.col("node").alias("component"), F.col("up").alias("next"))
            label = C.staged(label.join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "labels")
        pa, pb = up.select(F.col("node").alias("a"), F.col("up").alias("x")), up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(pa, "a").join(pb, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()
        edges = C.staged(moved, "edges")
    else:
        raise RuntimeError("components: edges are left after all rounds")
    if label is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label
