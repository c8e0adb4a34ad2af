"""Connected components of an edge table, by contraction.

Each round points every node at its least neighbour (or itself), shortens the pointers
until they reach roots, and replaces edges by edges between roots; rounds end when no
edge is left. Tables are written between steps, so that no step recomputes another,
lost executors cost only their tasks, and joins on a hot root can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import discard, written


def connect(edges: DataFrame) -> DataFrame:
    """edges: (a long, b long), undirected. Returns (node, component), component the least node of its component, for all nodes of edges."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label: DataFrame | None = None
    while True:
        point = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), "pointers")
        while True:
            to = point.select(F.col("u").alias("p"), F.col("p").alias("q"))
            step = written(point.join(to, "p").select("u", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            discard(point)
            moved = not step.where("moved").isEmpty()
            point = step
            if not moved:
                break
        if label is None:
            label = written(point.select(F.col("u").alias("node"), F.col("p").alias("component")), "labels")
        else:
            up = point.select(F.col("u").alias("component"), "p")
            old, label = label, written(label.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "labels")
            discard(old)
        left, right = point.select("u", F.col("p").alias("pu")), point.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        old, both = both, written(both.join(left, "u").select("v", "pu").join(right, "v").where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
        discard(old, point)
        if both.isEmpty():
            discard(both)
            return label
