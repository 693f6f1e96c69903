"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, label: the smallest node that the edges (integers, both ends not null) reach.

    In each round a node hooks onto its smallest smaller neighbour; the trees that this gives are made
    flat by following parents' parents, and edges are contracted to the trees' roots. Edges inside a
    tree are gone after their round, so a large group of direct neighbours of one node is read once.
    Every round's tables are in the shared folder; a round's parents are summed before they are shuffled.
    """
    x, y = F.col("x"), F.col("y")
    ends = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    rest = saved(ends.where("x < y").distinct(), "edges")
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node"))).distinct()
    found = nodes.withColumn("label", F.col("node"))
    while not rest.isEmpty():
        parents = saved(rest.groupBy(y.alias("child")).agg(F.min("x").alias("parent")), "parents")
        while True:
            further = parents.select(F.col("child").alias("via"), F.col("parent").alias("above"))
            higher = saved(parents.join(further, F.col("parent") == F.col("via"), "left").select("child", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
            parents = higher.select("child", "parent")
            if higher.where("moved").isEmpty():
                break
        found = saved(found.join(parents, F.col("label") == F.col("child"), "left").select("node", F.coalesce("parent", "label").alias("label")), "labels")
        # Every larger end has a parent; what it shares with the smaller end is gone before that one is looked up.
        outside = rest.join(parents, y == F.col("child")).select("x", F.col("parent").alias("y")).where("x <> y")
        roots = outside.join(parents, x == F.col("child"), "left").select(F.coalesce("parent", "x").alias("x"), "y").where("x <> y")
        rest = saved(roots.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "edges")
    return found
