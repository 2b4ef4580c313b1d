"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop_shuffles, join_hot


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component: its smallest node) for every node that has a link.

    Contracts the graph: each node points to its smallest neighbour, pointers
    are followed to their ends by doubling, and links between different ends
    remain, until none does; a chain of n nodes takes one round of log n
    doublings. Every step is a group-by with partial sums or a join of small
    rows, in which the nodes with most links are joined apart, by broadcast, so
    that no task gets all of one's; each step's table is cut off from its lineage. Self-links and repeated links are
    allowed; no links, no rows.
    """
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    home = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        step = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("to")).withColumnRenamed("a", "node"))
        moved = True
        while moved:
            jump = cut(join_hot(step, step.select(F.col("node").alias("to"), F.col("to").alias("end")), ["to"]).select("node", F.col("end").alias("to"), (F.col("end") < F.col("to")).alias("moved")))
            moved, step = not jump.where("moved").isEmpty(), jump.select("node", "to")
        left = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        edges = cut(join_hot(join_hot(edges, left, ["a"]), right, ["b"], counted=edges).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop_shuffles(edges.sparkSession)
        if home is None:
            home = step
        else:
            home = cut(join_hot(home, step.select(F.col("node").alias("to"), F.col("to").alias("next")), ["to"], "left").select("node", F.coalesce("next", "to").alias("to")))
    if home is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return home.select("node", F.col("to").alias("component"))
