"""Connected components by contraction, with every step a join or an aggregate over the links that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.session import materialised


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`node`, `component` for every end of a link: the smallest node that links reach.

    Each round hangs every root below its smallest neighbour, shortens the paths, and replaces the ends of links by their
    roots; links inside a component vanish, so at least half of the roots that still have links go in each round. Links
    of one round are written to the shared folder, so lost executors cost no earlier round.
    """
    left = F.least(F.col(a), F.col(b)).cast("long").alias("a"), F.greatest(F.col(a), F.col(b)).cast("long").alias("b")
    edges = materialised(links.select(*left).distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    labels = None
    edges = edges.where("a <> b")
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("parent"))
        parents = _compressed(materialised(parents, "parents"))
        up = lambda df, name: df.join(parents.select(F.col("node").alias(name), F.col("parent").alias(f"{name}_root")), name, "left")
        moved = up(up(edges, "a"), "b").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = materialised(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("component"))
        else:
            over = parents.select(F.col("node").alias("component"), F.col("parent"))
            labels = labels.join(over, "component", "left").select("node", F.coalesce("parent", "component").alias("component"))
        labels = materialised(labels, "labels")
    if labels is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _compressed(parents: DataFrame) -> DataFrame:
    """Every node directly below its root; parents are smaller than their children, so there are no cycles."""
    while True:
        p = parents
        for k in range(2):
            hop = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            p = p.join(hop, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), *(["first"] if k else [F.col("parent").alias("first")]))
        q = materialised(p.select("node", "parent", (F.col("parent") != F.col("first")).alias("moved")), "parents")
        parents = q.select("node", "parent")
        if q.where("moved").isEmpty():
            return parents
