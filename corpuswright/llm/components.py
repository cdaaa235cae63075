"""Connected components of a distributed graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, table, view


def _roots(parents: DataFrame, rows: int) -> DataFrame:
    """node, root: parents (node, parent; parent <= node) followed to the end, doubling the step each time."""
    held = table(parents.select("node", F.col("parent").alias("root")), "roots", rows)
    while True:
        up = held.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        more = table(held.join(up, "root").select("node", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("_moved")), "roots", rows)
        remove(held)
        held = view(more.select("node", "root"), more)
        if not more.where("_moved").head(1):
            return held


def merge(labels: DataFrame | None, edges: DataFrame) -> DataFrame | None:
    """labels (node, root: the smallest node of its component; nodes without links may be absent) after more edges (a, b).

    The tables edges and labels are removed. Each round every node joins its smallest neighbour, chains are followed to
    their ends, and the edges move to the ends; a component at least halves in each round. Hubs are aggregated before the shuffle or meet in joins only, which Spark
    splits where one key is large. Every step is a table in the shared folder.
    """

    def move(links: DataFrame, roots: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            to = roots.select(F.col("node").alias(end), F.col("root").alias("_to"))
            links = links.join(to, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    links, n = edges.select("a", "b"), edges.count()  # n bounds all links to come, 2 n the nodes
    held = 0 if labels is None else labels.count()
    links = table(move(links, labels) if labels is not None else links.where("a <> b").distinct(), "links", n)
    remove(edges)
    while links.head(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        roots = _roots(least.select("node", F.least("node", "_least").alias("parent")), 2 * n)
        if labels is None:
            labels = roots
        else:
            to = roots.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            moved = labels.join(to, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
            new = roots.join(labels.select("node"), "node", "left_anti")
            before, labels = labels, table(moved.unionByName(new), "labels", held + 2 * n)
            remove(before)
        left = table(move(links, roots), "links", n)
        remove(links, None if labels is roots else roots)
        links = left
    remove(links)
    return labels
