"""Connected components of a link table, by alternating rounds over its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from jetframe.session import Shelf


def connected_components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it is connected with.

    Each round joins every node's neighbours to the smallest of its neighbourhood, first the larger
    ones (large star), then all (small star); the tables shrink to stars in a number of rounds
    logarithmic in the diameter. A node with very many links is combined on the map side, and the join
    on it can be split. Every round is a table on the ``shelf`` and takes the place of the one before;
    what stays there is the result.
    """
    edges = shelf.put(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    state = None
    while True:
        seen = Observation()
        following = _small_star(_large_star(edges)).observe(
            seen,
            F.count("*").alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("total"),
        )
        edges = shelf.put(following, edges)
        now = seen.get
        if now == state:
            break
        state = now
    own = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(own)
    return shelf.put(labels, edges)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    return (
        both.filter("other > node")
        .join(least, "node")
        .select(F.col("other").alias("a"), F.col("least").alias("b"))
        .filter("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    return (
        edges.join(least, "a")
        .select(F.explode(F.array("a", "b")).alias("x"), "least")
        .filter("x <> least")
        .select(F.col("x").alias("a"), F.col("least").alias("b"))
        .distinct()
    )
