"""Connected components of a graph of links, in rounds of stars, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stage

#: Links that a task of a round handles about.
TASK_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns a, b of one type): root is the
    least node it is joined with.

    Each round hangs every node's larger neighbours on its least neighbour, then its
    smaller ones (large and small stars), until every node hangs on a root alone; the
    rounds needed grow with the logarithm of the graph, and each is written to the shared
    folder.  Least neighbours come from aggregates that combine before the shuffle, so a
    node with many links is no hot spot.  Tasks follow the number of links.
    """
    edges = stage(_tidy(links))
    while True:
        n, tangled = _state(edges)
        if not tangled:
            break
        tasks = n // TASK_LINKS + 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _tidy(large.coalesce(tasks)).coalesce(tasks)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").coalesce(tasks)
        hung = F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = stage(_tidy(small.select(F.explode(hung).alias("e")).select("e.*")).coalesce(tasks))
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, the larger node first, none from a node to itself."""
    return links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    """The links, and the nodes that hang on two others or both hang and hold."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    row = each.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return row[0], row[1]
