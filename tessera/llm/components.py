"""Connected components of a graph of links, all in DataFrames.

In each round every node points to the least of itself and its neighbours, pointers are followed to their ends, and the links
are redrawn between the ends; links within one end vanish. The nodes that are left at least halve, so few rounds are needed, and
a node with any number of links is joined by a broadcast of the few hot nodes, not in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, join_hot, scratch


def _pointers(links: DataFrame) -> DataFrame:
    """node, up, links: each node with the least of itself and its neighbours."""
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    return both.groupBy("node").agg(F.least("node", F.min("other")).alias("up"), F.count("*").alias("links"))


def _ends(up: DataFrame) -> DataFrame:
    """The pointers followed until none leads further."""
    while True:
        n = up.count()
        sizes = up.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("under"))
        table = scratch(up.filter("up < node").select("node", F.col("up").alias("next")).join(sizes, "node"), "ends")
        if table.isEmpty():
            discard(table)
            return up
        new = join_hot(up.select(F.col("node").alias("v"), F.col("up").alias("node"), "links"), table, ["node"], "under", n, "left")
        new = scratch(new.select(F.col("v").alias("node"), F.coalesce("next", "node").alias("up"), "links"), "pointers")
        discard(up)
        discard(table)
        up = new


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for every node of links (a, b), written to scratch."""
    links = scratch(links.filter("a <> b").distinct(), "links")
    found = None
    while True:
        n = links.count()
        if not n and found is not None:
            discard(links)
            return found
        up = _ends(scratch(_pointers(links), "pointers"))
        if found is None:
            new = scratch(up.select("node", F.col("up").alias("component")), "components")
        else:
            weight = found.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("w"))
            table = scratch(up.select("node", "up").join(weight, "node"), "moves")
            moved = join_hot(found.withColumnRenamed("node", "v").withColumnRenamed("component", "node"), table, ["node"], "w", found.count(), "left")
            new = scratch(moved.select(F.col("v").alias("node"), F.coalesce("up", "node").alias("component")), "components")
            discard(table)
        if not n:
            discard(links)
            discard(up)
            return new
        point = up  # node, up, links
        once = join_hot(links.withColumnRenamed("a", "node"), point, ["node"], "links", n).select(F.col("up").alias("a"), F.col("b").alias("node"))
        drawn = join_hot(once, point, ["node"], "links", n).select("a", F.col("up").alias("b")).filter("a <> b")
        redrawn = scratch(drawn.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        discard(links)
        discard(up)
        discard(found)
        links, found = redrawn, new
