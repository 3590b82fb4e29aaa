"""Connected components over a table of links, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, tables: common.Tables) -> DataFrame:
    """``node, root`` of every node of ``links`` (a long, b long): the smallest node it is linked with, over any
    number of steps. Self-links and repeated links are welcome.

    Each round hangs every node on the smallest one it sees; the number of rounds grows with the logarithm of
    the longest path. Every round is written to the shared folder. A node with very many links is met by partial
    aggregation and a join, never gathered; what a join takes from an aggregation is written first, so that adaptive execution can split such a node.
    """
    edges = tables.written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    while True:
        # large star: larger neighbours of a node move to the smallest it knows
        both = edges.union(edges.select("b", "a"))
        low = tables.written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), "components")
        edges = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours of a node, and it, move to the smallest of them
        edges = tables.written(edges, "components")
        low = tables.written(edges.groupBy("a").agg(F.min("b").alias("low")), "components")
        edges = edges.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low).filter("a <> b").distinct()
        edges = tables.written(edges, "components")
        # done when every node hangs on one root, and no root on another node
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds")).filter("hangs > 1 OR (hangs > 0 AND holds > 0)").isEmpty():
            break
    return nodes.join(edges.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
