"""Connected components of a graph of links, by alternating large and small stars, each a min-aggregation and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, sized, written

ROWS_EACH = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that can be reached.

    Neighbours are never gathered: a node's smallest neighbour is an aggregation with map-side combine, and handing it
    to the others is an equi-join that adaptive execution splits where a node has very many links. Rounds follow the
    logarithm of the longest path.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFFFF)))).first()
        if now == before or not now[0]:
            return links.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
        before = now
        last, links = links, written(sized(_star(_star(links, large=True), large=False), now[0], ROWS_EACH), "links")
        remove(last)


def merged(family: DataFrame, edges: DataFrame) -> DataFrame:
    """Components (node, comp) with further links (a, b): only the components that they tie are gone through again."""
    side = lambda end: family.select(F.col("node").alias(end), F.col("comp").alias("comp_" + end))
    ties = edges.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))
    told = components(ties)
    alone = told.select("node", F.col("node").alias("comp")).join(family, "node", "left_anti")
    return family.unionByName(alone).join(told.select(F.col("node").alias("comp"), F.col("comp").alias("last")), "comp", "left").select("node", F.coalesce("last", "comp").alias("comp"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links are (a, b) with a < b. Large: every larger neighbour of a node is linked to the smallest of the node's
    neighbours and itself. Small: the same for its smaller neighbours and itself."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = links.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        out = moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.filter("a <> b").distinct()
