"""Connected components of a table of links, by Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the smallest id reachable.

    Rounds of two steps until only stars are left: every id is linked to the smallest of
    its neighbours with it ("large star" over larger ones, "small star" over smaller
    ones), which keeps components and shortens paths, so rounds grow with the logarithm
    of the size. Neighbourhoods are reduced to their minimum before a shuffle and
    never gathered; every round is written.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(least, "a")
        if large:
            moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                least.where("a <> m").select("a", F.col("m").alias("b")))
        return moved.where("a <> b").distinct()

    edges = written(links.where("a <> b").select("a", "b").distinct(), "links")
    while True:
        edges = written(star(star(edges, True), False), "links")
        # Done when no id has two links, or links both ways: then all are stars, and since
        # links lead to smaller ids, around their smallest.
        ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("b").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.agg(F.count_if((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1)))).first()[0]:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
