"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollway.llm.columns import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b); the component is its least node.

    Large and small stars by turns: every node's larger neighbours are linked to its least one,
    then its smaller ones. Each round is a table in the shared folder, and a node's neighbours are
    only ever reduced to their least, so hot nodes cost no more than their links.
    """
    edges = store(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        after = store(small, "edges")
        if after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty():
            break
        edges = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionAll(centres)
