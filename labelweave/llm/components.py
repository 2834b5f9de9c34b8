"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.scratch import settle


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by one of its nodes.

    Each round maps every node to its smallest neighbour or itself and contracts the links; a star is done in
    one round, a chain in about the logarithm of its length. Rounds are stored, so lineage stays short.
    """
    edges = settle(links.filter("a != b").select("a", "b").distinct(), "links")
    found = settle(
        edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "nodes"
    )
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = settle(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")), "pointers")
        left = to.select("a", F.col("to").alias("to_a"))
        right = to.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = settle(
            edges.join(left, "a")
            .join(right, "b")
            .filter("to_a != to_b")
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .distinct(),
            "links",
        )
        step = to.select(F.col("a").alias("component"), "to")
        found = settle(
            found.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "nodes"
        )
    return found
