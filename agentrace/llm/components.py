"""Connected components of an edge table, by contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agentrace.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label`` for every node of an edge; equal labels mean that a path connects them.

    In every round each node moves to the smallest of itself and its neighbours, and the edges move
    along, so each component shrinks until one node is left. Names should be in random order
    (hashes), which makes the number of rounds logarithmic. Minima are combined in each task before
    the shuffle, so a node with very many edges is no hot key there. A round's edges and moves are
    written to the checkpoint folder. Loops and null names are ignored; no edges give no rows.
    """
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
    links = materialize(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a != b").distinct(), "links"
    )
    names = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = names.withColumn("label", F.col("node"))
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        moves = materialize(
            both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")),
            "moves",
        )
        to_a = moves.select(F.col("a").alias("_a"), F.col("to").alias("to_a"))
        to_b = moves.select(F.col("a").alias("_b"), F.col("to").alias("to_b"))
        links = materialize(
            links.join(to_a, links.a == to_a["_a"])
            .join(to_b, F.col("b") == to_b["_b"])
            .select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))
            .where("a != b")
            .distinct(),
            "links",
        )
        labels = (
            labels.join(to_a, labels.label == to_a["_a"], "left")
            .select("node", F.coalesce("to_a", "label").alias("label"))
        )
    return labels
