"""Connected components of an undirected graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lineage import cut


def connected_components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for each node of the (a, b) edges; the root is the least node of its component.

    Each round every node joins the neighbour (or itself) that comes first in a
    hashed order of that round, and the graph is contracted. The order is random,
    so a constant share of the nodes vanishes whatever the shape of the graph,
    and a round works on what is left of the edges.
    """
    left = cut(edges.select("a", "b").where("a != b").distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        if len(rounds) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.select("a", F.explode(F.array("a", "b")).alias("b"))
        joined = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.struct(F.xxhash64("b", F.lit(len(rounds))), "b")).alias("to"))
        joined = cut(joined)
        rounds.append(joined)
        a = joined.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = joined.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        left = cut(left.join(a, "a").join(b, "b").where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last and smallest round back to the first.
    labels = rounds[-1]
    for earlier in reversed(rounds[:-1]):
        after = labels.select(F.col("node").alias("to"), F.col("to").alias("final"))
        labels = earlier.join(after, "to", "left").select("node", F.coalesce("final", "to").alias("to"))
    labels = cut(labels)
    roots = labels.groupBy("to").agg(F.min("node").alias("root"))
    return labels.join(roots, "to").select("node", "root")
