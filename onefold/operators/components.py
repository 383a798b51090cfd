"""Connected components by alternating stars, over any number of links.

Each round hangs every node's larger neighbours on the least node near it (large star), then every node's smaller
neighbours (small star). All is grouping by a node with partial sums and joins that Spark can split, so a node with
very many links is no hot spot; the driver sees three numbers a round. Each round's links are a scratch table, so a
lost executor costs one round at most. What a round groups to find the least nodes also tells whether all is settled and,
once it is, the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.scratch import joined, written


def _nearest(links: DataFrame) -> DataFrame:
    """(u, m, unsettled, n) of every node: the least of it and its neighbours, whether it has a smaller neighbour and another, its links."""
    both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    found = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))
    return found.select("u", F.least("low", "u").alias("m"), F.expr("low < u and low < high").alias("unsettled"), "n")


def _stars(links: DataFrame, nearest: DataFrame, repeated: bool) -> DataFrame:
    """One large and one small star over links (hi, lo) with hi > lo. Links come out no more often than they go in, each once if `repeated`."""
    # written, as are the nearest, so that both joins have a plain shuffle on either side, whose large partitions Spark can split
    large = written(joined(links, nearest.select(F.col("u").alias("lo"), "m"), "lo").select("hi", F.col("m").alias("lo")), "large")
    near = written(large.groupBy("hi").agg(F.min("lo").alias("m")), "near")
    hung = joined(large, near, "hi").select(F.when(F.col("lo") > F.col("m"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("m").alias("lo"))
    return hung.distinct() if repeated else hung


def components(links: DataFrame, left: str, right: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node that `links` joins to another; component is its least reachable node.

    Links are undirected, may repeat, and may be in either order. Links with a null end, or of a node with itself,
    join nothing; nodes without links have no row; an empty table gives no rows.
    """
    a, b = links[left], links[right]
    links = written(links.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi is not null and lo is not null"), "links")
    for _ in range(rounds):
        nearest = written(_nearest(links), "nearest")
        seen = nearest.agg(F.max("unsettled").alias("unsettled"), F.sum("n").alias("ends"), F.count("*").alias("nodes")).first()
        if not seen.unsettled:
            return nearest.select(F.col("u").alias("node"), F.col("m").alias("component"))
        links = written(_stars(links, nearest, seen.ends > 4 * seen.nodes), "links")  # more than two links a node
    raise RuntimeError(f"no components after {rounds} rounds")
