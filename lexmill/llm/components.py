"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two partially aggregated group-bys and joins over the edge table; nothing is gathered on the driver
but a row count and a checksum. Hubs are safe: the minimum of a hub is combined before the shuffle, and is then sent to the hub's
edges by broadcast, so they stay where they are; only edges of nodes that hold a small share of all edges are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import join_hot
from lexmill.session import Scratch


def _star(edges: DataFrame, small: bool, total: int) -> DataFrame:
    """edges: (a, b), a > b. Small: connect a and its smaller neighbours to their minimum; large: the larger ones."""
    if small:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    else:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = join_hot(sides, least, "u", total).select("u", "v", F.least("m", "u").alias("m"))
    if small:
        linked = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        linked = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return linked.where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) for every node of a (null-free) edge table; label is the least node of its component.

    Nodes may be of any orderable type. Self-links and repeated edges change nothing; an empty table gives an empty one.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    scratch = Scratch(edges.sparkSession)
    edges = scratch.write(edges, "components")
    state = None
    while True:
        check = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == check or not check[0]:
            break
        state = check
        large = scratch.write(_star(edges, False, 2 * check[0]), "components")
        last, edges = edges, scratch.write(_star(large, True, check[0]), "components")
        scratch.drop(last, large)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
