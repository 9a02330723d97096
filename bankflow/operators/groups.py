"""Groups of rows that are connected through equal values of any of several key columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.sinks.staged import Staging

MAX_ROUNDS = 100


def star_edges(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """An edge from every node to the smallest node with the same value, for each key: ``u, v``.

    A value shared by many rows gives one edge a row, never a pair of any two.
    """
    edges = []
    for key in keys:
        named = rows.filter(F.col(key).isNotNull() & F.col(node).isNotNull())
        named = named.select(F.col(node).alias("u"), F.col(key).alias("_key"))
        least = named.groupBy("_key").agg(F.min("u").alias("v"))
        edges.append(named.join(least, "_key").filter("u <> v").select("u", "v"))
    return reduce(DataFrame.unionByName, edges).distinct()


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges with the least node among ``u`` and all its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_v"))
    return edges.join(least.select("u", F.least("u", "_v").alias("_least")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node below the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("_least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours below the least of them."""
    # Edges point from the larger to the smaller node.
    hung = _least_neighbour(edges)
    below = hung.filter("v <> _least").select(F.col("v").alias("u"), F.col("_least").alias("v"))
    return below.unionByName(hung.select("u", F.col("_least").alias("v"))).filter("u <> v")


def connected_groups(rows: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """``node`` and ``group_id``, the smallest node reachable over equal keys, for nodes in groups of two or more.

    Rows with a NULL key are not connected by it. Alternates large and small stars (Kiveris et al. 2014), which
    halves distances: the rounds grow with the logarithm of the longest chain, not with its length. Each
    round is one staged table, which cuts the plan and survives lost executors; only its row count and a
    checksum, observed as it is written, reach the driver.
    """
    staging = Staging(rows.sparkSession)
    edges = staging.write(star_edges(rows, node, keys), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        figures = {
            "edges": F.count(F.lit(1)),
            "checksum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        }
        step = Staging(rows.sparkSession)
        starred = step.write(_small_star(_large_star(edges)).distinct(), "edges", **figures)
        staging.drop()
        staging, edges = step, starred
        if step.figures == before:
            break
        before = step.figures
    else:
        raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")
    members = edges.select(F.col("u").alias(node), F.col("v").alias("group_id"))
    heads = edges.select(F.col("v").alias(node), F.col("v").alias("group_id")).distinct()
    return members.unionByName(heads)
