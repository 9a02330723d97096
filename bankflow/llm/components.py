"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bankflow.llm.common import Staged


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge (columns ``a, b``); the root is the smallest node.

    Edges and labels stay distributed; each round is written and replaces the one before. Rounds grow with
    the logarithm of the largest component.
    """
    linked = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    state = Staged(linked.distinct(), "edges")
    print_before = None
    while True:
        both = state.df.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            state.df.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")
        ).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("hi"), F.col("m").alias("lo")
        )
        after = Staged(
            small.unionAll(lower.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct(), "edges"
        )
        state.drop()
        state = after
        found = state.df.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")
        ).first()
        if (found["n"], found["s"]) == print_before:
            break
        print_before = (found["n"], found["s"])
    nodes = state.df.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.unionAll(state.df.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
