"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.sources.workspace import settle


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(both: DataFrame, keep) -> DataFrame:
    """Hang the neighbours of each node that ``keep`` on its smallest one."""
    least = settle(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))  # a table, so that a hot side can be split
    return both.join(least, "u").where(keep).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node of its component) for all nodes of the edges ``u``, ``v`` (longs).

    Edges with a null end and loops are ignored; an empty table gives an empty one. The steps are aggregates and joins
    with that aggregate, so a node with very many neighbours is split by adaptive execution. Every round is written to
    the shared folder. The number of rounds grows with the logarithm of the longest path.
    """
    edges = settle(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, F.col("v") > F.col("u"))
        large = settle(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        small = _star(large, F.col("v") < F.col("u"))
        small = small.unionByName(large.groupBy("u").agg(F.min("v").alias("v")))
        edges = settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return leaves.unionByName(roots)
