"""Connected components of an edge table, by alternating star contractions on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node of an edge the smallest node that it is connected with.

    Each round links every larger neighbour to the smallest one (large star), then every smaller neighbour likewise (small
    star); the edge set shrinks to stars in a logarithmic number of rounds. Rounds are written to the shared folder, so the
    lineage stays short and nothing is gathered on the driver. Minima are taken before the shuffle; the joins back are plain
    sort-merge joins that adaptive execution can split at a hot node.
    """
    pairs = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u <> v").distinct()
    state = materialize(pairs, "components")
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v").alias("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        after = materialize(small.where("u <> v").distinct(), "components")
        same = state.count() == after.count() and state.exceptAll(after).isEmpty()
        discard(state)
        state = after
        if same:
            break
    roots = state.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
