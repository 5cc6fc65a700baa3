"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that an edge between two different nodes touches; component is the smallest node.

    Edges with a null end and loops are left out; direction and repetition don't matter. Each round writes every node's
    smallest neighbour first. If each node has only larger neighbours or a single smaller one, all components are stars and
    that table is the result; so a forest of stars takes no round, and no round is spent on seeing that nothing changes.
    Rounds are a few hash aggregations and joins; nothing of the graph reaches the driver but one node that isn't settled.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    e = materialize(e.where("x and y and u > v").select("u", "v"), "edges")
    for turn in range(max_rounds + 1):
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("far"))
        low = materialize(low.select("u", F.least("u", "m").alias("m"), F.expr("m > u or m = far").alias("done")), "lowest")  # written, so that Spark can split a hub's edges in the join
        if not low.where("not done").head(1):
            return low.select(F.col("u").alias("node"), F.col("m").alias("component"))
        if turn == max_rounds:
            break
        large = e.select(F.col("u").alias("w"), F.col("v").alias("u")).join(low.select("u", "m"), "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))), "large-star")
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialize(small.distinct(), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
