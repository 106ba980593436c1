"""Connected components of an edge table by alternating large-star and small-star.

Every step is a minimum per node, joined back to the edges: a node with any
number of neighbours is a pre-aggregated minimum on one side and a join key that
Spark's skew join can split on the other. No neighbour list is ever collected. The
edges of a round are written to the shared folder, so lineage stays short and a
lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize


def _starred(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with the least neighbour of u, or u itself, as m."""
    # Written, so that the join below meets two plain exchanges and can split a hot node.
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    told = _starred(down)
    return (told.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(told.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; the root is the least node reachable.
    Nodes without an edge to another node have no row. Null ends are no edge."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "edges")
    mark, last = _print(e), None
    while mark != last:
        e = materialize(_small_star(_large_star(e)), "edges")
        last, mark = mark, _print(e)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
