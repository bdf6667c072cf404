"""Connected components by alternating large-star and small-star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of itself and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them. Edges point from larger to smaller."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _mark(edges: DataFrame) -> tuple:
    """Equal marks: the same set of edges (count and sum of hashes)."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``) for every node that has an edge; the component is its smallest node.

    Repeated edges and self loops are allowed. Each step has a shuffle on the nodes with map-side minima, so that a
    node with very many neighbours is reduced before it moves; every round is written to the shared folder.
    The number of rounds grows with the logarithm of the number of nodes.
    """
    ordered = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    ordered = written(ordered, "components")
    mark = _mark(ordered)
    while mark[0]:
        ordered = written(_small_star(_large_star(ordered).distinct()).distinct(), "components")
        before, mark = mark, _mark(ordered)
        if before == mark:
            break
    heads = ordered.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(heads).distinct()
