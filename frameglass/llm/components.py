"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path


def _written(df: DataFrame, label: str) -> DataFrame:
    """The table written to the shared folder and read back: lineage ends, and lost executors cost nothing."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to its smallest one."""
    both = edges.select(F.col("node").alias("u"), F.col("root").alias("v")).union(edges.select("root", "node"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of these."""
    least = edges.groupBy("node").agg(F.min("root").alias("m"))
    moved = edges.join(least, "node").filter("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
    return moved.union(least.select("node", F.col("m").alias("root"))).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has another."""
    ends = edges.select(F.col("node").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("root", F.lit(0), F.lit(1))
    )
    sums = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.filter("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of any integers: (node, root) for every node that is not the smallest of its component.

    Repeated edges and loops are allowed. Minima of a node of very many edges are combined before
    they are moved; its edges meet in one task where the join with these minima is not split by adaptive execution. Rounds grow with the logarithm of the
    longest path and end when all components are stars.
    """
    stars = edges.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct()
    stars = _written(stars, "edges")
    while not _are_stars(stars):
        stars = _written(_small_star(_large_star(stars)), "stars")
    return stars
