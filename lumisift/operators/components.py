"""Connected components of an edge table by alternating stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators.totals import totals_of
from lumisift.sources.tables import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b), a > b. Large: a node links its larger neighbours to its least
    neighbour or itself; small: a node links its smaller neighbours and itself to the least of them."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = edges.union(back) if large else edges
    least = totals_of(near, "a", F.min("b").alias("m")).select("key__", F.least("key__", "m").alias("m"))
    joined = near.join(least, F.col("a") == F.col("key__"))  # a centre of any share of the edges is split
    if large:
        new = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return new.filter(F.col("a") != F.col("b")).distinct()


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge down at most, and none if an edge comes down to it."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("down")))
    counts = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("ends"))
    return counts.filter("down > 1 OR (down > 0 AND ends > down)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is the least node reachable.

    Nodes are of an orderable type without nulls; edges with a null end and loops are ignored. Each
    round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    real = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    current = written(real.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct())
    # edges lead down to lesser nodes, so in a forest of stars each ends at the least node of its component
    while not _is_star_forest(current):
        current = written(_star(_star(current, large=True), large=False))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
