"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large star) or all smaller neighbours of each node on its least one."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # Sums by key first, then a join: a node of very many links is split like any skewed join.
    joined = both.join(least, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    hung = joined.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(least.filter("a <> m").select("a", F.col("m").alias("b"))).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); a component is its least node.

    Rounds go on until the links do not change; their number follows the logarithm of the longest
    path.  Each round's table replaces the one before, which is deleted.  No links: no rows.
    """
    pairs = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    before = None
    while True:
        last, pairs = pairs, materialise(_star(_star(pairs, True), False))
        release(last)
        # Stars that hang together change nothing any more; this sum tells.
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
