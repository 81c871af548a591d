"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import saved


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), long, no nulls, to (node, component), the smallest node reachable; nodes without an edge are left out.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones; distinct pairs are made before
    they are shuffled again, so no neighbourhood is gathered in one place. The number of rounds grows with the logarithm of the
    longest path. Loops and repeated edges are allowed; an empty table gives an empty result."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = saved(now)
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"))
        now = saved(moved.filter("a <> b").distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
