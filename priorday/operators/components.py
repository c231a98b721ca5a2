"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from priorday.sources.shared import forget, written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of `edges` (a long, b long): (node, component).

    A component's smallest node has no row of its own.

    Large-star links every larger neighbour of a node to the node's smallest
    neighbour; small-star does so for the smaller ones. Rounds repeat until the
    edge set stands still, which is when every edge points at its component's
    smallest node. Each round is written to the shared folder, so a lost
    executor costs one round at most. Nulls and self-links are dropped."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        then = written(small, "links")
        forget(now)
        now = then
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000000007)).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = seen
    raise RuntimeError("components did not settle")
