"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edges alone; nothing is collected, lineage is cut by written
tables, and the number of rounds grows with the logarithm of the longest path. A vertex with very many neighbours is
reduced by map-side minima; these are written first, so that Spark may split the join on its id. Self loops and repeated edges
are ignored; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import discard, materialize


def _settled(edges: DataFrame) -> bool:
    """Whether edges (a, b) are stars: every a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("child"), F.lit(1).alias("root")))
    return ends.groupBy("v").agg(F.sum("child").alias("c"), F.max("root").alias("r")).where("c > 1 OR (c = 1 AND r = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (a, b); the component is its smallest vertex."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        # Large star: every larger neighbour of a vertex goes to the smallest of the vertex and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        least = materialize(least, "least")
        large = materialize(both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: a vertex and its smaller neighbours go to the smallest of these.
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low.hint("merge"), "a").select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = materialize(small, "small")
        for old in (large, now, least, low):
            discard(old)
        now = small
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
