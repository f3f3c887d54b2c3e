"""Connected components of a distributed edge list (large-star, small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stage


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: a, b (long). Returns id, component (the least id reachable) for every id in an edge.

    Each round is written to the shared folder, so lineage stays short; rounds grow with the logarithm
    of the longest path. Nothing is gathered on the driver but a count and a checksum per round,
    and no side of a join is broadcast: edges lie compressed in the folder, so Spark sizes them too low.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    last = None
    for _ in range(most_rounds):
        # Large star: larger neighbours of u go to the least of u and its neighbours.
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = now.select(F.col("v").alias("u"), F.col("u").alias("x")).join(least.hint("merge"), "u").select(F.col("x").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Small star: smaller neighbours of u, and u, go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now, before = stage(small.filter("u <> v").distinct(), "star"), now
        discard(before)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
