"""Connected components of edge lists that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node it reaches) for every node of edges (a, b), by large and small stars in turn.

    Each round halves paths at least; it ends when no edge moves. Minima are found by partial aggregation, and joins meet them
    as a written table, so that a node with very many edges is split over tasks.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, was = state, stars
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(near, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
        small = large.join(least, F.col("a") == F.col("u"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        stars = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(was, near, large, least)
