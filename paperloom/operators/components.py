"""Connected components in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.store import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of edges (a, b) the smallest node that it reaches.

    Every node points at a node of its component that is no larger. In a round it learns its parent's parent and the smallest such
    grandparent of its neighbours; it points at the smaller of both, and so does its parent at the latter. Pointers so double
    their reach, and a chain of n nodes is done in about log n rounds. A round is one written table; minima are combined before they
    move, so a node with very many edges is no large task.
    """
    ways = edges.where("a <> b").select("a", "b")
    ways = cut(ways.unionByName(ways.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "ways")
    parents = cut(ways.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("p")).select("u", F.least("u", "p").alias("p")), "parents")
    before = None
    while True:
        # Pointers only fall, so equal sums mean that none has moved.
        state = tuple(parents.agg(F.count("*"), F.sum(F.xxhash64("u", "p").cast("decimal(38,0)"))).first())
        if state == before:
            discard(ways)
            return parents.select(F.col("u").alias("node"), F.col("p").alias("component"))
        before = state
        grand = parents.join(parents.select(F.col("u").alias("v"), F.col("p").alias("g")), F.col("p") == F.col("v")).select("u", "p", "g")
        near = ways.join(grand.select("u", "g"), F.col("b") == F.col("u")).groupBy("a").agg(F.min("g").alias("m"))
        met = grand.join(near, F.col("u") == F.col("a"))
        hooks = F.array(F.struct("u", F.least("g", "m").alias("p")), F.struct(F.col("p").alias("u"), F.col("m").alias("p")))
        moved = cut(met.select(F.inline(hooks)).groupBy("u").agg(F.min("p").alias("p")), "parents")
        discard(parents)
        parents = moved
