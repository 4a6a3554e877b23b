"""Ranks without a window over one partition."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.store import cut, free_names, small

_LOW = (1 << 33) - 1


def ranked(df: DataFrame, name: str, order: list[Column], by: list[str] | None = None) -> DataFrame:
    """df with the place of each row in that order, from 1, within its group or in the whole.

    The order, behind the groups if there are any, is range-partitioned and sorted in parallel, so a group with most of the rows is
    many tasks. A row's place is its place in its partition plus the rows of the partitions before: of those only the counts reach
    the driver, and with groups a row for each group and partition is joined back, by broadcast where there are few.
    """
    by = by or []
    keys = [*[F.col(c) for c in by], *order]
    at, piece, first, rows, before, *groups = free_names([*df.columns, name], "at", "piece", "first", "rows", "before", *[f"by{i}" for i in range(len(by))])
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(at, 33)
    if not by:
        counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
        below = [0, *accumulate(counts.get(p, 0) for p in range(max(counts, default=0) + 1))]
        rank = F.get(F.lit(below), part.cast("int")) + F.col(at).bitwiseAND(F.lit(_LOW)) + 1
        return placed.withColumn(name, rank.cast("int")).drop(at)
    pieces = placed.groupBy(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], part.alias(piece)).agg(F.min(at).alias(first), F.count("*").alias(rows))
    earlier = Window.partitionBy(*groups).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = cut(pieces.withColumn(before, F.coalesce(F.sum(rows).over(earlier), F.lit(0))).drop(rows), "pieces")
    on = part == F.col(piece)
    for c, g in zip(by, groups, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(g))
    rank = F.col(at) - F.col(first) + F.col(before) + 1
    return placed.join(small(pieces), on).withColumn(name, rank.cast("int")).select(*df.columns, name)
