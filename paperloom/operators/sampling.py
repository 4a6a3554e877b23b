"""Annotation pools: stratified picks, stable hashes for order, and balanced assignment."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.operators.rank import ranked
from paperloom.store import cut, small

#: Rows of each bucket, and the rows a group must have.
BUCKET, LEAST_ROWS = 5, 25


def stratified(numbered: DataFrame, by: list[str]) -> DataFrame:
    """Per group the top, middle and bottom BUCKET rows by new_rank, and BUCKET of the rest by the size of their move.

    Groups with fewer than LEAST_ROWS rows give none.
    """
    w = Window.partitionBy(*by)
    n, r = F.col("_n"), F.col("new_rank")
    start = F.floor((n - BUCKET) / 2)
    bucket = F.when(r <= BUCKET, "top").when((r > start) & (r <= start + BUCKET), "middle").when(r > n - BUCKET, "bottom")
    counted = numbered.join(small(cut(numbered.groupBy(*by).agg(F.count("*").alias("_n")), "sizes")), by).where(F.col("_n") >= LEAST_ROWS).withColumn("bucket", bucket)
    rest = counted.where("bucket IS NULL")
    order = [F.abs("rank_change").desc(), F.asc("new_rank"), F.asc("openalex_id"), F.lower("title").asc()]
    movers = rest.withColumn("_m", F.row_number().over(w.orderBy(*order))).where(F.col("_m") <= BUCKET).withColumn("bucket", F.lit("mover")).drop("_m")
    return counted.where("bucket IS NOT NULL").unionByName(movers).drop("_n")


def stable_hash(version: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(version), *parts), 256)


def hash_numbered(df: DataFrame, by: list[str], h: Column, name: str = "ordinal") -> DataFrame:
    """df with each row's place in its group in the order of the hash; a group with most of the rows is many tasks."""
    return ranked(df.withColumn("_h", h), name, [F.asc("_h")], by).drop("_h")


def hash_first(df: DataFrame, by: list[str], h: Column, most: int) -> DataFrame:
    """The first ``most`` rows of each group in the order of the hash; a task hands on no more of a group than those."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(h))).where(F.col("_n") <= most).drop("_n")


def assign_primary(pool: DataFrame, annotators: list[str]) -> DataFrame:
    """pool (rq, pair_id) with a primary annotator by turns over the order of both keys."""
    return ranked(pool, "_place", [F.asc("rq"), F.asc("pair_id")]).withColumn("primary", F.get(F.lit(annotators), (F.col("_place") - 1) % len(annotators))).drop("_place")


def assign_secondary(primaries: list[tuple[str, str]], annotators: list[str], quota: int) -> list[str]:
    """A second annotator for each (pair, first annotator): never the first, quota each, and partners met as evenly as can be.

    A search over some ten pairs that backs up where a quota leaves no choice; it runs on the driver.
    """
    left = dict.fromkeys(annotators, quota)
    met = dict.fromkeys(map(frozenset, combinations(annotators, 2)), 0)
    out: list[str] = []

    def place(i: int) -> bool:
        if i == len(primaries):
            return True
        first = primaries[i][1]
        for a in sorted((x for x in annotators if x != first and left[x]), key=lambda x: (met[frozenset((x, first))], -left[x], annotators.index(x))):
            left[a] -= 1
            met[frozenset((a, first))] += 1
            out.append(a)
            if place(i + 1):
                return True
            out.pop()
            left[a] += 1
            met[frozenset((a, first))] -= 1
        return False

    if not place(0):
        raise ValueError("the quotas leave no assignment")
    return out
