"""Judged ranking metrics: unjudged items leave the ranking before precision and gain are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The labels of a judgement and their grades; the last means undecided.
LABELS = {"高度相关": 2, "部分相关": 1, "不相关": 0}
UNDECIDED = "待讨论"
#: Fixed value: what an item must move by, and the top it must leave or enter, to be an error case.
ERROR_SHIFT, ERROR_TOP = 5, 5


def grade(label: Column) -> Column:
    """2, 1, 0, or null where it is blank or undecided; anything else is an error."""
    text = F.trim(F.coalesce(label, F.lit("")))
    out = F.when(text.isin("", UNDECIDED, "?"), F.lit(None).cast("int"))
    for name, value in LABELS.items():
        out = out.when(text.isin(name, str(value)), F.lit(value))
    return out.otherwise(F.raise_error(F.concat(F.lit("illegal label: "), text)).cast("int"))


def check_k(k: object) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k is a positive whole number")
    return k


def first_judged(ranking: DataFrame, by: list[str], order: list[Column], name: str, most: int) -> DataFrame:
    """The first ``most`` judged rows of each group in that order, with their place; a task hands on no more of a group than those."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return ranking.where("grade IS NOT NULL").withColumn(name, place).where(F.col(name) <= most)


def _gain(place: str) -> Column:
    return (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(place) + 1)


def metrics(ranking: DataFrame, by: list[str], ks: list[int], rank: str = "rank") -> DataFrame:
    """(by, k, precision, ndcg, judged_in_top, coverage, irrelevant_in_top, judged, average_rank_high) for each k."""
    for k in ks:
        check_k(k)
    cuts = F.explode(F.lit(list(ks))).alias("k")
    sized = ranking.groupBy(*by).agg(F.count("*").alias("n"), F.count("grade").alias("judged"), F.avg(F.when(F.col("grade") == 2, F.col(rank))).alias("average_rank_high"))
    top = ranking.where(F.col(rank) <= max(ks)).select("*", cuts).where(F.col(rank) <= F.col("k"))
    top = top.groupBy(*by, "k").agg(F.count("grade").alias("judged_in_top"), F.count(F.when(F.col("grade") == 0, 1)).alias("irrelevant_in_top"))
    met = first_judged(ranking, by, [F.asc(rank)], "condensed", max(ks)).select("*", cuts).where(F.col("condensed") <= F.col("k"))
    gains = met.groupBy(*by, "k").agg(F.avg((F.col("grade") >= 1).cast("double")).alias("precision"), F.sum(_gain("condensed")).alias("dcg"))
    best = first_judged(ranking, by, [F.desc("grade"), F.asc(rank)], "ideal", max(ks)).select("*", cuts).where(F.col("ideal") <= F.col("k"))
    best = best.groupBy(*by, "k").agg(F.sum(_gain("ideal")).alias("idcg"))
    out = sized.select("*", cuts).join(top, [*by, "k"], "left").join(gains, [*by, "k"], "left").join(best, [*by, "k"], "left")
    return out.select(
        *by,
        "k",
        "precision",
        F.try_divide("dcg", "idcg").alias("ndcg"),
        F.coalesce("judged_in_top", F.lit(0)).alias("judged_in_top"),
        (F.coalesce("judged_in_top", F.lit(0)) / F.least("k", "n")).alias("coverage"),
        F.coalesce("irrelevant_in_top", F.lit(0)).alias("irrelevant_in_top"),
        "judged",
        "average_rank_high",
    )


def macro(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """The mean of each column over the groups; null if it is null for any of them."""
    return rows.groupBy(*by).agg(*[F.when(F.count(c) == F.count(F.lit(1)), F.avg(c)).alias(c) for c in columns])


def error_types(old: Column, new: Column, grade_: Column) -> Column:
    """Codes A to E joined by ';', empty if none holds.

    A: relevant, but out of a top; B: irrelevant, but in a top; C: fell far from the old top; D: rose far into the new top; E: both
    rankings fail alike. An undecided label triggers none of A, B and E.
    """
    in_old, in_new = old <= ERROR_TOP, new <= ERROR_TOP
    codes = [
        F.when((grade_ == 2) & ~(in_old & in_new), "A"),
        F.when((grade_ == 0) & (in_old | in_new), "B"),
        F.when(in_old & (old - new <= -ERROR_SHIFT), "C"),
        F.when(in_new & (old - new >= ERROR_SHIFT), "D"),
        F.when(((grade_ == 2) & ~in_old & ~in_new) | ((grade_ == 0) & in_old & in_new), "E"),
    ]
    return F.array_join(F.filter(F.array(*codes), lambda c: c.isNotNull()), ";")
