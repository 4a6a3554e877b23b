"""Agreement of two annotators, from whole-number counts with one division at the end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "?"


def disagreements(pairs: DataFrame) -> DataFrame:
    """Rows of (.., label_a, label_b) that differ, with their kind."""
    unknown = (F.col("label_a") == UNKNOWN) | (F.col("label_b") == UNKNOWN)
    return pairs.where("label_a <> label_b").withColumn("disagreement_type", F.when(unknown, "Needs_Discussion_Unknown").otherwise("Label_Conflict"))


def kappas(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, eligible, exact, exact_rate, kappa, weighted_kappa, kappa_status).

    Both kappas leave pairs with an unknown label out. They are unavailable for fewer than two pairs, where all labels are one
    category, and where no disagreement is expected. Only a table of 3 x 3 counts is kept for each group.
    """
    graded = (F.col("label_a") != UNKNOWN) & (F.col("label_b") != UNKNOWN)
    count = lambda c: F.count(F.when(c, 1))
    a, b = (F.when(graded, F.col(f"label_{x}").try_cast("int")) for x in "ab")
    sums = [count(F.lit(True)).alias("n"), count(graded).alias("eligible"), count(F.col("label_a") == F.col("label_b")).alias("exact"), count(a == b).alias("same"), F.coalesce(F.sum((a - b) * (a - b)), F.lit(0)).alias("square")]
    sums += [count(x == i).alias(f"{name}{i}") for name, x in (("a", a), ("b", b)) for i in range(3)]
    t = pairs.groupBy(*by).agg(*sums)
    chance: Column = F.lit(0)
    expected: Column = F.lit(0)
    for i in range(3):
        chance = chance + F.col(f"a{i}") * F.col(f"b{i}")
        for j in range(3):
            expected = expected + F.col(f"a{i}") * F.col(f"b{j}") * ((i - j) ** 2)
    m = F.col("eligible")
    # kappa = (po - pe) / (1 - pe) with po = same / m and pe = chance / m^2; weighted = 1 - (square / m) / (expected / m^2).
    single = F.greatest(*[F.col(f"a{i}") + F.col(f"b{i}") for i in range(3)]) == 2 * m
    fine = (m >= 2) & ~single & (expected > 0)
    status = F.when(m < 2, "insufficient_pairs").when(single, "single_category").when(expected == 0, "zero_expected_disagreement").otherwise("available")
    return t.withColumns(
        {
            "exact_rate": F.try_divide("exact", "n"),
            "kappa": F.when(fine, (F.col("same") * m - chance) / (m * m - chance)),
            "weighted_kappa": F.when(fine, (expected - F.col("square") * m) / expected),
            "kappa_status": status,
        }
    ).select(*by, "n", "eligible", "exact", "exact_rate", "kappa", "weighted_kappa", "kappa_status")
