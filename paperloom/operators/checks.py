"""Data contracts as tables of violations (rule, key, detail); a plan never raises, ``require`` does on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.norm import is_missing

#: What looks like a credential, whose value is the first group, or like somebody's home folder.
SECRETS = (r"(sk-[A-Za-z0-9_-]{20,})", r"(gh[pousr]_[A-Za-z0-9]{20,})", r"(AKIA[0-9A-Z]{16})", r"(?i)(?:api[_-]?key|token|password)\s*[:=]\s*['\"]([A-Za-z0-9_./+-]{16,})['\"]")
PERSONAL_PATH = r"(?:[A-Za-z]:\\Users\\[^\\\s]+|/home/[^/\s]+|/Users/[^/\s]+)"
#: Names of files that hold keys, the one that is a sample, suffixes of texts, and words of values that are no secrets.
SENSITIVE_NAME = r"(?i)^(\.env(\..+)?|id_(rsa|dsa|ecdsa|ed25519)(\.pub)?|.*\.(pem|key|p12|pfx))$"
SAMPLE_NAME = ".env.example"
TEXT_SUFFIX = r"(?i)\.(py|md|json|csv|txt|yml|yaml|toml)$"
PLACEHOLDER = r"(?<![a-z0-9])(test|dummy|fake|placeholder|example|not-real|must-never-appear)(?![a-z0-9])"


class ContractError(ValueError):
    pass


def violations(df: DataFrame, rule: str, bad: Column, key: Column, detail: Column | None = None) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(False))).select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def duplicates(df: DataFrame, column: str, rule: str = "duplicate_id") -> DataFrame:
    """One row for each value that occurs again, with the number of rows; blank ones are a rule of their own."""
    c = F.col(column)
    blank = violations(df, "blank_id", is_missing(c), F.lit(""))
    again = df.where(~is_missing(c)).groupBy(c.cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1")
    return blank.unionByName(again.select(F.lit(rule).alias("rule"), "key", F.col("n").cast("string").alias("detail")))


def allowed(df: DataFrame, column: str, values: list, key: str) -> DataFrame:
    return violations(df, "value_not_allowed", ~F.coalesce(F.col(column).isin(values), F.lit(False)), F.col(key), F.col(column))


def references(df: DataFrame, column: str, known: DataFrame, known_column: str) -> DataFrame:
    """Values of column that no row of known has."""
    asked = df.where(~is_missing(F.col(column))).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    missing = asked.join(known.select(F.col(known_column).alias("k")).distinct(), F.col("v") == F.col("k"), "left_anti")
    return missing.select(F.lit("missing_reference").alias("rule"), F.col("v").cast("string").alias("key"), F.col("n").cast("string").alias("detail"))


def in_range(df: DataFrame, column: str, low: float, high: float, key: str) -> DataFrame:
    """Values that are no finite number or lie outside; blank ones pass."""
    c = F.col(column).cast("string")
    value = c.try_cast("double")
    there = ~is_missing(c)
    return union(
        [
            violations(df, "not_a_number", there & (value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))), F.col(key), c),
            violations(df, "out_of_range", there & ((value < low) | (value > high)) & ~F.isnan(value) & (F.abs(value) < float("inf")), F.col(key), c),
        ]
    )


def has_secret(c: Column) -> Column:
    found = [c.rlike(p) for p in SECRETS]
    return reduce(lambda a, b: a | b, found)


def sensitive_files(files: DataFrame) -> DataFrame:
    """Violations of files (path, content): names that hold keys, whose contents aren't looked at, and in texts credentials and home
    folders. In tests a value that says of itself that it is a placeholder is none. The detail never tells what was found."""
    path, content = F.col("path"), F.coalesce("content", F.lit(""))
    name = F.substring_index("path", "/", -1)
    sensitive, text = name.rlike(SENSITIVE_NAME), path.rlike(TEXT_SUFFIX)
    tests = F.lower("path").startswith("tests/")
    real = lambda v: ~(tests & F.lower(v).rlike(PLACEHOLDER))
    secret = reduce(lambda a, b: a | b, [F.exists(F.regexp_extract_all(content, F.lit(p), 1), real) for p in SECRETS])
    rules = [("sensitive_name", sensitive & (name != SAMPLE_NAME)), ("secret", ~sensitive & text & secret), ("personal_path", ~sensitive & text & content.rlike(PERSONAL_PATH))]
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules]))
    return files.select(F.explode(broken).alias("rule"), path.alias("key"), F.lit("").alias("detail"))


def table_diff(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem): keys of one table only, and keys whose columns differ."""
    left = a.select(F.col(key).alias("k"), F.struct(*columns).alias("l"))
    right = b.select(F.col(key).alias("k"), F.struct(*columns).alias("r"))
    joined = left.join(right, "k", "full_outer")
    problem = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(~F.col("l").eqNullSafe(F.col("r")), "changed")
    return joined.withColumn("problem", problem).where("problem IS NOT NULL").select(F.col("k").alias(key), "problem")


def summary(parts: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """(check, severity, violations) of each named check."""
    return union([df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), F.lit(severity).alias("severity"), "violations") for name, severity, df in parts])


def require(found: DataFrame) -> None:
    """Raise if there is any violation."""
    rows = found.limit(20).collect()
    if rows:
        raise ContractError("; ".join(f"{r['rule']} {r['key']} {r['detail']}" for r in rows))
