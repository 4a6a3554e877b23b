"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.store import cut, discard, shared_path

__all__ = ["cut", "discard", "free_names", "pick", "shared_path", "table"]
#: Keys up to this number are broadcast to pick rows by; more are joined.
PICK_BROADCAST = 1_000_000


def pick(df: DataFrame, on: Column, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """df joined with a table of keys, whose names df has not: by broadcast where their number is small, else by both sides' keys."""
    keys = cut(keys, "keys")
    return df.join(F.broadcast(keys) if keys.count() <= PICK_BROADCAST else keys, on, how)


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for columns of an operator's own beside those that are taken, whose case doesn't count."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
