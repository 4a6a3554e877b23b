"""Streams of events. An extension: windows with late data, and first-seen records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.norm import normalize_doi, title_key


def counted(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events of each kind in tumbling or sliding windows; what comes later than ``late`` is left out."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    return events.withWatermark(time, late).groupBy(window.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n")


def first_seen(papers: DataFrame, late: str = "1 day", time: str = "arrived_at") -> DataFrame:
    """Records whose DOI, or title where there is none, wasn't seen within the watermark."""
    doi, title = normalize_doi(F.col("doi")), title_key(F.col("title"))
    key = F.when(doi != "", F.concat(F.lit("d:"), doi)).otherwise(F.concat(F.lit("t:"), title))
    return papers.withWatermark(time, late).withColumn("dedup_key", key).dropDuplicatesWithinWatermark(["dedup_key"])
