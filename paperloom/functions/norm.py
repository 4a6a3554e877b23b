"""Column functions that normalise scholarly metadata. Text that is missing is the empty string after cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One of these is dropped from the front of a DOI.
DOI_PREFIXES = ("https://doi.org/", "http://doi.org/", "doi.org/", "doi:")


def strip(c: Column) -> Column:
    """c without white space of any script at its ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_missing(c: Column) -> Column:
    """Null or blank; zero is present."""
    return c.isNull() | c.cast("string").rlike(r"(?U)^\s*$")


def clean_text(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def clean_int(c: Column) -> Column:
    """Whole numbers, numbers cut to whole ones, and texts of whole numbers; all else is null."""
    return c.try_cast("int")


def clean_names(names: Column) -> Column:
    """An array of names joined by '; ', without blanks."""
    return F.array_join(F.filter(F.transform(names, lambda n: clean_text(n)), lambda n: n != ""), "; ")


def normalize_doi(c: Column) -> Column:
    prefixes = "|".join(p.replace(".", r"\.") for p in DOI_PREFIXES)
    return strip(F.regexp_replace(F.lower(clean_text(c)), f"^({prefixes})", ""))


def title_key(c: Column) -> Column:
    """Lower case with single spaces."""
    return F.regexp_replace(F.lower(clean_text(c)), r"(?U)\s+", " ")


def strict_title_key(c: Column) -> Column:
    """Lower-case ASCII words alone: without tags, archive notes and numbers, or marks. Empty for titles in other scripts."""
    out = F.lower(F.coalesce(c, F.lit("")))
    for pattern, to in ((r"<[^>]+>", ""), (r"\[arxiv[^\]]*\]", ""), (r"arxiv:\s*\d{4}\.\d{4,}(v\d+)?", ""), (r"[^a-z0-9]+", " ")):
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def title_tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: F.length(t) >= 2))


def surnames(authors: Column) -> Column:
    """The last word of each name between semicolons, lower-cased, without final stops, of two letters at least."""
    names = F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), ";"), strip), lambda n: n != "")
    last = F.transform(names, lambda n: F.lower(F.regexp_replace(F.element_at(F.split(n, r"(?U)\s+"), -1), r"\.+$", "")))
    return F.filter(last, lambda s: F.length(s) >= 2)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def pair_id(left: Column, right: Column) -> Column:
    return F.concat(F.lit("SP-"), F.substring(F.md5(F.concat(left, F.lit("|"), right)), 1, 8))


#: What a fetch tells of itself, with its type and what stands in where it doesn't.
QUERY_STATS = (
    ("page_count", "int", 0), ("request_count", "int", 0), ("retry_count", "int", 0), ("duplicate_records_skipped", "int", 0), ("status", "string", "success"), ("stopped_reason", "string", ""), ("elapsed_seconds", "double", 0.0),
)


def query_stats(df: DataFrame, stats: str = "stats", cleaned: str = "cleaned_result_count") -> DataFrame:
    """df without its JSON column of a fetch's statistics, and with a typed column for each of them.

    What is missing or null has its default; the number of results is that of the cleaned records where the fetch doesn't tell it.
    A value that can't be cast, and a text that isn't JSON, are errors when they are read.
    """
    value = F.parse_json(F.coalesce(F.col(stats), F.lit("{}")))
    told = [F.coalesce(F.variant_get(value, "$.actual_result_count", "int"), F.col(cleaned).cast("int")).alias("actual_result_count")]
    told += [F.coalesce(F.variant_get(value, f"$.{name}", kind), F.lit(default).cast(kind)).alias(name) for name, kind, default in QUERY_STATS]
    return df.select(*[c for c in df.columns if c != stats], *told)


def floor4(c: Column) -> Column:
    """Four decimals by the same arithmetic in every engine."""
    return F.floor(c * 10000 + 0.5) / 10000


def redact(c: Column, limit: int = 300) -> Column:
    """An error text on one line without the values of secrets, cut to ``limit`` characters."""
    line = F.regexp_replace(F.trim(F.regexp_replace(c, r"[\r\n]", " ")), r"(?i)(api[_-]?key|token|password)\s*[:=]\s*\S+", "$1=<redacted>")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit - 3), F.lit("..."))).otherwise(line)


def rebuild_abstracts(df: DataFrame, key: str, index: str, out: str = "abstract") -> DataFrame:
    """(key, out): the texts of inverted indexes {word: [positions]}; gaps are ignored, and where words share a position the last
    entry's stands. Rows without an index, or with an empty one, give the empty text."""
    entries = df.select(key, F.posexplode(F.map_entries(index)).alias("i", "e")).select(key, "i", F.col("e.key").alias("w"), F.explode("e.value").alias("p"))
    spots = entries.groupBy(key, "p").agg(F.max_by("w", "i").alias("w"))
    texts = spots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", "w"))).alias("ws"))
    return df.select(key).join(texts, key, "left").select(key, F.coalesce(F.array_join(F.transform("ws", lambda s: s["w"]), " "), F.lit("")).alias(out))
