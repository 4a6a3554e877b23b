"""The paper records that the queries read, over the table of documents: one text for both engines, but for the first line."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYWORD = "the ing re tion ble"
REFERENCE_YEAR = 2026

PAPER_COLUMNS = {
    "pos": "doc_id",
    "title": "split_part(text, chr(10), 1)",
    "authors": "concat('A. ', source, '; B. ', lang)",
    "publication_year": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 2005 + doc_id % 24 END",
    "doi": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('https://doi.org/10.1/', doc_id % 700) END",
    "abstract": "text",
    "cited_by_count": "n_chars % 997",
    "source_name": "source",
    "openalex_id": "concat('W', doc_id % 900)",
    "landing_page_url": "CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'u' END",
    "grp": "lang",
}
#: Records whose identifiers agree with one another, and whose authors are many.
WORK_COLUMNS = PAPER_COLUMNS | {
    "authors": "concat('Ann s', doc_id % 499, '; Bo t', doc_id % 331, '.')",
    "doi": "CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('doi:10.48550/', doc_id % 900) END",
}


def _cte(name: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM documents)"


#: What Spark reads a first line by: split_part would cut the whole text into its lines.
FIRST_LINE = {"title": "substring_index(text, chr(10), 1)"}
PAPERS_SQL, WORKS_SQL = _cte("papers", PAPER_COLUMNS), _cte("works", WORK_COLUMNS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in (PAPER_COLUMNS | FIRST_LINE).items()])


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in (WORK_COLUMNS | FIRST_LINE).items()])


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the function under its name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
