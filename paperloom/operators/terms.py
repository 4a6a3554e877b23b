"""Queries out of a dictionary of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import checks


def query_sets(asked: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(queries, violations): the keyword and terms of each query in the order asked, of terms that the dictionary lets in queries.

    asked: query_id, at, term. terms: term_id, term, normalized_term, category, include_in_query. Terms are told apart without case.
    """
    known = terms.where("include_in_query").select(F.lower("normalized_term").alias("k"), "term_id", F.col("term").alias("found"), "category")
    met = asked.join(known, F.lower("term") == F.col("k"), "left")
    missing = checks.violations(met, "term_unknown", F.col("k").isNull(), F.col("query_id"), F.col("term"))
    listed = F.array_sort(F.collect_list(F.struct("at", "found", "term_id", "category")))
    queries = met.where("k IS NOT NULL").groupBy("query_id").agg(listed.alias("t"))
    of = lambda c: F.transform("t", lambda x: x[c])
    return queries.select("query_id", F.array_join(of("found"), " ").alias("keyword"), of("found").alias("included_terms"), of("term_id").alias("included_term_ids"), F.array_distinct(of("category")).alias("categories")), missing
