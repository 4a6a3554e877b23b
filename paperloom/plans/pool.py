"""Candidate pools: pairs of research query and work that people will judge, picked by retrieval and rank alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators import checks, sampling, score
from paperloom.operators.rank import ranked
from paperloom.store import cut

#: Columns that tell a judgement, which may not bear on the choice; those that a source needs, and those of a pool.
JUDGED = {"label", "annotation_id", "review_status", "ai_assistance", "hard_negative_label"}
NEEDED = ("openalex_id", "title", "abstract", "landing_page_url", "publication_year", "doi", "source_query_ids", "source_run_ids")
POOL = (
    "pair_id", "research_query_id", "research_question_zh", "research_question_en", "acquisition_query_id", "openalex_id", "title", "abstract", "landing_page_url", "publication_year", "doi",
    "source_query_ids", "source_run_ids", "pool_version", "selection_bucket",
)
RANKED = ("cited_by_count", "authors", "source_name")


def eligible(papers: DataFrame, queries: Sequence[dict]) -> DataFrame:
    """The rows that each research query's one acquisition query has found, numbered within it by id and title.

    Raises where the source has columns of judgements or lacks one, a query has no single acquisition query, finds fewer rows than
    the strata need, or finds a work twice.
    """
    if told := sorted(JUDGED & {c.lower() for c in papers.columns}):
        raise checks.ContractError(f"the source has columns of judgements: {', '.join(told)}")
    if missing := sorted(set(NEEDED) - set(papers.columns)):
        raise checks.ContractError(f"the source lacks {', '.join(missing)}")
    if several := [q["research_query_id"] for q in queries if len(q["acquisition_query_ids"]) != 1]:
        raise checks.ContractError(f"{', '.join(several)}: one acquisition query is asked for")
    of = [(q["research_query_id"], q["acquisition_query_ids"][0], q.get("question_zh", ""), q.get("question_en", "")) for q in queries]
    asked = papers.sparkSession.createDataFrame(of, "research_query_id string, acquisition_query_id string, research_question_zh string, research_question_en string")
    extra = [c if c in papers.columns else F.lit(None).cast("string").alias(c) for c in RANKED]
    rows = papers.select(*NEEDED, *extra).withColumn("acquisition_query_id", F.explode(F.array_distinct("source_query_ids")))
    met = cut(rows.join(F.broadcast(asked), "acquisition_query_id").withColumn("openalex_id", F.trim("openalex_id")), "eligible")
    sizes = {r["research_query_id"]: r["n"] for r in met.groupBy("research_query_id").agg(F.count("*").alias("n")).collect()}
    if few := [f"{q}: {sizes.get(q, 0)}" for q, *_ in of if sizes.get(q, 0) < sampling.LEAST_ROWS]:
        raise checks.ContractError(f"{', '.join(few)} rows are too few for the strata")
    again = met.groupBy("research_query_id", "openalex_id").agg(F.count("*").alias("n")).where("n > 1").orderBy("research_query_id", "openalex_id").first()
    if again:
        raise checks.ContractError(f"{again['research_query_id']} finds {again['openalex_id']} twice")
    return ranked(met, "pos", [F.asc("openalex_id"), F.asc(F.lower("title"))], ["research_query_id"])


def build(papers: DataFrame, queries: Sequence[dict], version: str, reference_year: int) -> DataFrame:
    """The pool: of each query's ranking its top, middle and bottom rows and its largest moves, numbered by a hash.

    papers: the columns of NEEDED, with arrays of query and run ids, and those of RANKED as far as there are any. queries:
    research_query_id, acquisition_query_ids, ranking_keyword, and the questions. The numbers tell neither score, rank nor bucket.
    """
    of = ["research_query_id"]
    keywords = {q["research_query_id"]: q["ranking_keyword"] for q in queries}
    source = eligible(papers, queries)
    typed = source.withColumns({"publication_year": F.col("publication_year").try_cast("int"), "cited_by_count": F.col("cited_by_count").try_cast("long")})
    # Positions are unique in a query only.
    placed = typed.withColumn("pos", F.concat_ws("|", F.lpad(F.col("pos").cast("string"), 12, "0"), *of))
    moved = score.two_stage_of(placed, keywords, reference_year, of, ("openalex_id", "title"))
    picked = sampling.stratified(moved, of).select(*of, F.col("openalex_id").alias("picked"), F.col("bucket").alias("selection_bucket"))
    rows = source.join(picked, [*of]).where(F.col("openalex_id") == F.col("picked")).withColumn("pool_version", F.lit(version))
    numbered = sampling.hash_numbered(rows, of, sampling.stable_hash(version, F.col("research_query_id"), F.col("openalex_id")))
    turn = F.array_position(F.lit([q["research_query_id"] for q in queries]), F.col("research_query_id"))
    named = numbered.withColumn("pair_id", F.format_string("w4_rq%02d_%03d", turn, F.col("ordinal")))
    return named.withColumns({c: F.to_json(c) for c in ("source_query_ids", "source_run_ids")}).select(*POOL)


def details(pool: DataFrame) -> DataFrame:
    """(research_query_id, selection_bucket, n) of a pool."""
    return pool.groupBy("research_query_id", "selection_bucket").agg(F.count("*").alias("n"))
