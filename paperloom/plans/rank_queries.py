"""Scores, ranks, text relevance and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import norm
from paperloom.functions.text import query_similarity, term_weights
from paperloom.operators import sampling, score
from paperloom.operators.rank import ranked

from . import pool, runs
from .views import KEYWORD, PAPER_COLUMNS, PAPERS_SQL, REFERENCE_YEAR, _cte, papers, query, table

TERMS = "['the', 'ing', 're', 'tion', 'ble']"
F4 = "floor(({}) * 10000 + 0.5) / 10000"
TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
#: Raw parts of the score for each record, of one corpus or of each group.
RAW_SQL = f"""raw AS (SELECT *,
    least(1.0::DOUBLE, 0.7::DOUBLE * len(list_intersect({TERMS}, {TOKENS.format('title')})) / 5 + 0.3::DOUBLE * len(list_intersect({TERMS}, {TOKENS.format('abstract')})) / 5) AS relevance_raw,
    ln(1 + greatest(0, coalesce(cited_by_count, 0))) / max(ln(1 + greatest(0, coalesce(cited_by_count, 0)))) OVER (BY_GROUP) AS impact_raw,
    CASE WHEN publication_year IS NULL THEN 0.0::DOUBLE WHEN {REFERENCE_YEAR} - publication_year <= 0 THEN 1.0 WHEN {REFERENCE_YEAR} - publication_year >= 10 THEN 0.0 ELSE (10 - ({REFERENCE_YEAR} - publication_year)) / 10.0::DOUBLE END AS recency_raw,
    ((trim(doi) <> '')::INT + (trim(abstract) <> '')::INT + (trim(authors) <> '')::INT + (publication_year IS NOT NULL)::INT + (trim(source_name) <> '')::INT + (trim(landing_page_url) <> '')::INT) / 6.0::DOUBLE AS completeness_raw
  FROM papers),
scored AS (SELECT *, {F4.format('relevance_raw')} AS relevance_score, {F4.format('impact_raw')} AS impact_score, {F4.format('recency_raw')} AS recency_score, {F4.format('completeness_raw')} AS completeness_score,
    {F4.format('0.4::DOUBLE * relevance_raw + 0.3::DOUBLE * impact_raw + 0.2::DOUBLE * recency_raw + 0.1::DOUBLE * completeness_raw')} AS preliminary_score FROM raw)"""


def scored_sql(by: str = "") -> str:
    return f"WITH {PAPERS_SQL}, " + RAW_SQL.replace("BY_GROUP", f"PARTITION BY {by}" if by else "")


def similarity_sql(name: str, column: str, by: str = "") -> str:
    """CTEs that end in {name}: the cosine of every record's text with the keyword."""
    g, on = (f"{by}, ", f"USING ({by})") if by else ("", "ON true")
    key = f"USING ({by}, pos)" if by else "USING (pos)"
    return f"""{name}_tf AS (SELECT {g}pos, token, count(*) AS tf FROM (SELECT {g}pos, unnest({TOKENS.format(column)}) AS token FROM papers) GROUP BY ALL),
{name}_n AS (SELECT {g}count(*) AS n FROM papers {f'GROUP BY {by}' if by else ''}),
{name}_w AS (SELECT t.*, ln((n + 1)::DOUBLE / (df + 1)) + 1 AS idf, df, n FROM {name}_tf t JOIN (SELECT {g}token, count(*) AS df FROM {name}_tf GROUP BY ALL) d USING ({g}token) JOIN {name}_n {on}),
{name}_s AS (SELECT {g}pos, sum(CASE WHEN list_contains({TERMS}, token) THEN idf * tf * idf ELSE 0 END) AS dot, sqrt(sum(tf * idf * tf * idf)) AS norm FROM {name}_w GROUP BY {g}pos),
{name}_q AS (SELECT {g}sqrt(sum(idf * idf)) AS q_norm FROM (SELECT DISTINCT {g}token, idf FROM {name}_w WHERE list_contains({TERMS}, token)) {f'GROUP BY {by}' if by else ''}),
{name} AS (SELECT p.{'' if not by else f'{by}, p.'}pos, coalesce(CASE WHEN norm * q_norm > 0 THEN dot / (norm * q_norm) END, 0) AS similarity FROM papers p LEFT JOIN {name}_s s {key} LEFT JOIN {name}_q q {on})"""


def ranked_sql(by: str = "") -> str:
    g, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    key = f"USING ({by}, pos)" if by else "USING (pos)"
    return f"""{scored_sql(by)}, {similarity_sql('ts', 'title', by)}, {similarity_sql('ab', 'abstract', by)},
o AS (SELECT *, row_number() OVER ({part} ORDER BY preliminary_score DESC, coalesce(cited_by_count, 0) DESC, coalesce(publication_year, 0) DESC, pos) AS old_rank FROM scored),
r AS (SELECT o.*, {F4.format('ts.similarity')} AS title_similarity, {F4.format('ab.similarity')} AS abstract_similarity, {F4.format('0.7::DOUBLE * ts.similarity + 0.3::DOUBLE * ab.similarity')} AS combined_relevance
  FROM o JOIN ts {key} JOIN ab {key}),
l AS (SELECT *, CASE WHEN combined_relevance >= 0.2 THEN 'high' WHEN combined_relevance >= 0.05 THEN 'medium' ELSE 'low' END AS relevance_level FROM r),
s2 AS (SELECT *, {F4.format("CASE relevance_level WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END * (0.5::DOUBLE * combined_relevance + 0.25::DOUBLE * impact_score + 0.15::DOUBLE * recency_score + 0.1::DOUBLE * completeness_score)")} AS stage2_score FROM l),
ranked AS (SELECT *, old_rank - new_rank AS rank_change FROM (SELECT *, row_number() OVER ({part} ORDER BY stage2_score DESC, combined_relevance DESC, coalesce(cited_by_count, 0) DESC, coalesce(publication_year, 0) DESC, old_rank) AS new_rank FROM s2))"""


def scored(spark: SparkSession, sf_dir: str, by: list[str] | None = None) -> DataFrame:
    return score.with_scores(papers(spark, sf_dir), KEYWORD, REFERENCE_YEAR, by)


def two_stage(spark: SparkSession, sf_dir: str, by: list[str] | None = None, keep: tuple[str, ...] = ("openalex_id", "title")) -> DataFrame:
    return score.two_stage_of(papers(spark, sf_dir), KEYWORD, REFERENCE_YEAR, by, keep)


@query(f"{scored_sql()} SELECT pos, relevance_score FROM scored")
def relevance_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("pos", "relevance_score")


@query(f"{scored_sql()} SELECT pos, impact_score FROM scored")
def impact_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("pos", "impact_score")


@query(f"{scored_sql()} SELECT pos, recency_score FROM scored")
def recency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("pos", "recency_score")


@query(f"{scored_sql()} SELECT pos, completeness_score FROM scored")
def completeness_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("pos", "completeness_score")


@query(f"{scored_sql()} SELECT pos, preliminary_score, relevance_score, impact_score, recency_score, completeness_score FROM scored")
def preliminary_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("pos", "preliminary_score", "relevance_score", "impact_score", "recency_score", "completeness_score")


@query(f"{scored_sql()} SELECT pos, CAST(row_number() OVER (ORDER BY preliminary_score DESC, coalesce(cited_by_count, 0) DESC, coalesce(publication_year, 0) DESC, pos) AS INTEGER) AS rank FROM scored")
def rank_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(scored(spark, sf_dir), "rank", score.baseline_order()).select("pos", "rank")


@query(f"WITH {PAPERS_SQL}, {similarity_sql('x', 'title')} SELECT DISTINCT token, df, {F4.format('idf')} AS idf FROM x_w")
def tfidf_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weights(papers(spark, sf_dir), "title").select("token", "df", norm.floor4(F.col("idf")).alias("idf")).distinct()


@query(f"WITH {PAPERS_SQL}, {similarity_sql('x', 'title')} SELECT pos, token, tf, {F4.format('tf * idf')} AS weight FROM x_w")
def tfidf_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_weights(papers(spark, sf_dir), "title").select("pos", "token", "tf", norm.floor4(F.col("weight")).alias("weight"))


@query(f"WITH {PAPERS_SQL}, {similarity_sql('x', 'title')} SELECT pos, {F4.format('similarity')} AS similarity FROM x")
def tfidf_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_similarity(papers(spark, sf_dir), "title", KEYWORD).select("pos", norm.floor4(F.col("similarity")).alias("similarity"))


@query(f"{ranked_sql()} SELECT pos, title_similarity, abstract_similarity, combined_relevance FROM ranked")
def text_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.text_relevance(papers(spark, sf_dir), KEYWORD)


@query(f"{ranked_sql()} SELECT pos, relevance_level, stage2_score, CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, CAST(rank_change AS INTEGER) AS rank_change FROM ranked")
def rank_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_stage(spark, sf_dir, keep=()).select("pos", "relevance_level", "stage2_score", "old_rank", "new_rank", "rank_change")


@query(f"{ranked_sql('grp')} SELECT grp, pos, stage2_score, CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank FROM ranked")
def rank_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group is a corpus of its own: its counts, largest impact and ranks."""
    return two_stage(spark, sf_dir, ["grp"], ()).select("grp", "pos", "stage2_score", "old_rank", "new_rank")


@query(f"{ranked_sql()} SELECT openalex_id, title, CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, CAST(rank_change AS INTEGER) AS rank_change, preliminary_score, stage2_score FROM ranked")
def ranking_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_stage(spark, sf_dir).select("openalex_id", "title", "old_rank", "new_rank", "rank_change", "preliminary_score", "stage2_score")


@query(f"{ranked_sql()} SELECT pos, CAST(rank_change AS INTEGER) AS rank_change FROM ranked ORDER BY abs(rank_change) DESC, old_rank LIMIT 5")
def rank_error_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest moves; the number is the feature."""
    return score.top_movers(two_stage(spark, sf_dir, keep=()), 5).select("pos", "rank_change")


@query(
    f"""{ranked_sql()} SELECT pos, CASE WHEN rank_change < 0 THEN concat('排名下降 ', -rank_change, ' 位：引用量 ', coalesce(cited_by_count, 0), ' 支撑了旧版高分，但词法相关性 combined=', printf('%.4f', combined_relevance), '（', relevance_level, ' 层），第一阶段降权系数 ', CASE relevance_level WHEN 'high' THEN '1.0' WHEN 'medium' THEN '0.8' ELSE '0.5' END, ' 生效')
WHEN rank_change > 0 THEN concat('排名上升 ', rank_change, ' 位：词法相关性 combined=', printf('%.4f', combined_relevance), '（', relevance_level, ' 层）在新权重 0.50 下贡献超过引用影响') ELSE '排名不变：两阶段相对位置未改变' END AS explanation FROM ranked"""
)
def rank_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_stage(spark, sf_dir, keep=()).select("pos", score.explain_change().alias("explanation"))


@query(f"{ranked_sql()} SELECT relevance_level, count(*) AS n FROM ranked GROUP BY relevance_level")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    lv = score.level(F.col("combined_relevance")).alias("relevance_level")
    return score.text_relevance(papers(spark, sf_dir), KEYWORD).groupBy(lv).agg(F.count("*").alias("n"))


STRATIFIED_SQL = """cnt AS (SELECT *, count(*) OVER (PARTITION BY grp) AS n FROM ranked),
b AS (SELECT *, CASE WHEN new_rank <= 5 THEN 'top' WHEN new_rank > (n - 5) // 2 AND new_rank <= (n - 5) // 2 + 5 THEN 'middle' WHEN new_rank > n - 5 THEN 'bottom' END AS bucket FROM cnt WHERE n >= 25),
picked AS (SELECT grp, pos, openalex_id, bucket FROM b WHERE bucket IS NOT NULL UNION ALL
  SELECT grp, pos, openalex_id, 'mover' FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY abs(rank_change) DESC, new_rank, openalex_id, lower(title)) AS m FROM b WHERE bucket IS NULL) WHERE m <= 5)"""


@query(f"{ranked_sql('grp')}, {STRATIFIED_SQL} SELECT grp, pos, bucket FROM picked")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified(two_stage(spark, sf_dir, ["grp"]), ["grp"]).select("grp", "pos", "bucket")


@query(f"{ranked_sql('grp')}, {STRATIFIED_SQL} SELECT grp, pos, bucket, CAST(row_number() OVER (PARTITION BY grp ORDER BY sha256(concat('v1|', grp, '|', openalex_id, '|', pos))) AS INTEGER) AS ordinal FROM picked")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample in the order of a stable hash, which tells neither score nor bucket."""
    pool = sampling.stratified(two_stage(spark, sf_dir, ["grp"]), ["grp"])
    h = sampling.stable_hash("v1", F.col("grp"), F.col("openalex_id"), F.col("pos").cast("string"))
    return sampling.hash_numbered(pool, ["grp"], h).select("grp", "pos", "bucket", "ordinal")


#: Records that are no duplicates, by DOI or else by title.
UNIQUE_SQL = (
    _cte("every", PAPER_COLUMNS)
    + r""", keyed AS (SELECT *, trim(regexp_replace(lower(trim(doi)), '^(https://doi\.org/|http://doi\.org/|doi\.org/|doi:)', '')) AS d, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS t FROM every),
papers AS (SELECT * FROM keyed QUALIFY pos = min(pos) OVER (PARTITION BY CASE WHEN d <> '' THEN 'd:' || d WHEN t <> '' THEN 't:' || t ELSE 'p:' || pos END))"""
)


@query(f"{scored_sql().replace(PAPERS_SQL, UNIQUE_SQL)} SELECT pos, relevance_score, impact_score, preliminary_score FROM scored")
def prepared_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records cleaned, without duplicates, and scored."""
    raw = papers(spark, sf_dir).withColumns({c: F.col(c).cast("string") for c in ("publication_year", "cited_by_count")}).withColumns({c: F.lit(None).cast("string") for c in ("keyword", "retrieved_at")})
    return runs.prepare_baseline(raw, KEYWORD, REFERENCE_YEAR).select("pos", "relevance_score", "impact_score", "preliminary_score")


STATS = "concat('{\"page_count\": ', CASE WHEN doc_id % 5 = 0 THEN 'null' ELSE CAST(doc_id % 9 AS STRING) END, CASE WHEN doc_id % 3 = 0 THEN ', \"status\": \"failed\", \"actual_result_count\": 7' ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN ', \"elapsed_seconds\": 1.5, \"retry_count\": \"2\"' ELSE '' END, '}')"


@query(
    f"""WITH s AS (SELECT doc_id AS query_id, n_chars % 50 AS cleaned_result_count, CASE WHEN doc_id % 11 = 0 THEN '{{}}' ELSE {STATS} END AS j FROM documents)
SELECT query_id, cleaned_result_count, CAST(coalesce(CAST(json_extract_string(j, '$.actual_result_count') AS INT), cleaned_result_count) AS INT) AS actual_result_count, coalesce(CAST(json_extract_string(j, '$.page_count') AS INT), 0) AS page_count, 0 AS request_count,
coalesce(CAST(json_extract_string(j, '$.retry_count') AS INT), 0) AS retry_count, 0 AS duplicate_records_skipped, coalesce(json_extract_string(j, '$.status'), 'success') AS status, '' AS stopped_reason, coalesce(CAST(json_extract_string(j, '$.elapsed_seconds') AS DOUBLE), 0.0::DOUBLE) AS elapsed_seconds FROM s"""
)
def query_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fetches tell of themselves, with a type and a default each."""
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id AS query_id", "n_chars % 50 AS cleaned_result_count", f"CASE WHEN doc_id % 11 <> 0 THEN {STATS} END AS stats")
    return norm.query_stats(rows)


#: Works that each language's acquisition query has found, with ids of their own.
FOUND = PAPER_COLUMNS | {"openalex_id": "concat('P', doc_id)"}
FOUND_SQL = _cte("papers", FOUND | {"pos": "row_number() OVER (PARTITION BY lang ORDER BY concat('P', doc_id), lower(split_part(text, chr(10), 1)))"})
RESEARCH = ("en", "fr", "es", "de")


@query(
    f"""{ranked_sql('grp').replace(PAPERS_SQL, FOUND_SQL)}, {STRATIFIED_SQL}
SELECT printf('w4_rq%02d_%03d', dense_rank() OVER (ORDER BY list_position({list(RESEARCH)}, grp)), row_number() OVER (PARTITION BY grp ORDER BY sha256(concat('v1|', grp, '|', openalex_id)))) AS pair_id, grp AS research_query_id, openalex_id, bucket AS selection_bucket,
concat('["a-', grp, '"]') AS source_query_ids FROM picked"""
)
def built_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of four research queries, or of those that have found enough, from retrieved records to numbered pairs."""
    rows = table(spark, sf_dir, "documents").selectExpr(*[f"{e} AS {c}" for c, e in FOUND.items() if c not in ("pos", "grp")], "array(concat('a-', lang)) AS source_query_ids", "array('r') AS source_run_ids")
    enough = {r["lang"] for r in table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= sampling.LEAST_ROWS).collect()}
    queries = [{"research_query_id": q, "acquisition_query_ids": [f"a-{q}"], "ranking_keyword": KEYWORD} for q in RESEARCH if q in enough]
    return pool.build(rows, queries, "v1", REFERENCE_YEAR).select("pair_id", "research_query_id", "openalex_id", "selection_bucket", "source_query_ids")


@query("SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('v1|', lang, '|', doc_id))) AS INTEGER) AS ordinal FROM documents")
def hash_ordered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = sampling.stable_hash("v1", F.col("lang"), F.col("doc_id").cast("string"))
    return sampling.hash_numbered(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], h)


@query("SELECT lang AS rq, doc_id AS pair_id, concat('a', (row_number() OVER (ORDER BY lang, doc_id) - 1) % 6) AS primary FROM documents".replace("AS primary", 'AS "primary"'))
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = table(spark, sf_dir, "documents").select(F.col("lang").alias("rq"), F.col("doc_id").alias("pair_id"))
    return sampling.assign_primary(pool, [f"a{i}" for i in range(6)]).select("rq", "pair_id", "primary")


@query("SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(concat('s2|', lang, '|', doc_id))) AS r FROM documents) WHERE r <= 10")
def hash_topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = sampling.stable_hash("s2", F.col("lang"), F.col("doc_id").cast("string"))
    return sampling.hash_first(table(spark, sf_dir, "documents").select("lang", "doc_id"), ["lang"], h, 10).select("lang", "doc_id")


@query()
def balanced_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pairs of each group get a second annotator, by a search on the driver over those pairs."""
    names = [f"a{i}" for i in range(6)]
    pool = table(spark, sf_dir, "documents").select(F.col("lang").alias("rq"), F.col("doc_id").alias("pair_id"))
    first = sampling.assign_primary(pool, names)
    h = sampling.stable_hash("s2", F.col("rq"), F.col("pair_id").cast("string"))
    rows = sampling.hash_first(first, ["rq"], h, 10).orderBy("rq", "pair_id").select("rq", "pair_id", "primary").collect()
    seconds = sampling.assign_secondary([(r["pair_id"], r["primary"]) for r in rows], names, -(-len(rows) // 6) + 1)
    return spark.createDataFrame([(*r, s) for r, s in zip(rows, seconds, strict=True)], "rq string, pair_id long, primary string, secondary string")


MISSING = ("title", "authors", "publication_year", "doi", "abstract", "cited_by_count", "source_name", "openalex_id", "landing_page_url")


@query(f"WITH {PAPERS_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '') AS missing FROM papers" for c in MISSING))
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = papers(spark, sf_dir).agg(*[F.count(F.when(norm.is_missing(F.col(c)), 1)).alias(c) for c in MISSING])
    return row.unpivot([], list(MISSING), "field", "missing")


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL")
def group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def annotation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several columns counted in one pass."""
    return table(spark, sf_dir, "documents").select("lang", "source").unpivot([], ["lang", "source"], "field", "value").groupBy("field", "value").agg(F.count("*").alias("n"))


@query("SELECT lang AS rq, concat('a', doc_id % 6) AS annotator, count(*) AS n FROM documents GROUP BY ALL")
def assignment_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("rq"), F.concat(F.lit("a"), (F.col("doc_id") % 6).cast("string")).alias("annotator")).agg(F.count("*").alias("n"))


@query("SELECT count(text) - count(DISTINCT text) AS duplicates FROM documents")
def duplicate_id_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("text").agg(F.count("text").alias("n")).where("text IS NOT NULL").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


@query("SELECT count(*) AS combined, count(DISTINCT lang) AS queries, count(*) FILTER (n_chars > 1000) AS long_texts FROM documents")
def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("combined"), F.count_distinct("lang").alias("queries"), F.count(F.when(F.col("n_chars") > 1000, 1)).alias("long_texts"))


@query("SELECT CAST(CASE WHEN count(x) = count(*) THEN avg(x) END AS DOUBLE) AS macro_all, CASE WHEN count(y) = count(*) THEN avg(y) END AS macro_none FROM (SELECT lang, CAST(count(*) AS DOUBLE) AS x, CASE WHEN lang <> 'fr' THEN 1.0::DOUBLE END AS y FROM documents GROUP BY lang)")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    from paperloom.operators.evaluate import macro

    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").cast("double").alias("macro_all"))
    return macro(g.withColumn("macro_none", F.when(F.col("lang") != "fr", 1.0)), [], ["macro_all", "macro_none"])


@query(
    """WITH s AS (SELECT doc_id AS pair_id, lang AS rq, CAST(n_chars % 100 AS DOUBLE) / 100 AS score FROM documents)
SELECT rq, pair_id, CAST(row_number() OVER (PARTITION BY rq ORDER BY score DESC, pair_id) AS INTEGER) AS rank FROM s"""
)
def contract_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranks that a contract expects: by score, ties by pair."""
    s = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.col("lang").alias("rq"), ((F.col("n_chars") % 100).cast("double") / 100).alias("score"))
    return ranked(s, "rank", [F.desc("score"), F.asc("pair_id")], ["rq"]).select("rq", "pair_id", "rank")
