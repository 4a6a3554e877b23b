"""Duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import norm
from paperloom.operators import checks, dedup

from .field_queries import STRICT_SQL
from .views import PAPERS_SQL, WORKS_SQL, papers, query, table, works

DOI = r"trim(regexp_replace(lower(trim(doi)), '^(https://doi\.org/|http://doi\.org/|doi\.org/|doi:)', ''))"
BASELINE_SQL = rf"""WITH {PAPERS_SQL}, k AS (SELECT *, {DOI} AS d, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS t FROM papers),
b AS (SELECT *, CASE WHEN d <> '' THEN 'd:' || d WHEN t <> '' THEN 't:' || t ELSE 'p:' || pos END AS key FROM k),
f AS (SELECT *, min(pos) OVER (PARTITION BY key) AS kept_pos FROM b)"""


@query(f"{BASELINE_SQL} SELECT pos FROM f WHERE pos = kept_pos")
def dedup_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.baseline(papers(spark, sf_dir)).where("duplicate_reason IS NULL").select("pos")


@query(f"{BASELINE_SQL} SELECT pos, kept_pos, CASE WHEN d <> '' THEN 'same_doi' ELSE 'same_title_no_doi' END AS reason FROM f WHERE pos <> kept_pos")
def dedup_baseline_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.baseline(papers(spark, sf_dir)).where("duplicate_reason IS NOT NULL").select("pos", "kept_pos", F.col("duplicate_reason").alias("reason"))


def merge_sql(view: str, source: str) -> str:
    return f"""WITH RECURSIVE {view}, rec AS (SELECT pos, trim(openalex_id) AS oid, {DOI} AS doi, {STRICT_SQL} AS title FROM {source}),
keys AS (SELECT pos, 'i' AS kind, oid AS key FROM rec WHERE oid <> '' UNION ALL SELECT pos, 'd', doi FROM rec WHERE doi <> '' UNION ALL SELECT pos, 't', title FROM rec WHERE oid = '' AND doi = '' AND title <> ''),
first AS (SELECT kind, key, min(pos) AS first FROM keys GROUP BY ALL),
seen AS (SELECT pos, kind, first FROM keys JOIN first USING (kind, key)),
edges AS (SELECT pos AS a, first AS b FROM seen UNION SELECT first, pos FROM seen),
reach(pos, r) AS (SELECT pos, pos FROM rec UNION SELECT reach.pos, e.b FROM reach JOIN edges e ON e.a = reach.r),
cc AS (SELECT pos, min(r) AS cluster FROM reach GROUP BY pos),
founder AS (SELECT pos, bool_and(first = pos) AS f FROM seen GROUP BY pos),
per AS (SELECT c.pos, c.cluster, coalesce(f, true) AS f FROM cc c LEFT JOIN founder USING (pos)),
bad AS (SELECT cluster, count(*) FILTER (f) > 1 AS conflict FROM per GROUP BY cluster),
why AS (SELECT pos, max(CASE WHEN first < pos THEN CASE kind WHEN 'i' THEN 3 WHEN 'd' THEN 2 ELSE 1 END END) AS w FROM seen GROUP BY pos)"""


@query(
    f"{merge_sql(WORKS_SQL, 'works')} SELECT pos, cluster AS kept_pos, CASE WHEN pos = cluster THEN NULL WHEN w = 3 THEN 'same_openalex_id' WHEN w = 2 THEN 'same_doi' WHEN w = 1 THEN 'same_title_no_id' END AS reason, conflict FROM per JOIN bad USING (cluster) LEFT JOIN why USING (pos)"
)
def dedup_exact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_merge(works(spark, sf_dir)).select("pos", "kept_pos", "reason", "conflict")


@query(
    f"""{merge_sql(WORKS_SQL, 'works')} SELECT CASE w WHEN 3 THEN 'same_openalex_id' WHEN 2 THEN 'same_doi' ELSE 'same_title_no_id' END AS rule, k.openalex_id AS kept_openalex_id, k.title AS kept_title, m.openalex_id AS merged_openalex_id, m.title AS merged_title,
concat(k.source_name, ';', m.source_name) AS source_keyword, concat('r', k.pos % 3, ';r', m.pos % 3) AS source_run_id, 'now' AS merged_at FROM per JOIN why USING (pos) JOIN works m ON m.pos = per.pos JOIN works k ON k.pos = per.cluster WHERE per.pos <> per.cluster"""
)
def exact_duplicate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept on record of each duplicate."""
    rows = works(spark, sf_dir).withColumns({"keyword": F.col("source_name"), "run_id": F.concat(F.lit("r"), (F.col("pos") % 3).cast("string"))})
    found = dedup.duplicate_records(rows, dedup.exact_merge(rows), "now")
    return found.withColumns({c: F.array_join(c, ";") for c in ("source_keyword", "source_run_id")})


@query(f"{merge_sql(PAPERS_SQL, 'papers')} SELECT DISTINCT cluster FROM bad WHERE conflict")
def dedup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters in which a record's identifiers name two entities."""
    return dedup.exact_merge(papers(spark, sf_dir)).where("conflict").select("cluster").distinct()


#: The kept record that a key of x already names, by the order of the keys; a fold over the records in their order holds them.
MET = "list_sort(list_transform(list_filter(a.reg, lambda e: list_contains(x.ks, e.k)), lambda e: {'i': list_position(x.ks, e.k), 'p': e.p, 'k': e.k}))[1]"


@query(
    f"""WITH {PAPERS_SQL}, rec AS (SELECT pos, trim(openalex_id) AS oid, {DOI} AS doi, {STRICT_SQL} AS title FROM papers),
x AS (SELECT pos, list_filter([CASE WHEN oid <> '' THEN 'i' || oid END, CASE WHEN doi <> '' THEN 'd' || doi END, CASE WHEN oid = '' AND doi = '' AND title <> '' THEN 't' || title END], lambda k: k IS NOT NULL) AS ks FROM rec),
r AS (SELECT list({{'pos': pos, 'ks': ks, 'reg': []::STRUCT(k VARCHAR, p BIGINT)[], 'out': []::STRUCT(pos BIGINT, kept_pos BIGINT, k VARCHAR)[]}} ORDER BY pos) AS l FROM (SELECT -1::BIGINT AS pos, []::VARCHAR[] AS ks UNION ALL SELECT * FROM x)),
f AS (SELECT list_reduce(l, lambda a, x: {{'pos': x.pos, 'ks': x.ks,
  'reg': CASE WHEN {MET} IS NULL THEN list_concat(a.reg, list_transform(x.ks, lambda k: {{'k': k, 'p': x.pos}})) ELSE a.reg END,
  'out': list_append(a.out, {{'pos': x.pos, 'kept_pos': coalesce({MET}.p, x.pos), 'k': {MET}.k}})}}) AS z FROM r)
SELECT o.pos, o.kept_pos, CASE left(o.k, 1) WHEN 'i' THEN 'same_openalex_id' WHEN 'd' THEN 'same_doi' WHEN 't' THEN 'same_title_no_id' END AS reason FROM (SELECT unnest(z.out) AS o FROM f)"""
)
def dedup_exact_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_default(papers(spark, sf_dir))


@query("WITH f AS (SELECT lang, source, min(doc_id) AS first FROM documents GROUP BY ALL) SELECT lang, string_agg(source, ';' ORDER BY first) AS sources FROM f GROUP BY lang")
def provenance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of an entity's records, each once, in the order in which they were first seen."""
    d = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("pos"), F.array("source", F.lit("")).alias("sources"))
    return dedup.merge_provenance(d, "lang", "sources").select("lang", F.array_join("sources", ";").alias("sources"))


@query(
    f"""{BASELINE_SQL} SELECT 'raw' AS metric, count(*) AS value FROM f UNION ALL SELECT 'kept', count(*) FROM f WHERE pos = kept_pos
UNION ALL SELECT CASE WHEN d <> '' THEN 'same_doi' ELSE 'same_title_no_doi' END, count(*) FROM f WHERE pos <> kept_pos GROUP BY 1 UNION ALL SELECT 'conserved', 1"""
)
def dedup_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records, those that stay, those that go by reason, and whether they add up."""
    return dedup.counts(dedup.baseline(papers(spark, sf_dir)), table(spark, sf_dir, "documents").count())


@query("SELECT doc_id AS pos, concat('s', doc_id % 499, ';t', doc_id % 331) AS surnames FROM documents")
def author_surnames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("pos", F.array_join(norm.surnames(F.col("authors")), ";").alias("surnames"))


#: Pairs with a common surname or token, by brute force over all pairs.
PAIRS_SQL = rf"""WITH {WORKS_SQL}, f AS (SELECT pos, openalex_id AS oid, {DOI} AS doi, publication_year AS year, {STRICT_SQL} AS title, list_distinct([concat('s', pos % 499), concat('t', pos % 331)]) AS names FROM works),
g AS (SELECT *, list_distinct(list_filter(string_split(title, ' '), lambda t: length(t) >= 2)) AS toks FROM f WHERE title <> ''),
p AS (SELECT a.pos AS i, b.pos AS j, a.oid AS l_oid, b.oid AS r_oid, a.doi AS l_doi, b.doi AS r_doi, coalesce(abs(a.year - b.year), 999) AS years,
  CASE WHEN len(a.toks) + len(b.toks) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.toks, b.toks))::DOUBLE / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) END AS jac,
  len(list_intersect(a.names, b.names))::DOUBLE / (len(a.names) + len(b.names) - len(list_intersect(a.names, b.names))) AS auth
  FROM g a JOIN g b ON a.pos < b.pos WHERE a.oid <> b.oid AND (a.year IS NULL OR b.year IS NULL OR abs(a.year - b.year) <= 2) AND (a.doi = '' OR b.doi = '' OR a.doi = b.doi))"""


@query(
    f"""{PAIRS_SQL} SELECT concat('SP-', substr(md5(concat(l_oid, '|', r_oid)), 1, 8)) AS pair_id, i, j, jac AS title_similarity, auth AS author_overlap, years AS year_difference,
CASE WHEN l_doi = '' AND r_doi = '' THEN 'both_missing' WHEN l_doi = '' OR r_doi = '' THEN 'one_missing' ELSE 'both_present_same' END AS doi_relation,
concat(CASE WHEN jac >= 0.9 THEN 'title_very_high_similarity' WHEN jac >= 0.7 THEN 'title_high_similarity' ELSE 'title_moderate_similarity' END, '|',
  CASE WHEN auth >= 0.7 THEN 'author_high_overlap' WHEN auth >= 0.3 THEN 'author_moderate_overlap' ELSE 'author_low_overlap' END, '|', CASE WHEN years <= 1 THEN 'year_close' WHEN years <= 2 THEN 'year_nearby' ELSE 'year_uncertain' END) AS reason
FROM p WHERE jac >= 0.5 AND (auth >= 0.3 OR jac >= 0.8)"""
)
def suspected_pairs_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspected duplicates by token overlap alone."""
    return dedup.suspected(works(spark, sf_dir), with_sequence=False)


@query()
def suspected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.suspected(works(spark, sf_dir))


@query("SELECT a.doc_id AS pos, len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))) AS jaccard FROM (SELECT doc_id, [lang, source, 'k'] AS x, ['k', source, concat('s', doc_id % 3)] AS y FROM documents) a")
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.array("lang", "source", F.lit("k")), F.array(F.lit("k"), F.col("source"), F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), norm.overlap(x, y).alias("jaccard"))


@query(
    """SELECT doc_id AS pos, CASE doc_id % 5 WHEN 0 THEN 'both_missing' WHEN 1 THEN 'one_missing' WHEN 2 THEN 'both_present_same' WHEN 3 THEN 'one_arxiv_one_publisher' ELSE 'both_present_different' END AS relation FROM documents"""
)
def doi_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("doc_id") % 5).cast("int")
    pick = lambda *v: F.get(F.array(*[F.lit(x) for x in v]), k)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), dedup.doi_relation(pick("", "10.1/a", "10.1/a", "10.48550/x", "10.1/a"), pick("", "", "10.1/a", "10.1/a", "10.1/b")).alias("relation"))


@query(
    """SELECT doc_id AS pos, concat(CASE WHEN j >= 0.9 THEN 'title_very_high_similarity' WHEN j >= 0.7 THEN 'title_high_similarity' ELSE 'title_moderate_similarity' END, '|',
CASE WHEN a >= 0.7 THEN 'author_high_overlap' WHEN a >= 0.3 THEN 'author_moderate_overlap' ELSE 'author_low_overlap' END, '|', CASE WHEN y <= 1 THEN 'year_close' WHEN y <= 2 THEN 'year_nearby' ELSE 'year_uncertain' END, CASE WHEN doc_id % 5 = 3 THEN '|preprint_publisher_pair' ELSE '' END) AS reason
FROM (SELECT doc_id, (n_chars % 100)::DOUBLE / 100 AS j, (n_chars % 37)::DOUBLE / 37 AS a, n_chars % 4 AS y FROM documents)"""
)
def dup_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    relation = F.when(F.col("doc_id") % 5 == 3, "one_arxiv_one_publisher").otherwise("both_missing")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("pos"), dedup.pair_reason((n % 100).cast("double") / 100, F.lit(0.0), (n % 37).cast("double") / 37, n % 4, relation).alias("reason")
    )


@query(
    """WITH q AS (SELECT doc_id AS pair_id, CASE WHEN doc_id % 4 = 0 THEN 'confirmed' ELSE 'pending' END AS review_status FROM documents)
SELECT q.pair_id, CASE WHEN review_status = 'pending' AND quality = 1 THEN 'confirmed' WHEN review_status = 'pending' AND quality = 0 THEN 'distinct' ELSE review_status END AS review_status,
CASE WHEN review_status = 'pending' AND quality = 1 THEN 'merge' WHEN review_status = 'pending' AND quality = 0 THEN 'keep_separate' ELSE '' END AS action FROM q LEFT JOIN labels l ON l.doc_id = q.pair_id"""
)
def apply_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pair_id"), F.when(F.col("doc_id") % 4 == 0, "confirmed").otherwise("pending").alias("review_status"), F.lit("").alias("action"))
    labels = table(spark, sf_dir, "labels")
    said = labels.select(F.col("doc_id").alias("pair_id"), F.when(F.col("quality") == 1, "y").otherwise("N").alias("decision"), F.lit(2).alias("seq"))
    skipped = labels.select(F.col("doc_id").alias("pair_id"), F.lit("s").alias("decision"), F.lit(3).alias("seq"))
    return dedup.apply_reviews(queue, said.unionByName(skipped)).select("pair_id", "review_status", "action")


@query("SELECT 'duplicate_id' AS rule, CAST(o_custkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def unique_id_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(table(spark, sf_dir, "orders"), "o_custkey")
