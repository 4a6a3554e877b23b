"""Judged metrics, agreement and annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import agreement, contracts, evaluate
from paperloom.operators.rank import ranked
from paperloom.store import cut

from .rank_queries import ranked_sql, two_stage
from .views import query, table

#: A ranking of each language by length; grades for the labelled part.
RANKING_SQL = """WITH g AS (SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS grade FROM labels),
k AS (SELECT lang AS grp, doc_id, grade, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents LEFT JOIN g USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS condensed, row_number() OVER (PARTITION BY grp ORDER BY grade DESC, rank) AS ideal FROM k WHERE grade IS NOT NULL)"""
R6 = "floor(({}) * 1000000 + 0.5) / 1000000"


def metrics_sql(k: int) -> str:
    return f"""SELECT k.grp, {k} AS k, any_value(c.precision) AS precision, {R6.format('any_value(c.dcg) / nullif(any_value(c.idcg), 0)')} AS ndcg, count(grade) FILTER (rank <= {k}) AS judged_in_top,
count(grade) FILTER (rank <= {k}) / least({k}, count(*))::DOUBLE AS coverage, count(*) FILTER (rank <= {k} AND grade = 0) AS irrelevant_in_top, count(grade) AS judged, {R6.format('avg(rank) FILTER (grade = 2)')} AS average_rank_high
FROM k LEFT JOIN (SELECT grp, avg(CASE WHEN grade >= 1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (condensed <= {k}) AS precision, sum((pow(2, grade) - 1) / log2(condensed + 1)) FILTER (condensed <= {k}) AS dcg, sum((pow(2, grade) - 1) / log2(ideal + 1)) FILTER (ideal <= {k}) AS idcg FROM c GROUP BY grp) c ON c.grp = k.grp GROUP BY k.grp"""


METRICS_SQL = f"{RANKING_SQL}, m AS ({metrics_sql(5)} UNION ALL {metrics_sql(10)})"
COLUMNS = ("grp", "k", "precision", "ndcg", "judged_in_top", "coverage", "irrelevant_in_top", "judged", "average_rank_high")


def rounded6(c: str) -> Column:
    return F.floor(F.col(c) * 1000000 + 0.5) / 1000000


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("quality") == 0, "不相关").when(F.col("toxic") == 1, "部分相关").otherwise("高度相关")
    grades = table(spark, sf_dir, "labels").select("doc_id", evaluate.grade(label).alias("grade"))
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), "doc_id", "n_chars").join(grades, "doc_id", "left")
    return ranked(docs, "rank", [F.desc("n_chars"), F.asc("doc_id")], ["grp"]).drop("n_chars")


def metrics(spark: SparkSession, sf_dir: str, ks: list[int]) -> DataFrame:
    m = evaluate.metrics(ranking(spark, sf_dir), ["grp"], ks)
    return m.withColumns({c: rounded6(c) for c in ("ndcg", "average_rank_high")})


@query("SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS grade FROM labels UNION ALL SELECT -1, NULL")
def label_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("quality") == 0, " 不相关").when(F.col("toxic") == 1, "1").otherwise("高度相关")
    rows = table(spark, sf_dir, "labels").select("doc_id", label.alias("label")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("待讨论").alias("label")))
    return rows.select("doc_id", evaluate.grade(F.col("label")).alias("grade"))


@query(f"{RANKING_SQL} SELECT grp, doc_id, CAST(condensed AS INTEGER) AS condensed, grade FROM c")
def condensed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(ranking(spark, sf_dir).where("grade IS NOT NULL"), "condensed", [F.asc("rank")], ["grp"]).select("grp", "doc_id", "condensed", "grade")


@query(f"{METRICS_SQL} SELECT grp, k, precision FROM m")
def judged_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, [5, 10]).select("grp", "k", "precision")


@query(f"{METRICS_SQL} SELECT grp, k, ndcg FROM m")
def judged_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, [5, 10]).select("grp", "k", "ndcg")


@query(f"{METRICS_SQL} SELECT grp, k, coverage, judged_in_top FROM m")
def coverage_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, [5, 10]).select("grp", "k", "coverage", "judged_in_top")


@query(f"{METRICS_SQL} SELECT grp, k, irrelevant_in_top FROM m")
def irrelevant_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, [5, 10]).select("grp", "k", "irrelevant_in_top")


@query(f"{METRICS_SQL} SELECT DISTINCT grp, average_rank_high FROM m")
def avg_rank_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, [5]).select("grp", "average_rank_high")


@query(f"{METRICS_SQL} SELECT {', '.join(COLUMNS)} FROM m")
def evaluate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir, [5, 10]).select(*COLUMNS)


BOTH_SQL = f"""{ranked_sql('grp')}, lab AS (SELECT doc_id AS pos, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS grade FROM labels),
j AS (SELECT ranked.*, grade FROM ranked LEFT JOIN lab USING (pos)),
k AS (SELECT grp, 'baseline' AS method, pos, old_rank AS rank, grade FROM j UNION ALL SELECT grp, 'two_stage', pos, new_rank, grade FROM j),
c AS (SELECT *, row_number() OVER (PARTITION BY method, grp ORDER BY rank) AS condensed, row_number() OVER (PARTITION BY method, grp ORDER BY grade DESC, rank) AS ideal FROM k WHERE grade IS NOT NULL)"""


def both_metrics_sql(k: int) -> str:
    return f"""SELECT k.method, k.grp, {k} AS k, any_value(c.precision) AS precision, {R6.format('any_value(c.dcg) / nullif(any_value(c.idcg), 0)')} AS ndcg, count(grade) FILTER (rank <= {k}) AS judged_in_top
FROM k LEFT JOIN (SELECT method, grp, avg(CASE WHEN grade >= 1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (condensed <= {k}) AS precision, sum((pow(2, grade) - 1) / log2(condensed + 1)) FILTER (condensed <= {k}) AS dcg, sum((pow(2, grade) - 1) / log2(ideal + 1)) FILTER (ideal <= {k}) AS idcg FROM c GROUP BY method, grp) c ON c.grp = k.grp AND c.method = k.method GROUP BY k.method, k.grp"""


def both_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    # Written, as metrics read a ranking several times.
    j = cut(two_stage(spark, sf_dir, ["grp"], ()).select("grp", "pos", "old_rank", "new_rank").join(grades, "pos", "left"), "both")
    return j.select("grp", "pos", "grade", F.explode(F.array(F.struct(F.lit("baseline").alias("method"), F.col("old_rank").alias("rank")), F.struct(F.lit("two_stage").alias("method"), F.col("new_rank").alias("rank")))).alias("m")).select("grp", "pos", "grade", "m.*")


def both_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluate.metrics(both_rankings(spark, sf_dir), ["method", "grp"], [5, 10])
    return m.withColumn("ndcg", rounded6("ndcg")).select("method", "grp", "k", "precision", "ndcg", "judged_in_top")


@query(f"{BOTH_SQL} {both_metrics_sql(5)} UNION ALL {both_metrics_sql(10)}")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both methods on every group at both cuts."""
    return both_metrics(spark, sf_dir)


@query(
    f"""{BOTH_SQL}, m AS ({both_metrics_sql(5)} UNION ALL {both_metrics_sql(10)}),
x AS (SELECT * FROM m UNION ALL SELECT method, 'macro', k, CASE WHEN count(precision) = count(*) THEN avg(precision) END, CASE WHEN count(ndcg) = count(*) THEN avg(ndcg) END, CAST(sum(judged_in_top) AS BIGINT) FROM m GROUP BY method, k)
SELECT method, grp, k, {R6.format('precision')} AS precision, {R6.format('ndcg')} AS ndcg, judged_in_top FROM x"""
)
def benchmark_metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups' rows and those of their means, which are null if any group's value is."""
    m = both_metrics(spark, sf_dir)
    means = evaluate.macro(m, ["method", "k"], ["precision", "ndcg"]).join(m.groupBy("method", "k").agg(F.sum("judged_in_top").alias("judged_in_top")), ["method", "k"]).withColumn("grp", F.lit("macro"))
    return m.unionByName(means).withColumns({"precision": rounded6("precision"), "ndcg": rounded6("ndcg")})


@query(
    f"""{BOTH_SQL} SELECT grp, pos, array_to_string(list_filter([CASE WHEN grade = 2 AND NOT (old_rank <= 5 AND new_rank <= 5) THEN 'A' END, CASE WHEN grade = 0 AND (old_rank <= 5 OR new_rank <= 5) THEN 'B' END,
CASE WHEN old_rank <= 5 AND old_rank - new_rank <= -5 THEN 'C' END, CASE WHEN new_rank <= 5 AND old_rank - new_rank >= 5 THEN 'D' END,
CASE WHEN (grade = 2 AND old_rank > 5 AND new_rank > 5) OR (grade = 0 AND old_rank <= 5 AND new_rank <= 5) THEN 'E' END], lambda e: e IS NOT NULL), ';') AS error_type FROM j"""
)
def error_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    grades = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    j = two_stage(spark, sf_dir, ["grp"], ()).join(grades, "pos", "left")
    return j.select("grp", "pos", evaluate.error_types(F.col("old_rank"), F.col("new_rank"), F.col("grade")).alias("error_type"))


CONTRACT_SQL = """WITH g AS (SELECT doc_id, CASE WHEN quality = 0 THEN 0 WHEN toxic = 1 THEN 1 ELSE 2 END AS grade FROM labels),
k AS (SELECT lang AS grp, doc_id, grade, CAST(row_number() OVER (PARTITION BY lang ORDER BY CAST(n_chars % 100 AS DOUBLE) / 100 DESC, doc_id) AS INTEGER) AS rank FROM documents LEFT JOIN g USING (doc_id)),
c AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank) AS condensed, row_number() OVER (PARTITION BY grp ORDER BY grade DESC, rank) AS ideal FROM k WHERE grade IS NOT NULL)"""


@query(f"{CONTRACT_SQL}, m AS ({metrics_sql(10)}) SELECT grp, precision, ndcg FROM m")
def evaluate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of an outside method that handed in scores."""
    grades = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade"))
    s = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), "doc_id", ((F.col("n_chars") % 100).cast("double") / 100).alias("score")).join(grades, "doc_id", "left")
    r = ranked(s, "rank", [F.desc("score"), F.asc("doc_id")], ["grp"])
    return evaluate.metrics(r, ["grp"], [10]).select("grp", "precision", rounded6("ndcg").alias("ndcg"))


#: A pool in which some pairs and works repeat, ids are blank and a query is unknown; of the queries one has no pairs.
INPUT_POOL = {
    "pair_id": "CASE WHEN doc_id % 97 = 0 THEN '' WHEN doc_id % 89 = 1 THEN CAST(doc_id - 1 AS STRING) ELSE CAST(doc_id AS STRING) END",
    "research_query_id": "CASE WHEN doc_id % 83 = 0 THEN 'xx' ELSE lang END",
    "openalex_id": "CASE WHEN doc_id % 79 = 0 THEN ' ' ELSE concat('W', doc_id % 900) END",
}
INPUT_QUERIES = ("en", "de", "es", "it")


@query(
    f"""WITH p AS (SELECT {", ".join(f"trim({e}) AS {c}" for c, e in INPUT_POOL.items())} FROM documents WHERE lang <> 'fr')
SELECT rule, pair_id AS key, '' AS detail FROM (SELECT pair_id, unnest([CASE WHEN pair_id = '' THEN 'pair_blank' END, CASE WHEN openalex_id = '' THEN 'work_blank' END, CASE WHEN research_query_id NOT IN {INPUT_QUERIES} THEN 'query_unknown' END]) AS rule FROM p) WHERE rule IS NOT NULL
UNION ALL SELECT 'pair_twice', pair_id, CAST(count(*) AS VARCHAR) FROM p WHERE pair_id <> '' GROUP BY pair_id HAVING count(*) > 1
UNION ALL SELECT 'work_twice', concat(research_query_id, '|', openalex_id), CAST(count(*) AS VARCHAR) FROM p WHERE openalex_id <> '' GROUP BY research_query_id, openalex_id HAVING count(*) > 1
UNION ALL SELECT 'query_missing', q, '' FROM (SELECT unnest({list(INPUT_QUERIES)}) AS q) WHERE q NOT IN (SELECT research_query_id FROM p)
UNION ALL SELECT 'label_unknown', CAST(doc_id AS VARCHAR), '' FROM labels WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT pair_id FROM p)"""
)
def benchmark_input_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool and labels that an evaluation would have to refuse."""
    pool = table(spark, sf_dir, "documents").where("lang <> 'fr'").selectExpr(*[f"{e} AS {c}" for c, e in INPUT_POOL.items()])
    return contracts.benchmark_input_violations(pool, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_id")), INPUT_QUERIES)


#: Two annotators: quality and toxic as labels, some of them undecided.
ANNOTATED_SQL = """WITH ann AS (SELECT l.doc_id AS pair_id, lang AS rq, CASE WHEN l.doc_id % 17 = 0 THEN '?' ELSE CAST(n_chars % 3 AS VARCHAR) END AS label_a, CASE WHEN l.doc_id % 5 = 0 THEN CAST(quality AS VARCHAR) ELSE CAST(n_chars % 3 AS VARCHAR) END AS label_b FROM labels l JOIN documents d USING (doc_id))"""


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    third = (F.col("n_chars") % 3).cast("string")
    return j.select(
        F.col("doc_id").alias("pair_id"), F.col("lang").alias("rq"), F.when(F.col("doc_id") % 17 == 0, "?").otherwise(third).alias("label_a"), F.when(F.col("doc_id") % 5 == 0, F.col("quality").cast("string")).otherwise(third).alias("label_b")
    )


@query(f"{ANNOTATED_SQL} SELECT pair_id, label_a, label_b, CASE WHEN label_a = '?' OR label_b = '?' THEN 'Needs_Discussion_Unknown' ELSE 'Label_Conflict' END AS disagreement_type FROM ann WHERE label_a <> label_b")
def disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.disagreements(annotated(spark, sf_dir)).select("pair_id", "label_a", "label_b", "disagreement_type")


@query(f"{ANNOTATED_SQL} SELECT rq, pair_id, label_a, label_b FROM ann WHERE pair_id % 3 <> 0")
def agreement_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs for which both annotators' files are there."""
    a = annotated(spark, sf_dir)
    expected, first, second = a.select("rq", "pair_id"), a.select("pair_id", "label_a"), a.where("pair_id % 3 <> 0").select("pair_id", "label_b")
    return expected.join(first, "pair_id").join(second, "pair_id")


@query(f"{ANNOTATED_SQL} SELECT pair_id, 'b' AS missing FROM ann WHERE pair_id % 3 = 0")
def agreement_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotated(spark, sf_dir)
    return a.select("pair_id").join(a.where("pair_id % 3 <> 0").select("pair_id"), "pair_id", "left_anti").select("pair_id", F.lit("b").alias("missing"))


def kappa_sql(by: str) -> str:
    g, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    n = "count(*) FILTER (label_a <> '?' AND label_b <> '?')"
    counts = ", ".join(f"count(*) FILTER (label_a <> '?' AND label_b <> '?' AND label_{x} = '{i}') AS {x}{i}" for x in "ab" for i in range(3))
    chance = " + ".join(f"a{i} * b{i}" for i in range(3))
    expected = " + ".join(f"a{i} * b{j} * {(i - j) ** 2}" for i in range(3) for j in range(3))
    square = "coalesce(sum((TRY_CAST(label_a AS INT) - TRY_CAST(label_b AS INT)) * (TRY_CAST(label_a AS INT) - TRY_CAST(label_b AS INT))) FILTER (label_a <> '?' AND label_b <> '?'), 0)"
    return f"""{ANNOTATED_SQL}, t AS (SELECT {g}count(*) AS n, {n} AS eligible, count(*) FILTER (label_a = label_b) AS exact, count(*) FILTER (label_a = label_b AND label_a <> '?') AS same, CAST({square} AS BIGINT) AS square, {counts} FROM ann {group}),
e AS (SELECT *, {chance} AS chance, {expected} AS expected, greatest(a0 + b0, a1 + b1, a2 + b2) = 2 * eligible AS single FROM t)"""


@query(f"{kappa_sql('rq')} SELECT rq, n, exact, exact / n::DOUBLE AS exact_rate FROM e")
def exact_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappas(annotated(spark, sf_dir), ["rq"]).select("rq", "n", "exact", "exact_rate")


@query(f"{kappa_sql('rq')} SELECT rq, eligible, CASE WHEN eligible >= 2 AND NOT single AND expected > 0 THEN (same * eligible - chance) / (eligible * eligible - chance)::DOUBLE END AS kappa FROM e")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappas(annotated(spark, sf_dir), ["rq"]).select("rq", "eligible", "kappa")


@query(f"{kappa_sql('rq')} SELECT rq, CASE WHEN eligible >= 2 AND NOT single AND expected > 0 THEN (expected - square * eligible) / expected::DOUBLE END AS weighted_kappa FROM e")
def weighted_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappas(annotated(spark, sf_dir), ["rq"]).select("rq", "weighted_kappa")


@query(f"{ANNOTATED_SQL} SELECT coalesce(rq, 'all') AS rq, count(*) AS n, count(*) FILTER (label_a = label_b) AS exact FROM ann GROUP BY ROLLUP (rq)")
def agreement_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups and the whole in one aggregation."""
    g = annotated(spark, sf_dir).rollup("rq").agg(F.count("*").alias("n"), F.count(F.when(F.col("label_a") == F.col("label_b"), 1)).alias("exact"))
    return g.withColumn("rq", F.coalesce("rq", F.lit("all")))
