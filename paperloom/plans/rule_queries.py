"""Contracts and the data-quality gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import checks
from paperloom.sources import digests

from .views import query, table


@query("SELECT 'value_not_allowed' AS rule, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS detail FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.allowed(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"], "o_orderkey")


@query("SELECT 'out_of_range' AS rule, CAST(l_orderkey AS VARCHAR) AS key, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS detail FROM lineitem WHERE CAST(l_quantity AS INTEGER) < 2 OR CAST(l_quantity AS INTEGER) > 49")
def range_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("int").alias("q"))
    return checks.in_range(rows, "q", 2, 49, "l_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id % 9 = 0")
def json_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose JSON doesn't parse: every ninth lacks its closing brace."""
    text = F.concat(F.to_json(F.struct("source", "lang")), F.lit(""))
    broken = F.when(F.col("doc_id") % 9 == 0, F.substring(text, 1, 8)).otherwise(text)
    return table(spark, sf_dir, "documents").select("doc_id", broken.alias("j")).where(F.try_parse_json("j").isNull()).select("doc_id")


@query(
    r"""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]*)"', 1)) AS target FROM pages), known AS (SELECT DISTINCT regexp_extract(url, '^https?://[^/?#]*(/[^?#]*)', 1) AS path FROM pages)
SELECT target, count(*) AS n FROM l WHERE target NOT IN (SELECT path FROM known WHERE path IS NOT NULL) GROUP BY target"""
)
def broken_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local links to paths that no page has, counted before they are looked up."""
    p = table(spark, sf_dir, "pages")
    links = p.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="(/[^"#?]*)"'), 1)).alias("target")).groupBy("target").agg(F.count("*").alias("n"))
    known = p.select(F.regexp_extract("url", r"^https?://[^/?#]*(/[^?#]*)", 1).alias("path")).distinct()
    return links.join(known, F.col("target") == F.col("path"), "left_anti")


SECRET_SQL = r"regexp_matches(text, 'sk-[A-Za-z0-9_-]{20,}') OR regexp_matches(text, 'gh[pousr]_[A-Za-z0-9]{20,}') OR regexp_matches(text, 'AKIA[0-9A-Z]{16}') OR regexp_matches(text, '(?i)(?:api[_-]?key|token|password)\s*[:=]\s*[''" + '"' + r"][A-Za-z0-9_./+-]{16,}[''" + '"' + r"]')"


@query(f"SELECT doc_id FROM documents WHERE {SECRET_SQL}")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(checks.has_secret(F.col("text"))).select("doc_id")


@query(
    f"""WITH v AS (SELECT 'secrets' AS check_name, 'error' AS severity, count(*) AS violations FROM documents WHERE {SECRET_SQL}
UNION ALL SELECT 'order_status', 'warning', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'customer_ids', 'error', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1))
SELECT check_name, severity, violations, CASE WHEN violations > 0 AND severity = 'error' THEN 'failed' WHEN violations > 0 THEN 'warning' ELSE 'passed' END AS status FROM v"""
)
def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate: each check's violations, and whether they fail it or only warn."""
    docs = table(spark, sf_dir, "documents")
    found = checks.summary(
        [
            ("secrets", "error", checks.violations(docs, "secret", checks.has_secret(F.col("text")), F.col("doc_id"))),
            ("order_status", "warning", checks.allowed(table(spark, sf_dir, "orders"), "o_orderstatus", ["F", "O"], "o_orderkey")),
            ("customer_ids", "error", checks.duplicates(table(spark, sf_dir, "customer"), "c_custkey")),
        ]
    )
    some = F.col("violations") > 0
    return found.withColumn("status", F.when(some & (F.col("severity") == "error"), "failed").when(some, "warning").otherwise("passed"))


@query("SELECT doc_id FROM documents WHERE concat('a', doc_id % 6) = concat('a', n_chars % 6)")
def reviewer_independence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements that their own annotator reviewed."""
    name = lambda c: F.concat(F.lit("a"), (F.col(c) % 6).cast("string"))
    return table(spark, sf_dir, "documents").where(name("doc_id") == name("n_chars")).select("doc_id")


@query()
def file_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of a package, of all its tables, with their size and digest; a table's part files are named by the table too."""
    return digests.file_digests(spark, sf_dir, "*.parquet").select(F.regexp_extract("path", r"[^/]+\.parquet(?:/.*)?$", 0).alias("file"), "length", "sha256")


@query("SELECT * FROM (SELECT o_orderkey, concat_ws(',', o_orderstatus, CAST(o_custkey AS VARCHAR), CASE WHEN o_orderkey % 5 = 0 THEN 'extra' END) AS line FROM orders) WHERE len(string_split(line, ',')) > 2")
def csv_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a delimited text with more fields than its header."""
    extra = F.when(F.col("o_orderkey") % 5 == 0, "extra")
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", F.col("o_orderstatus"), F.col("o_custkey").cast("string"), extra).alias("line"))
    return lines.where(F.size(F.split("line", ",", -1)) > 2).select("o_orderkey", "line")
