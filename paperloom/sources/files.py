"""File sources and sinks of paper metadata."""

from __future__ import annotations

import csv
import io
import json
import re
import subprocess
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.functions.norm import clean_int, clean_names, clean_text, is_missing, normalize_doi
from paperloom.operators import checks, contracts

from . import sinks

PAPER = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("publication_year", T.StringType()),
        T.StructField("doi", T.StringType()),
        T.StructField("abstract", T.StringType()),
        T.StructField("cited_by_count", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("openalex_id", T.StringType()),
        T.StructField("landing_page_url", T.StringType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("retrieved_at", T.StringType()),
    ]
)
COLUMNS = tuple(PAPER.fieldNames())
#: Work records as the remote service sends them.
WORK = (
    "id string, doi string, display_name string, publication_year int, cited_by_count bigint, abstract_inverted_index map<string,array<int>>, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<landing_page_url:string,source:struct<display_name:string>>"
)


def numbered(df: DataFrame) -> DataFrame:
    """df with pos in the order of its files; taken at the scan, before anything moves."""
    return df.withColumn("pos", F.monotonically_increasing_id())


def clean(df: DataFrame, keyword: str, retrieved_at: str, *carried: str) -> DataFrame:
    """Paper fields in their order, cleaned; keyword and retrieved_at stand in where a record has none. Carried columns come last."""
    text = lambda c: clean_text(F.col(c)).alias(c)
    instead = lambda c, v: F.when(is_missing(F.col(c)), F.lit(v)).otherwise(clean_text(F.col(c))).alias(c)
    return df.select(
        "pos",
        text("title"),
        text("authors"),
        clean_int(F.col("publication_year")).alias("publication_year"),
        normalize_doi(F.col("doi")).alias("doi"),
        text("abstract"),
        clean_int(F.col("cited_by_count")).cast("long").alias("cited_by_count"),
        text("source_name"),
        text("openalex_id"),
        text("landing_page_url"),
        instead("keyword", keyword),
        instead("retrieved_at", retrieved_at),
        *carried,
    )


def read_json_papers(spark: SparkSession, path: str, keyword: str, limit: int, retrieved_at: str) -> DataFrame:
    """The first ``limit`` records of a JSON array."""
    raw = spark.read.schema(PAPER).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return clean(numbered(raw).orderBy("pos").limit(limit), keyword, retrieved_at)


def read_offline_queries(spark: SparkSession, path: str, limit: int, retrieved_at: str) -> DataFrame:
    """(query_id, pos, paper fields): at most ``limit`` records of each query of {"queries": {id: {"papers": [...]}}}."""
    paper = T.StructType([T.StructField(f.name, T.ArrayType(T.StringType()) if f.name == "authors" else f.dataType) for f in PAPER])
    schema = T.StructType([T.StructField("queries", T.MapType(T.StringType(), T.StructType([T.StructField("papers", T.ArrayType(paper))])))])
    q = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("queries").alias("query_id", "q"))
    rows = q.select("query_id", F.posexplode("q.papers").alias("at", "p")).where(F.col("at") < limit).select("query_id", "at", "p.*")
    rows = rows.withColumn("authors", clean_names(F.col("authors")))
    # Positions leave a query the room of its limit, so no record is numbered across queries.
    names = [r["query_id"] for r in rows.select("query_id").distinct().orderBy("query_id").collect()]
    of_query = F.array_position(F.lit(names), F.col("query_id")) - 1 if names else F.lit(0)
    return clean(rows.withColumn("pos", of_query * limit + F.col("at")), "", retrieved_at, "query_id")


def project_works(works: DataFrame, keyword: str) -> DataFrame:
    """Nested work records (columns of WORK and pos) as flat paper fields."""
    from paperloom.functions.norm import rebuild_abstracts

    abstracts = rebuild_abstracts(works, "pos", "abstract_inverted_index")
    return works.join(abstracts, "pos").select(
        "pos",
        F.col("display_name").alias("title"),
        clean_names(F.transform("authorships", lambda a: a["author"]["display_name"])).alias("authors"),
        F.col("publication_year").cast("string").alias("publication_year"),
        "doi",
        "abstract",
        F.col("cited_by_count").cast("string").alias("cited_by_count"),
        F.col("primary_location.source.display_name").alias("source_name"),
        F.col("id").alias("openalex_id"),
        F.col("primary_location.landing_page_url").alias("landing_page_url"),
        F.lit(keyword).alias("keyword"),
        F.lit(None).cast("string").alias("retrieved_at"),
    )


def check_header(path: str) -> list[str]:
    """The header of a CSV file, without a byte-order mark; blank and repeated names are errors."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        header = next(csv.reader(f), [])
    if not header or any(not h.strip() for h in header) or len(set(header)) < len(header):
        raise ValueError(f"{path}: header {header}")
    return header


def read_strict_csv(spark: SparkSession, path: str, required: Iterable[str] = ()) -> DataFrame:
    """A CSV file as text columns; rows with more fields than the header are an error, shorter ones are filled with nulls."""
    header = check_header(path)
    if missing := set(required) - set(header):
        raise ValueError(f"{path}: without {sorted(missing)}")
    bad = "_corrupt_record"
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, bad]])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).csv(path)
    width = len(header)
    # Spark doesn't read that column alone.
    suspects = df.where(F.col(bad).isNotNull()).select(header[0], bad).toLocalIterator()
    for r in suspects:
        if len(next(csv.reader(io.StringIO(r[1])), [])) > width:
            raise ValueError(f"{path}: a row has more fields than the header")
    return df.drop(bad)


def read_inferred_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file whose types are inferred; what is not a number in a numeric column is null."""
    df = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


#: The columns of a term dictionary and of a file of labels with provenance.
TERM_COLUMNS = ("term_id", "term", "normalized_term", "category", "strength", "include_in_query", "example", "note", "source")
LABEL_COLUMNS = (
    "annotation_id", "openalex_id", "source_query_ids", "title", "label", "reason", "object_type", "task_type", "matched_positive_terms", "matched_negative_terms", "evidence_source", "annotator", "review_status",
)
WORK_ID = r"^https://openalex\.org/W\d+$"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """A term dictionary, whose contract must hold: strength and include_in_query have their types."""
    rows = read_strict_csv(spark, path, TERM_COLUMNS)
    checks.require(contracts.term_violations(rows))
    text = rows.select(*[clean_text(F.col(c)).alias(c) for c in rows.columns])
    return text.withColumns({"strength": F.col("strength").cast("int"), "include_in_query": F.lower("include_in_query") == "true"})


def read_labels(spark: SparkSession, path: str, policy: str = "last") -> DataFrame:
    """(openalex_id, label) of a CSV file. Where an id occurs again, policy ``last`` takes the last row and ``unique`` is an error."""
    rows = read_strict_csv(spark, path, ("openalex_id", "label")).select(clean_text(F.col("openalex_id")).alias("openalex_id"), clean_text(F.col("label")).alias("label"))
    rows = numbered(rows).where("openalex_id <> ''")
    if policy == "unique":
        checks.require(checks.duplicates(rows, "openalex_id"))
    elif policy != "last":
        raise ValueError(f"policy {policy}")
    return rows.groupBy("openalex_id").agg(F.max_by("label", "pos").alias("label"))


def read_reviewed_labels(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(labels, rows dropped by reason): drafts of a machine and rows that wait for a review don't count; an id occurs once."""
    rows = read_strict_csv(spark, path, ("openalex_id", "label"))
    kept, dropped = label_policy(rows)
    checks.require(checks.duplicates(kept, "openalex_id"))
    return kept, {r["reason"]: r["n"] for r in dropped.groupBy("reason").agg(F.count("*").alias("n")).collect()}


def label_policy(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that count, rows that don't with their reason). The draft's annotator and the mark of a pending review."""
    cell = lambda c: clean_text(F.col(c)) if c in rows.columns else F.lit("")
    reason = F.when(F.lower(cell("annotator")) == "ai-assisted-draft", "ai_draft").when(F.contains(cell("review_status"), F.lit("待人工复核")), "pending_review")
    marked = rows.withColumn("reason_", reason)
    return marked.where("reason_ IS NULL").drop("reason_"), marked.where("reason_ IS NOT NULL").withColumnRenamed("reason_", "reason")


def read_provenance_labels(spark: SparkSession, path: str, samples: Iterable[str] = ()) -> DataFrame:
    """Labels with their provenance: ids of the service's form that occur in the sample files, if any are given."""
    rows = read_strict_csv(spark, path, LABEL_COLUMNS).select(*LABEL_COLUMNS)
    oid = clean_text(F.col("openalex_id"))
    parts = [checks.violations(rows, "openalex_id", ~oid.rlike(WORK_ID), F.col("annotation_id"), oid)]
    known = [read_strict_csv(spark, s, ("openalex_id",)).select(clean_text(F.col("openalex_id")).alias("k")).where("k <> ''") for s in samples]
    if known:
        parts.append(checks.references(rows.withColumn("openalex_id", oid), "openalex_id", checks.union(known), "k"))
    parts.append(checks.duplicates(rows, "annotation_id"))
    checks.require(checks.union(parts))
    return rows


def read_research_queries(path: str, count: int = 3) -> list[dict]:
    """The research queries of a JSON file: ``count`` of them, ids once, questions in both languages and the arrays filled."""
    value = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    queries = value.get("queries") if isinstance(value, dict) else None
    if not isinstance(queries, list) or len(queries) != count:
        raise ValueError(f"{path}: {count} queries are needed")
    for q in queries:
        texts = [q.get(k) for k in ("research_query_id", "question_zh", "question_en", "ranking_keyword")]
        lists = [q.get(k) for k in ("acquisition_query_ids", "scope_in", "scope_out")]
        if not all(isinstance(t, str) and t.strip() for t in texts) or not all(isinstance(v, list) and v for v in lists):
            raise ValueError(f"{path}: a query lacks a text or a list")
    if len({q["research_query_id"] for q in queries}) < count:
        raise ValueError(f"{path}: a query occurs twice")
    return queries


#: Folders that hold no files of a project.
SKIPPED = {".git", ".venv", "venv", "env", "__pycache__", ".pytest_cache", "node_modules"}


def list_files(root: str) -> list[str]:
    """The files of a project, as its git index has them, else all under root but those of skipped folders; relative and sorted."""
    base = Path(root)
    try:
        done = subprocess.run(["git", "ls-files", "-z", "--cached", "--others", "--exclude-standard"], cwd=base, capture_output=True, check=True, timeout=60)
        names = [n for n in done.stdout.decode().split("\0") if n and (base / n).is_file()]
    except (OSError, subprocess.SubprocessError):
        names = [str(p.relative_to(base)) for p in base.rglob("*") if p.is_file()]
    return sorted(n for n in names if not SKIPPED & set(Path(n).parts))


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of a project's files; only texts are read, the contents of others are empty."""
    names = list_files(root)
    texts = [n for n in names if re.search(checks.TEXT_SUFFIX, n)]
    others = spark.createDataFrame([(n, "") for n in names if n not in set(texts)], "path string, content string")
    if not texts:
        return others
    base = str(Path(root).resolve())
    found = spark.read.text([f"{base}/{n}" for n in texts], wholetext=True).select(F.url_decode(F.regexp_replace(F.input_file_name(), r"\+", "%2B")).alias("at"), F.col("value").alias("content"))
    return found.select(F.expr(f"substring(at, locate('{base}', at) + {len(base) + 1})").alias("path"), "content").unionByName(others)


def encode_arrays(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as compact JSON, nulls as the empty text: what a CSV cell can hold."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    cell = lambda f: F.to_json(f.name) if isinstance(f.dataType, nested) else F.col(f.name).cast("string")
    return df.select(*[F.coalesce(cell(f), F.lit("")).alias(f.name) for f in df.schema])


def decode_arrays(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Columns of JSON arrays of text as arrays; a cell that isn't one is an error when it is read."""
    read = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.raise_error(F.concat(F.lit(f"{c} is no JSON array: "), F.col(c))).cast("array<string>"))
    return df.withColumns({c: read(c) for c in columns})


def write_csv_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """Part files under path, each with the header; columns that aren't named are left out."""
    encode_arrays(df.select(*columns)).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_csv_file(df: DataFrame, path: str, columns: list[str], bom: bool = True) -> int:
    """One file for spreadsheets, in the order of df's partitions, that appears when it is whole; returns the number of rows."""
    return sinks.save(encode_arrays(df.select(*columns)), "one_csv", path, bom=str(bom).lower())


def write_json(value: object, path: str) -> None:
    """Pretty JSON that appears under its name when it is whole."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(value, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    part.replace(path)


def write_sqlite(df: DataFrame, path: str, table: str = "papers") -> int:
    """Replace the rows of an SQLite table and leave the file's other tables; running it again gives the same file's content."""
    return sinks.save(df, "one_sqlite", path, table=table)


def write_bars(df: DataFrame, value: str, path: str, title: str) -> bool:
    """A bar chart of the ten largest values; False where no plotting library is installed."""
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot
    except ImportError:
        return False
    rows = df.select("title", F.coalesce(value, F.lit(0)).alias("v"), "pos").orderBy(F.desc("v"), "pos").limit(10).collect()
    label = lambda t: t if len(t) <= 58 else f"{t[:55]}..."
    figure, axes = pyplot.subplots(figsize=(10, 6))
    axes.barh([label(r["title"] or "") for r in rows][::-1], [r["v"] for r in rows][::-1])
    axes.set_title(title)
    figure.tight_layout()
    figure.savefig(path)
    pyplot.close(figure)
    return True
