"""Scans, projections, filters and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.functions import norm
from paperloom.functions.text import keyword_terms, mixed_tokens
from paperloom.operators import checks, terms
from paperloom.operators.rank import ranked
from paperloom.sources import files

from .views import KEYWORD, PAPERS_SQL, papers, query, table


@query("SELECT doc_id AS pos, text AS title, 'kw' AS keyword FROM documents ORDER BY doc_id LIMIT 20")
def scan_json_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first records of a scan, with the keyword they were fetched for; the limit is the operator."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("title"), F.lit("kw").alias("keyword")).orderBy("pos").limit(20)


@query(f"WITH {PAPERS_SQL} SELECT pos, publication_year FROM papers WHERE publication_year BETWEEN 2010 AND 2020")
def filter_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where(F.col("publication_year").between(2010, 2020)).select("pos", "publication_year")


@query("SELECT lang AS query_id, doc_id AS pos FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 10")
def scan_per_query_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").withColumn("r", first).where("r <= 10").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("pos"))


@query("SELECT doc_id AS pos, concat('[\"', source, '\",\"', lang, '\"]') AS encoded, 2 AS n FROM documents")
def json_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays written as compact JSON in one column, and read back."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.to_json(F.array("source", "lang")).alias("encoded"))
    return d.withColumn("n", F.size(F.from_json("encoded", "array<string>")))


@query("SELECT DISTINCT trim(source) AS id FROM documents WHERE trim(source) <> ''")
def distinct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.trim("source").alias("id")).where("id <> ''").distinct()


@query(
    """SELECT rule, key, n FROM (
  SELECT 'duplicate_term' AS rule, lower(term) AS key, count(*) AS n FROM (SELECT p_brand AS term FROM part) GROUP BY lower(term) HAVING count(*) > 1
  UNION ALL SELECT 'bad_strength', CAST(p_partkey AS VARCHAR), p_size FROM part WHERE p_size NOT BETWEEN 1 AND 10)"""
)
def terms_constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term dictionary's rules on the parts: terms unique whatever their case, strengths from 1 to 10."""
    p = table(spark, sf_dir, "part")
    again = p.groupBy(F.lower("p_brand").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_term").alias("rule"), "key", "n")
    return again.unionByName(p.where(~F.col("p_size").between(1, 10)).select(F.lit("bad_strength").alias("rule"), F.col("p_partkey").cast("string").alias("key"), F.col("p_size").cast("long").alias("n")))


@query("SELECT source AS id, arg_max(n_chars, doc_id) AS label FROM documents GROUP BY source")
def labels_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("id")).agg(F.max_by("n_chars", "doc_id").alias("label"))


@query(
    """SELECT CASE WHEN toxic = 1 THEN 'ai_draft' WHEN quality = 0 THEN 'pending_review' ELSE 'kept' END AS reason, count(*) AS n
FROM labels GROUP BY 1"""
)
def labels_policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a label policy drops, counted by the first reason that applies."""
    rows = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, " AI-assisted-draft ").otherwise("a").alias("annotator"), F.when(F.col("quality") == 0, "W1 待人工复核").otherwise("").alias("review_status"))
    kept, dropped = files.label_policy(rows)
    return kept.withColumn("reason", F.lit("kept")).unionByName(dropped).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def labels_untraceable(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id")
    return checks.references(table(spark, sf_dir, "labels"), "doc_id", sample, "doc_id").select(F.col("key").cast("long").alias("doc_id"))


@query(f"WITH {PAPERS_SQL} SELECT openalex_id, max(pos) AS pos, arg_max(title, pos) AS title FROM papers WHERE openalex_id <> '' GROUP BY openalex_id")
def index_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).where("openalex_id <> ''").groupBy("openalex_id").agg(F.max("pos").alias("pos"), F.max_by("title", "pos").alias("title"))


@query(f"WITH {PAPERS_SQL} SELECT pos, CASE WHEN length(title) > 58 THEN concat(substr(title, 1, 55), '...') ELSE title END AS label, cited_by_count FROM papers ORDER BY cited_by_count DESC, pos LIMIT 10")
def top10_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars of a chart; ten is the feature."""
    cut = F.when(F.length("title") > 58, F.concat(F.substring("title", 1, 55), F.lit("..."))).otherwise(F.col("title"))
    return papers(spark, sf_dir).select("pos", cut.alias("label"), "cited_by_count").orderBy(F.desc("cited_by_count"), "pos").limit(10)


@query("SELECT doc_id AS pos, source AS source_name, lang AS first_author, 2 AS n_authors FROM documents")
def project_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record as JSON, read with a schema and projected to flat fields."""
    d = table(spark, sf_dir, "documents")
    person = lambda c: F.struct(F.struct(F.col(c).alias("display_name")).alias("author"))
    raw = F.to_json(F.struct(F.array(person("lang"), person("source")).alias("authorships"), F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location")))
    schema = "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>"
    w = d.select(F.col("doc_id").alias("pos"), F.from_json(raw, schema).alias("w"))
    names = F.transform("w.authorships", lambda a: a["author"]["display_name"])
    return w.select("pos", F.col("w.primary_location.source.display_name").alias("source_name"), F.get(names, 0).alias("first_author"), F.size(names).alias("n_authors"))


@query(r"SELECT doc_id AS pos, array_to_string(regexp_extract_all(text, '[^\s]+'), ' ') AS rebuilt FROM documents")
def rebuild_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to inverted indexes and back."""
    # Texts move to the task of their key, where all that follows is done; words never move.
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text").repartition("pos").select("pos", F.regexp_extract_all("text", F.lit(r"(\S+)"), 1).alias("ws"))
    spots = d.select("pos", F.posexplode("ws").alias("p", "w")).groupBy("pos", "w").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    index = spots.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return norm.rebuild_abstracts(d.select("pos").join(index, "pos", "left"), "pos", "index", "rebuilt")


@query(f"WITH {PAPERS_SQL} SELECT pos, trim(title) AS title, lower(replace(doi, 'https://doi.org/', '')) AS doi, CAST(publication_year AS INTEGER) AS publication_year, CAST(cited_by_count AS INTEGER) AS cited_by_count, authors, 'kw' AS keyword FROM papers")
def clean_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select(
        "pos",
        norm.clean_text(F.col("title")).alias("title"),
        norm.normalize_doi(F.col("doi")).alias("doi"),
        norm.clean_int(F.col("publication_year")).alias("publication_year"),
        norm.clean_int(F.col("cited_by_count")).alias("cited_by_count"),
        norm.clean_text(F.col("authors")).alias("authors"),
        F.coalesce(F.nullif(F.lit(""), F.lit("")), F.lit("kw")).alias("keyword"),
    )


@query("SELECT doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN lang ELSE concat(source, '; ', lang) END AS authors FROM documents")
def clean_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.when(F.col("doc_id") % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("source")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), norm.clean_names(F.array(first, F.col("lang"), F.lit(None).cast("string"))).alias("authors"))


@query("SELECT doc_id AS pos, CASE doc_id % 4 WHEN 0 THEN CAST(n_chars AS INTEGER) WHEN 1 THEN NULL WHEN 2 THEN CAST(n_chars AS INTEGER) ELSE NULL END AS value FROM documents")
def clean_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers in text, with blanks around them; decimals and words in text are null."""
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    raw = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".0"))).when(k == 2, F.concat(F.lit(" "), n, F.lit(" "))).otherwise(F.lit("abc"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), norm.clean_int(raw).alias("value"))


@query("SELECT doc_id AS pos, CASE WHEN doc_id % 5 = 4 THEN concat('https://dx.doi.org/10.1/', lower(lang)) ELSE concat('10.1/', lower(lang)) END AS doi FROM documents")
def normalize_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = F.get(F.array(*[F.lit(p) for p in ("https://doi.org/", "HTTP://doi.org/", "doi.org/", " DOI:", "https://dx.doi.org/")]), (F.col("doc_id") % 5).cast("int"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), norm.normalize_doi(F.concat(prefix, F.lit("10.1/"), F.upper("lang"))).alias("doi"))


@query(rf"WITH {PAPERS_SQL} SELECT pos, regexp_replace(trim(lower(title)), '\s+', ' ', 'g') AS title_key FROM papers")
def title_key_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("pos", norm.title_key(F.col("title")).alias("title_key"))


STRICT_SQL = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(title), '<[^>]+>', '', 'g'), '\[arxiv[^\]]*\]', '', 'g'), 'arxiv:\s*\d{4}\.\d{4,}(v\d+)?', '', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"WITH {PAPERS_SQL} SELECT pos, {STRICT_SQL} AS title_key FROM papers")
def title_key_aggressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("pos", norm.strict_title_key(F.col("title")).alias("title_key"))


@query("SELECT doc_id AS pos, concat('SP-', substr(md5(concat(source, '|', lang)), 1, 8)) AS pair_id FROM documents")
def pair_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), norm.pair_id(F.col("source"), F.col("lang")).alias("pair_id"))


@query(f"WITH {PAPERS_SQL} SELECT pos, title, abstract, '' AS label, '' AS confidence, '' AS reason FROM papers WHERE pos % 6 = 2")
def annotation_task_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an annotator sees of the pairs assigned to them: no score or rank, and empty columns for the answers."""
    p = papers(spark, sf_dir)
    own = p.where(F.col("pos") % 6 == 2).select("pos")
    return p.join(own, "pos", "left_semi").select("pos", "title", "abstract", F.lit("").alias("label"), F.lit("").alias("confidence"), F.lit("").alias("reason"))


@query("SELECT min(doc_id) AS pos, text FROM documents GROUP BY text HAVING list_contains(list(source), 'src0')")
def filter_array_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("text").agg(F.min("doc_id").alias("pos"), F.collect_set("source").alias("sources"))
    return g.where(F.array_contains("sources", "src0")).select("pos", "text")


@query("WITH wanted(query_id, seq) AS (VALUES ('es', 0), ('en', 1), ('xx', 2)) SELECT w.seq, w.query_id, (SELECT count(*) FROM documents d WHERE d.lang = w.query_id) AS rows_found FROM wanted w")
def select_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries in the order in which they were asked for; an unknown one shows as one without rows."""
    wanted = spark.range(1).select(F.posexplode(F.lit(["es", "en", "xx"])).alias("seq", "query_id"))
    n = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("query_id")).agg(F.count("*").alias("n"))
    return wanted.join(n, "query_id", "left").select("seq", "query_id", F.coalesce("n", F.lit(0)).cast("long").alias("rows_found"))


@query(r"SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS valid FROM pages")
def valid_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.try_parse_url(F.col("url"), F.lit("HOST"))
    scheme = F.try_parse_url(F.col("url"), F.lit("PROTOCOL"))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(scheme.isin("http", "https") & host.isNotNull(), F.lit(False)).alias("valid"))


@query("SELECT l.doc_id, d.source FROM labels l JOIN documents d USING (doc_id)")
def join_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with their documents' metadata, all of which are there."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    checks.require(checks.references(labels, "doc_id", docs, "doc_id"))
    return labels.join(docs, "doc_id").select("doc_id", "source")


@query("SELECT d.doc_id, l.quality AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_left_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")


@query("SELECT a.conv_id, a.text AS user_text, b.text AS assistant_text FROM (SELECT conv_id, min(turn) t FROM conversations WHERE role = 'user' GROUP BY conv_id) x JOIN conversations a ON a.conv_id = x.conv_id AND a.turn = x.t JOIN (SELECT conv_id, min(turn) t FROM conversations WHERE role = 'assistant' GROUP BY conv_id) y ON y.conv_id = x.conv_id JOIN conversations b ON b.conv_id = y.conv_id AND b.turn = y.t")
def join_self_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roles of one key side by side, by one aggregation and no join."""
    first = lambda role: F.min_by("text", F.when(F.col("role") == role, F.col("turn")))
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        first("user").alias("user_text"), first("assistant").alias("assistant_text"), F.max((F.col("role") == "user").cast("int")).alias("u"), F.max((F.col("role") == "assistant").cast("int")).alias("a")
    )
    return g.where("u = 1 AND a = 1").select("conv_id", "user_text", "assistant_text")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def anti_unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "left_anti")


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'extra' END AS problem
FROM (SELECT doc_id FROM documents WHERE lang = 'en') d FULL JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL OR l.doc_id IS NULL"""
)
def join_full_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", F.lit(1).alias("d"))
    j = d.join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full_outer")
    return j.where("d IS NULL OR l IS NULL").select("doc_id", F.when(F.col("l").isNull(), "missing").otherwise("extra").alias("problem"))


@query("SELECT 'missing_reference' AS rule, CAST(o_custkey AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20) GROUP BY o_custkey")
def references_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.references(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_nationkey < 20"), "c_custkey")


@query(
    """WITH a AS (SELECT doc_id, lang, source FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'zz' ELSE lang END AS lang, source FROM documents WHERE doc_id % 10 <> 4)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS problem
FROM a FULL JOIN b USING (doc_id) WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.lang IS DISTINCT FROM b.lang OR a.source IS DISTINCT FROM b.source"""
)
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An approved table against its parent, where some rows went, some came and some changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changed = d.withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "zz").otherwise(F.col("lang")))
    return checks.table_diff(d.where("doc_id % 10 <> 3"), changed.where("doc_id % 10 <> 4"), "doc_id", ["lang", "source"])


@query(
    """WITH terms AS (SELECT DISTINCT n_name AS term FROM nation), blueprint AS (SELECT r_regionkey AS query_id, n_name AS term, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey DESC) AS seq FROM region JOIN nation ON n_regionkey = r_regionkey)
SELECT query_id, string_agg(lower(b.term), ' ' ORDER BY seq) AS keyword, count(*) AS n_terms FROM blueprint b JOIN terms t ON lower(b.term) = lower(t.term) GROUP BY query_id"""
)
def build_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries from blueprints of ordered terms and a dictionary, whatever the case of its terms."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    plan = region.join(nation, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")), asc=False).alias("ts"))
    asked = plan.select(F.col("r_regionkey").alias("query_id"), F.posexplode(F.transform("ts", lambda t: t["n_name"])).alias("at", "term"))
    name = F.lower("n_name")
    dictionary = nation.select(name.alias("term_id"), name.alias("term"), name.alias("normalized_term"), F.lit("object_term").alias("category"), F.lit(True).alias("include_in_query")).distinct()
    found, _ = terms.query_sets(asked, dictionary)
    return found.select("query_id", "keyword", F.size("included_terms").cast("long").alias("n_terms"))


@query(f"SELECT list_sort(list_distinct(list_filter(regexp_extract_all(lower(concat(source, ' {KEYWORD}')), '[a-z0-9]+'), lambda x: length(x) >= 2))) AS terms, doc_id AS pos FROM documents")
def keyword_terms_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), F.sort_array(keyword_terms(F.concat("source", F.lit(f" {KEYWORD}")))).alias("terms"))


@query("SELECT doc_id AS pos, len(regexp_extract_all(lower(text), '[a-z0-9]+')) + 3 AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS ascii_md5 FROM documents")
def tokenize_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, and ideographs in pairs: the four appended ones are three tokens."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), mixed_tokens(F.concat("text", F.lit(" 光谱分析"))).alias("ts"))
    return d.select("pos", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join(F.slice("ts", 1, F.size("ts") - 3), " ")).alias("ascii_md5"))


@query("SELECT a.doc_id AS pos, ra.query_ord, CAST(row_number() OVER (PARTITION BY ra.query_ord ORDER BY a.doc_id) AS INTEGER) AS place FROM documents a JOIN (VALUES ('en', 0), ('fr', 1), ('es', 2), ('de', 3)) ra(lang, query_ord) ON a.lang = ra.lang")
def union_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of several queries, one after the other in the order of the queries."""
    d = table(spark, sf_dir, "documents")
    parts = [d.where(F.col("lang") == lang).select(F.col("doc_id").alias("pos"), F.lit(i).alias("query_ord")) for i, lang in enumerate(("en", "fr", "es", "de"))]
    return ranked(reduce(DataFrame.unionByName, parts), "place", [F.asc("pos")], ["query_ord"])


@query("SELECT 'missing' AS side, doc_id FROM (SELECT doc_id FROM documents WHERE lang = 'en' EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'extra', doc_id FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en')")
def set_missing_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    want, have = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    return want.join(have, "doc_id", "left_anti").select(F.lit("missing").alias("side"), "doc_id").unionByName(have.join(want, "doc_id", "left_anti").select(F.lit("extra").alias("side"), "doc_id"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AND (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)) = 0 AS equal")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("a")), table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("b"))
    return a.join(b, "doc_id", "full_outer").agg((F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)) == 0).alias("equal"))


@query("SELECT source, min(doc_id) AS first_pos FROM documents GROUP BY source")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min("doc_id").alias("first_pos"))


@query(r"SELECT doc_id AS pos, regexp_replace(concat('token=', lang, ' failed: password : x', source), '(api[_-]?key|token|password)\s*[:=]\s*\S+', '\1=<redacted>', 'gi') AS message FROM documents")
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), norm.redact(F.concat(F.lit("token="), "lang", F.lit(" failed:\npassword : x"), "source")).alias("message"))
