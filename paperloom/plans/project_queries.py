"""The gate over a project's files, and where packages come from. Files and packages are made of the table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import checks, gate, lineage

from .contract_queries import Columns, cte, listed, many, rows
from .views import query

#: Files of ten kinds, with faults of every kind in some.
PATH = """CASE doc_id % 10 WHEN 0 THEN concat('docs/', doc_id, '/page.md') WHEN 1 THEN concat('conf/', doc_id, '.json') WHEN 2 THEN concat('data/samples/s', doc_id, '.csv')
WHEN 3 THEN concat('data/manual/labels_w2_', doc_id, '.csv') WHEN 4 THEN concat('data/manual/old_', doc_id, '.csv') WHEN 5 THEN concat('outputs/runs/', doc_id, '/run_config.json')
WHEN 6 THEN concat('tests/fixtures/invalid/', doc_id, '.json') WHEN 7 THEN concat('src/m', doc_id, '.py') WHEN 8 THEN concat('outputs/experiments/e', doc_id % 40, '/', doc_id, '.txt')
ELSE concat('data/annotation_tasks/w4/t', doc_id, '.csv') END"""
TEXT = """CASE doc_id % 10
WHEN 0 THEN concat('# ', lang, chr(10), '[a](../', doc_id + 10 + CASE WHEN doc_id % 30 = 0 THEN 1 ELSE 0 END, '/page.md) and [b](<../', doc_id, '/./page.md> "t") ![c](/docs/', doc_id + 20, '/../', doc_id, '/page.md#top)',
  '[d](https://x.org/', doc_id, ') [e](#here) [f](../../src/m', doc_id + 7, '.py "title") [g](../../docs) [h](no%20such.md) [i](../../../out.md) [j](../../conf/', doc_id + 1, '%2Ejson)')
WHEN 1 THEN CASE WHEN doc_id % 70 = 1 THEN '{"a": ' ELSE concat('{"a": ', doc_id, '}') END
WHEN 2 THEN concat('openalex_id,title', chr(10), 'W', doc_id, ',t', chr(10), 'W', CASE WHEN doc_id % 60 = 2 THEN doc_id ELSE doc_id + 1 END, ',u', chr(10))
WHEN 3 THEN concat('annotation_id,openalex_id,label,precision', chr(10), 'A', doc_id, ',W', doc_id - 1, ',高度相关,0.5', chr(10), CASE WHEN doc_id % 50 = 3 THEN '' ELSE concat('B', doc_id) END, ',W', CASE WHEN doc_id % 40 = 3 THEN doc_id + 3 ELSE doc_id END, ',',
  CASE WHEN doc_id % 90 = 3 THEN 'odd' ELSE '待讨论' END, ',', CASE WHEN doc_id % 80 = 3 THEN '1.5' WHEN doc_id % 110 = 3 THEN 'high' ELSE '' END, chr(10), CASE WHEN doc_id % 130 = 3 THEN concat('ragged', chr(10)) ELSE '' END)
WHEN 4 THEN concat('openalex_id,note', chr(10), 'W', doc_id - 2, ',a', chr(10), 'W', doc_id + 5, ',b', chr(10), CASE WHEN doc_id % 20 = 4 THEN concat('W', doc_id - 2, ',again', chr(10)) ELSE '' END)
WHEN 5 THEN concat('{"run_id": "r', doc_id, '", "created_at": "2026", "mode": "', CASE WHEN doc_id % 30 = 5 THEN '' ELSE 'offline' END, '", "keyword": ', CASE WHEN doc_id % 70 = 5 THEN 'null' ELSE '"k"' END, ', "max_results": ', n_chars, ', "status": "',
  CASE WHEN doc_id % 40 = 5 THEN 'odd' ELSE 'completed' END, '"', CASE doc_id % 3 WHEN 0 THEN ', "success": "true"' WHEN 1 THEN ', "success": true' ELSE '' END, '}')
WHEN 6 THEN '{broken'
WHEN 7 THEN concat('x = 1', CASE WHEN doc_id % 40 = 7 THEN concat(chr(10), 'api_key = "', 'abcdefghijklmnop', doc_id, '"') ELSE '' END, CASE WHEN doc_id % 60 = 7 THEN ' # /home/u/x' ELSE '' END)
WHEN 8 THEN 'result'
ELSE concat('annotation_id,label', chr(10), 'A,2', chr(10), 'B,', CASE WHEN doc_id % 20 = 9 THEN '高度相关' ELSE '?' END, chr(10), CASE WHEN doc_id % 60 = 9 THEN concat('B,1', chr(10)) ELSE '' END) END"""
FILES: Columns = {"path": PATH, "content": TEXT}

#: SQL: Markdown links with their targets, and the paths that these lead to.
LINKS_SQL = r"""raw AS (SELECT path, trim(unnest(regexp_extract_all(content, '!?\[[^\]]*\]\(([^)]+)\)', 1))) AS r FROM f WHERE path LIKE '%.md'),
linked AS (SELECT path, CASE WHEN r LIKE '<%>%' THEN trim(string_split(substr(r, 2), '>')[1]) ELSE string_split(r, ' "')[1] END AS t FROM raw),
target AS (SELECT path, url_decode(string_split(t, '#')[1]) AS target FROM linked WHERE NOT regexp_matches(t, '^(https?://|mailto:|ftp://|#)') AND string_split(t, '#')[1] <> ''),
led AS (SELECT path, target, array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(CASE WHEN target LIKE '/%' THEN target ELSE regexp_extract(path, '^(.*/)[^/]*$', 1) || target END, '/'), lambda s: [s])),
  lambda acc, s: CASE WHEN s[1] IN ('', '.') THEN acc WHEN s[1] = '..' AND len(acc) > 0 AND acc[-1] <> '..' THEN acc[:-2] ELSE list_concat(acc, s) END), '/') AS led FROM target),
known AS (SELECT DISTINCT array_to_string(string_split(path, '/')[1:unnest(range(1, len(string_split(path, '/')) + 1))], '/') AS k FROM f),
broken AS (SELECT 'broken_link' AS rule, path AS key, target AS detail FROM led WHERE led <> '' AND led NOT IN (SELECT k FROM known))"""
CONFIG_RULES = [
    *[(f"{c}_missing", f"coalesce(json_extract_string(content, '$.{c}'), '') = ''") for c in ("run_id", "created_at", "mode", "keyword", "max_results", "status")],
    ("status_value", "coalesce(json_extract_string(content, '$.status'), '') NOT IN ('running', 'completed', 'failed')"),
    ("success_type", "json_type(content, '$.success') <> 'BOOLEAN'"),
]
#: SQL: cells of the CSV files, of which no cell has a comma or a quote.
CELLS_SQL = r"""csv AS (SELECT path, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS ls FROM f WHERE path LIKE '%.csv'),
lines AS (SELECT path, string_split(ls[1], ',') AS header, unnest(range(2, len(ls) + 1)) AS i, string_split(ls[i], ',') AS cells FROM csv),
ragged AS (SELECT path, i FROM lines WHERE len(cells) <> len(header)),
c AS (SELECT path, i, unnest(header) AS name, unnest(cells) AS value FROM lines WHERE path NOT IN (SELECT path FROM ragged)),
samples AS (SELECT DISTINCT value FROM c WHERE name = 'openalex_id' AND path LIKE '%data/samples/%'),
lost AS (SELECT path, i FROM c WHERE name = 'openalex_id' AND path LIKE '%data/manual/%' AND value NOT IN (SELECT value FROM samples)),
ids AS (SELECT * FROM c WHERE name = 'annotation_id' OR (name = 'openalex_id' AND regexp_matches(path, '^data/(samples|manual)/'))),
cells AS (SELECT 'row_width' AS rule, path AS key, CAST(i AS VARCHAR) AS detail, 'error' AS severity FROM ragged
UNION ALL SELECT 'id_blank', path, concat(i, ':', name), 'error' FROM ids WHERE value = ''
UNION ALL SELECT 'id_twice', path, concat(count(value) - count(DISTINCT value), ':', name), 'error' FROM ids WHERE value <> '' GROUP BY path, name HAVING count(value) > count(DISTINCT value)
UNION ALL SELECT 'label', path, concat(i, ':', name), 'error' FROM c WHERE name = 'label' AND NOT (CASE WHEN path LIKE 'data/annotation_tasks/%' THEN value IN ('0', '1', '2', '?') ELSE value IN ('高度相关', '部分相关', '不相关', '待讨论') END)
UNION ALL SELECT 'score', path, concat(i, ':', name), 'error' FROM c WHERE name = 'precision' AND value <> '' AND coalesce(TRY_CAST(value AS DOUBLE) NOT BETWEEN 0 AND 1, true)
UNION ALL SELECT 'reference', path, concat(i, ':openalex_id'), 'error' FROM lost WHERE path LIKE '%w2%' UNION ALL SELECT 'old_reference', path, CAST(count(*) AS VARCHAR), 'warning' FROM lost WHERE path NOT LIKE '%w2%' GROUP BY path)"""
BASIC_SQL = """SELECT 'folder_missing' AS rule, 'app' AS key, '' AS detail, 'error' AS severity UNION ALL SELECT *, 'error' FROM broken
UNION ALL SELECT 'json_invalid', path, '', 'error' FROM f WHERE path LIKE '%.json' AND path NOT LIKE 'tests/%' AND NOT json_valid(content)
UNION ALL SELECT 'secret', path, '', 'error' FROM f WHERE path LIKE '%.py' AND content LIKE '%api_key%' UNION ALL SELECT 'personal_path', path, '', 'error' FROM f WHERE path LIKE '%.py' AND content LIKE '%/home/%'"""
CONFIG_SQL = f"configs AS (SELECT concat('run_config_', rule) AS rule, key, detail FROM ({listed(CONFIG_RULES, 'path', '''(SELECT * FROM f WHERE path LIKE '%/run_config.json')''')}))"
FULL_SQL = f"{BASIC_SQL} UNION ALL SELECT *, 'error' FROM configs UNION ALL SELECT * FROM cells UNION ALL SELECT 'tracked_experiment', path, '', 'warning' FROM f WHERE path LIKE 'outputs/experiments/%'"
GATE_SQL = f"WITH {cte('f', FILES)}, {LINKS_SQL}, {CONFIG_SQL}, {CELLS_SQL}"


@query(f"WITH {cte('f', FILES)}, {LINKS_SQL} SELECT * FROM broken")
def markdown_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.broken_links(rows(spark, sf_dir, FILES))


@query(f"WITH {cte('f', FILES)}, {CONFIG_SQL} SELECT * FROM configs")
def run_config_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.run_config_violations(rows(spark, sf_dir, FILES))


@query(f"{GATE_SQL} {FULL_SQL}")
def project_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the full gate finds."""
    return gate.gate(rows(spark, sf_dir, FILES), gate.FULL)


@query(
    f"""{GATE_SQL}, v AS (SELECT 'basic' AS level, * FROM ({BASIC_SQL}) UNION ALL SELECT 'full', * FROM ({FULL_SQL}))
SELECT level, rule, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, CASE WHEN count(*) FILTER (severity = 'error') > 0 THEN 'failed' ELSE 'warning' END AS status FROM v GROUP BY level, rule"""
)
def gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each level of the gate says."""
    files = rows(spark, sf_dir, FILES)
    return checks.union([gate.summary(gate.gate(files, level)).select(F.lit(level).alias("level"), "rule", "errors", "warnings", "status") for level in (gate.BASIC, gate.FULL)])


#: Packages in chains, some of which end on a cycle or at a parent that isn't there.
PACKAGE: Columns = {
    "id": "doc_id",
    "parent": "CASE WHEN doc_id % 400 = 0 THEN NULL WHEN doc_id % 397 = 1 THEN doc_id + 1 WHEN doc_id % 397 = 2 THEN doc_id - 1 WHEN doc_id % 389 = 5 THEN -doc_id WHEN doc_id % 383 = 9 THEN doc_id ELSE doc_id - 1 - doc_id % 3 END",
    "status": "CASE WHEN doc_id % 61 = 0 THEN 'odd' WHEN doc_id % 2 = 0 THEN 'approved' ELSE 'proposed' END",
    "version": "CASE WHEN doc_id % 41 = 0 THEN 'v1-DRAFT' WHEN doc_id % 2 = 0 THEN 'v1' WHEN doc_id % 43 = 0 THEN 'v0' ELSE concat('v', doc_id % 5, '-draft') END",
    "inputs": "concat('i', doc_id % 400 - doc_id % 7)",
    "judgements": "CASE WHEN doc_id % 37 = 0 THEN 'j' ELSE concat('j', doc_id % 11) END",
    "proposals": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('p', doc_id % 13) END",
    "parent_version": "CASE WHEN doc_id % 31 = 0 THEN NULL ELSE concat('v', (doc_id - 1) % 5, '-draft') END",
    "parent_inputs": "concat('i', doc_id % 400 - doc_id % 7)",
}
AUDIT_OF: Columns = {
    "description": f"CASE WHEN doc_id % 29 = 0 THEN 'other' ELSE '{lineage.AUDIT}' END",
    "blind_first": "CASE WHEN doc_id % 23 = 0 THEN NULL ELSE doc_id % 19 <> 0 END",
    "reviewers_checked": "doc_id % 17 <> 0",
    "required": "CASE WHEN doc_id % 21 = 0 THEN 0 WHEN doc_id % 22 = 0 THEN NULL ELSE 6 END",
    "completed": "CASE WHEN doc_id % 26 = 0 THEN 5 WHEN doc_id % 21 = 0 THEN 0 ELSE 6 END",
    "files": "concat('review_queue;blind_manifest;comparison_summary;human_ai_comparison', CASE WHEN doc_id % 25 = 0 THEN '' ELSE ';blind_audit' END)",
}
NO_AUDIT = "doc_id % 27 = 0"
P = "p.id IS NOT NULL AND x.status = 'approved'"
A = f"x.status = 'approved' AND NOT x.{NO_AUDIT}"
PACKAGE_RULES = [
    ("status", "x.status = 'odd'"),
    ("parent_needed", "x.status = 'approved' AND x.parent IS NULL"),
    ("parent_invented", "x.status = 'proposed' AND x.parent IS NOT NULL"),
    ("parent_unknown", "x.parent IS NOT NULL AND p.id IS NULL"),
    ("own_parent", "x.parent = x.id"),
    ("parent_no_draft", f"{P} AND (p.status <> 'proposed' OR lower(p.version) NOT LIKE '%draft%')"),
    ("approved_draft", "x.status = 'approved' AND lower(x.version) LIKE '%draft%'"),
    ("parent_version", f"{P} AND x.parent_version IS DISTINCT FROM p.version"),
    ("parent_inputs", f"{P} AND x.parent_inputs <> p.inputs"),
    ("inputs_drift", f"{P} AND x.inputs <> p.inputs"),
    ("judgements_not_new", f"{P} AND x.judgements = p.judgements"),
    ("proposals_not_new", f"{P} AND x.proposals IS NOT DISTINCT FROM p.proposals"),
    ("audit_missing", f"x.status = 'approved' AND x.{NO_AUDIT}"),
    ("audit_description", f"{A} AND x.description = 'other'"),
    ("audit_not_blind", f"{A} AND NOT coalesce(x.blind_first AND x.reviewers_checked, false)"),
    ("audit_reviews", f"{A} AND NOT coalesce(x.required > 0 AND x.completed = x.required, false)"),
    ("audit_files", f"{A} AND len(string_split(x.files, ';')) <> 5"),
]


@query(
    f"""WITH {cte("x", PACKAGE | AUDIT_OF | {"doc_id": "doc_id"})} {listed(PACKAGE_RULES, "CAST(x.id AS VARCHAR)", "x LEFT JOIN x p ON x.parent = p.id")}
UNION ALL {many("id_twice", "x", "id")}"""
)
def package_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages against their parents, and their audits."""
    made = rows(spark, sf_dir, PACKAGE | AUDIT_OF | {"none": NO_AUDIT}).withColumn("files", F.split("files", ";"))
    return lineage.package_violations(made.withColumn("audit", F.when(~F.col("none"), F.struct(*AUDIT_OF))))


@query(
    f"""WITH RECURSIVE {cte("x", PACKAGE)}, e AS (SELECT x.id AS a, p.id AS b FROM x JOIN x p ON x.parent = p.id),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
n AS (SELECT a, count(*) AS depth, max(b) FILTER (b NOT IN (SELECT a FROM e)) AS root FROM r GROUP BY a),
s AS (SELECT x.id, x.parent, n.a IS NULL AS is_root, coalesce(n.root, CASE WHEN n.a IS NULL THEN x.id END) AS root, coalesce(n.depth, 0) AS depth FROM x LEFT JOIN n ON n.a = x.id)
SELECT s.id, s.root, CASE WHEN s.root IS NOT NULL THEN s.depth END AS depth, CASE WHEN s.root IS NULL THEN 'cycle' WHEN t.parent IS NULL THEN 'rooted' ELSE 'parent_missing' END AS state FROM s LEFT JOIN x t ON t.id = s.root"""
)
def package_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root of each package's chain of parents, and how far it is."""
    return lineage.lineage(rows(spark, sf_dir, PACKAGE))
