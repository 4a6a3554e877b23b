"""Contracts of pools, assignments, annotations, proposals, judgements, terms and files, on tables with planted faults.

The tables are expressions over the documents, one text for both engines; the rules are the library's on one side and SQL on the other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import checks, contracts

from . import benchmark, package
from .views import query, table

Columns = dict[str, str]
#: A pool without faults, on which the other tables build, and one with some.
POOL: Columns = {
    "pair_id": "concat('P', doc_id)",
    "research_query_id": "concat('RQ-', lang)",
    "openalex_id": "concat('W', doc_id % 900)",
    "title": "concat('title ', doc_id)",
    "landing_page_url": "concat('https://example.org/', doc_id)",
    "pool_version": "'v1'",
}
FAULTY_POOL = POOL | {
    "pair_id": "CASE WHEN doc_id % 211 = 0 THEN ' ' WHEN doc_id % 199 = 1 THEN concat('P', doc_id - 1) ELSE concat('P', doc_id) END",
    "pool_version": "CASE WHEN doc_id % 97 = 0 THEN 'v0' ELSE 'v1' END",
}
PRIMARY: Columns = {
    "pair_id": "CASE WHEN doc_id % 127 = 0 THEN concat('X', doc_id) ELSE concat('P', doc_id) END",
    "annotator_slug": "CASE WHEN doc_id % 67 = 0 THEN 'zz' ELSE concat('a', doc_id % 6) END",
    "annotator_name": "CASE WHEN doc_id % 83 = 0 THEN 'Nobody' ELSE concat('Name ', doc_id % 6) END",
    "assignment_role": "CASE WHEN doc_id % 101 = 0 THEN 'helper' ELSE 'primary' END",
}
SECOND = "CASE WHEN doc_id % 71 = 0 THEN doc_id % 6 ELSE (doc_id % 6 + 1 + CAST(floor(doc_id / 6) AS INT) % 5) % 6 END"
SECONDARY: Columns = {"pair_id": "concat('P', doc_id)", "annotator_slug": f"concat('a', {SECOND})", "annotator_name": f"concat('Name ', {SECOND})", "assignment_role": "'secondary'"}
TASK: Columns = {
    "pair_id": "CASE WHEN doc_id % 131 = 0 THEN concat('P', doc_id + 1) ELSE concat('P', doc_id) END",
    "research_query_id": "CASE WHEN doc_id % 103 = 0 THEN 'RQ-xx' ELSE concat('RQ-', lang) END",
    "openalex_id": "concat('W', doc_id % 900)",
    "title": "CASE WHEN doc_id % 107 = 0 THEN 'other' ELSE concat('title ', doc_id) END",
    "landing_page_url": "CASE WHEN doc_id % 109 = 0 THEN 'ftp://x' ELSE concat('https://example.org/', doc_id) END",
    "annotator": "CASE WHEN doc_id % 113 = 0 THEN 'zz' ELSE concat('a', doc_id % 6) END",
    "label": "CASE doc_id % 17 WHEN 0 THEN 'x' WHEN 1 THEN '?' WHEN 2 THEN ' 1 ' ELSE CAST(doc_id % 3 AS STRING) END",
    "confidence": "CASE WHEN doc_id % 19 = 0 THEN 'sure' ELSE 'high' END",
    "evidence_level": "CASE WHEN doc_id % 23 = 4 THEN 'D' WHEN doc_id % 5 IN (0, 4) THEN 'A' WHEN doc_id % 5 = 2 THEN 'C' ELSE 'B' END",
    "reason": "CASE WHEN doc_id % 29 = 0 THEN ' ' ELSE 'because' END",
    "source_checked": "CASE doc_id % 7 WHEN 0 THEN ' ; ' WHEN 1 THEN 'title_abstract' WHEN 2 THEN 'title_abstract; arxiv' WHEN 3 THEN 'arxiv;arxiv' WHEN 4 THEN 'pdf_fulltext ; publisher' WHEN 5 THEN 'blog' ELSE 'title_abstract' END",
    "evidence_url": "CASE doc_id % 11 WHEN 0 THEN '' WHEN 1 THEN 'https://a.org/1;ftp://b' ELSE 'https://a.org/1; https://b.org' END",
    "ai_assistance": "CASE WHEN doc_id % 31 = 0 THEN 'all' ELSE 'none' END",
}
LABEL_A, LABEL_B = "CAST(doc_id % 3 AS STRING)", "CAST((doc_id + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END) % 3 AS STRING)"
SECOND_CLEAN = "(doc_id % 6 + 1 + CAST(floor(doc_id / 6) AS INT) % 5) % 6"
NOTE_A: Columns = {"pair_id": "concat('P', doc_id)", "annotator": "concat('a', doc_id % 6)", "label": LABEL_A, "ai_assistance": "'none'", "reason": "concat('r', doc_id)"}
NOTE_B = NOTE_A | {"annotator": f"concat('a', {SECOND_CLEAN})", "label": LABEL_B, "reason": "concat('s', doc_id)"}
APART = "(doc_id % 8 = 0)"
PROPOSAL: Columns = {
    "pair_id": "CASE WHEN doc_id % 137 = 0 THEN '' ELSE concat('P', doc_id) END",
    "research_query_id": "CASE WHEN doc_id % 9 = 1 THEN 'RQ-xx' WHEN doc_id % 31 = 2 THEN NULL ELSE concat('RQ-', lang) END",
    "openalex_id": "CASE WHEN doc_id % 13 = 2 THEN 'W0x' WHEN doc_id % 29 = 2 THEN NULL ELSE concat('W', doc_id % 900) END",
    "title": "CASE WHEN doc_id % 14 = 2 THEN 'other' ELSE concat('title ', doc_id) END",
    "annotator_a": "CASE WHEN doc_id % 15 = 1 THEN 'zz' ELSE concat('a', doc_id % 6) END",
    "label_a": f"CASE WHEN doc_id % 17 = 1 THEN '9' ELSE {LABEL_A} END",
    "reason_a": "concat('r', doc_id)",
    "annotator_b": f"concat('a', {SECOND_CLEAN})",
    "label_b": LABEL_B,
    "reason_b": "CASE WHEN doc_id % 19 = 1 THEN '' ELSE concat('s', doc_id) END",
    "proposed_final_label": "CASE WHEN doc_id % 21 = 1 THEN '?' ELSE CAST(doc_id % 3 AS STRING) END",
    "proposal_reason": "CASE WHEN doc_id % 23 = 1 THEN ' ' ELSE 'why' END",
    "evidence_level": "'A'",
    "evidence_sources": "CASE WHEN doc_id % 25 = 1 THEN '' ELSE 'title_abstract' END",
    "confidence": "'high'",
    "proposal_status": "CASE WHEN doc_id % 27 = 1 THEN 'open' WHEN doc_id % 16 = 0 THEN 'reviewed' ELSE 'pending_human_review' END",
    "review_decision": "CASE WHEN doc_id % 16 <> 0 THEN CASE WHEN doc_id % 29 = 1 THEN 'approve' ELSE '' END WHEN doc_id % 7 = 1 THEN 'skip' WHEN doc_id % 3 = 0 THEN 'modify' ELSE 'approve' END",
    "reviewed_label": "CASE WHEN doc_id % 16 <> 0 THEN '' WHEN doc_id % 11 = 1 THEN '?' WHEN doc_id % 5 = 0 THEN CAST((doc_id + 1) % 3 AS STRING) ELSE CAST(doc_id % 3 AS STRING) END",
    "reviewer": "CASE WHEN doc_id % 16 <> 0 OR doc_id % 10 = 4 THEN '' ELSE concat('a', (doc_id + 3) % 7) END",
    "reviewed_at": "CASE WHEN doc_id % 16 <> 0 THEN '' WHEN doc_id % 9 = 2 THEN '2026-01-02T03:04:05' WHEN doc_id % 9 = 4 THEN '2026-01-02T99:99:99+08:00' WHEN doc_id % 9 = 6 THEN '2026-01-02T03:04:05+99:99' WHEN doc_id % 9 = 7 THEN '2026-02-30T23:59+0530' ELSE '2026-01-02T03:04:05+08:00' END",
    "review_note": "CASE WHEN doc_id % 16 <> 0 THEN '' ELSE 'seen' END",
}
JUDGEMENT: Columns = {
    "pair_id": "CASE WHEN doc_id % 139 = 0 THEN concat('P', doc_id + 1) ELSE concat('P', doc_id) END",
    "research_query_id": "CASE WHEN doc_id % 103 = 0 THEN 'RQ-xx' ELSE concat('RQ-', lang) END",
    "openalex_id": "CASE WHEN doc_id % 107 = 0 THEN 'W0x' WHEN doc_id % 111 = 5 THEN NULL ELSE concat('W', doc_id % 900) END",
    "final_label": f"CASE WHEN doc_id % 61 = 0 THEN '?' WHEN {APART} AND doc_id % 16 <> 0 THEN CASE WHEN doc_id % 5 = 1 THEN '1' ELSE '' END WHEN {APART} AND doc_id % 5 = 0 THEN CAST((doc_id + 1) % 3 AS STRING) WHEN doc_id % 37 = 0 AND doc_id % 5 > 1 THEN CAST((doc_id + 1) % 3 AS STRING) WHEN doc_id % 59 = 0 THEN '0' ELSE {LABEL_A} END",
    "proposed_label": f"CASE WHEN doc_id % 73 = 0 THEN '7' WHEN {APART} AND doc_id % 11 <> 1 THEN CAST(doc_id % 3 AS STRING) ELSE '' END",
    "judgement_status": f"CASE WHEN doc_id % 47 = 0 THEN 'odd' WHEN {APART} THEN CASE WHEN doc_id % 43 = 0 THEN 'ready' WHEN doc_id % 16 = 0 THEN 'adjudicated' ELSE 'pending_human_review' END WHEN doc_id % 37 = 0 THEN 'adjudicated' WHEN doc_id % 41 = 0 THEN 'pending_human_review' ELSE 'ready' END",
    "agreement_status": f"CASE WHEN doc_id % 53 = 0 THEN 'agreement' WHEN doc_id % 57 = 1 THEN NULL WHEN doc_id % 2 = 1 THEN 'single_annotation' WHEN {APART} THEN 'disagreement' ELSE 'agreement' END",
    "judgement_basis": f"CASE WHEN doc_id % 79 = 0 THEN 'none' WHEN doc_id % 63 = 1 THEN NULL WHEN {APART} THEN 'ai_adjudication_proposal' WHEN doc_id % 37 = 0 THEN 'blind_ai_audit_human_review' WHEN doc_id % 2 = 1 THEN 'primary_annotation' ELSE 'double_annotation_agreement' END",
    "primary_annotator": "CASE WHEN doc_id % 83 = 0 THEN 'zz' ELSE concat('a', doc_id % 6) END",
    "primary_label": f"CASE WHEN doc_id % 89 = 0 THEN '?' WHEN doc_id % 91 = 3 THEN NULL ELSE {LABEL_A} END",
    "primary_ai_assistance": "CASE WHEN doc_id % 97 = 0 THEN 'all' WHEN doc_id % 33 = 0 THEN 'translation' ELSE 'none' END",
    "secondary_annotator": f"CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 101 = 0 THEN 'zz' ELSE concat('a', {SECOND_CLEAN}) END WHEN doc_id % 35 = 0 THEN 'a1' ELSE '' END",
    "secondary_label": f"CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 109 = 0 THEN '?' ELSE {LABEL_B} END ELSE '' END",
    "secondary_ai_assistance": "CASE WHEN doc_id % 2 = 0 THEN CASE WHEN doc_id % 22 = 0 THEN 'explanation' ELSE 'none' END ELSE '' END",
    "adjudication_ai_assistance": f"CASE WHEN ({APART} OR doc_id % 37 = 0) AND doc_id % 9 <> 0 THEN 'label_suggestion' WHEN doc_id % 113 = 0 THEN 'all' ELSE '' END",
    "review_decision": f"CASE WHEN {APART} AND doc_id % 16 = 0 THEN CASE WHEN doc_id % 7 = 1 THEN 'skip' WHEN doc_id % 3 = 0 THEN 'modify' ELSE 'approve' END WHEN doc_id % 37 = 0 AND NOT {APART} THEN CASE WHEN doc_id % 4 = 1 THEN 'approve' ELSE 'modify' END ELSE '' END",
    "reviewer": f"CASE WHEN {APART} AND doc_id % 16 = 0 THEN CASE WHEN doc_id % 10 = 4 THEN '' ELSE concat('a', (doc_id + 3) % 7) END WHEN doc_id % 37 = 0 OR doc_id % 127 = 0 THEN concat('a', doc_id % 5) ELSE '' END",
    "reviewed_at": f"CASE WHEN {APART} AND doc_id % 16 = 0 THEN CASE WHEN doc_id % 9 = 2 THEN '2026-01-02T03:04:05' WHEN doc_id % 9 = 4 THEN '2026-01-02T24:00:00Z' WHEN doc_id % 9 = 6 THEN '2026-01-02T03:60Z' ELSE '2026-01-02T03:04:05+08:00' END WHEN doc_id % 37 = 0 THEN CASE WHEN doc_id % 6 = 1 THEN 'today' ELSE '2026-01-02T03:04Z' END ELSE '' END",
    "review_note": f"CASE WHEN ({APART} AND doc_id % 16 = 0) OR doc_id % 37 = 0 THEN CASE WHEN doc_id % 12 = 4 THEN '' ELSE 'seen' END ELSE '' END",
    "benchmark_version": "CASE WHEN doc_id % 131 = 0 THEN 'v0' ELSE 'v1' END",
}
#: Which documents have a secondary annotator, and which a proposal.
HAS_SECOND, HAS_PROPOSAL = "doc_id % 2 = 0", f"({APART} AND doc_id % 56 <> 0) OR doc_id % 149 = 0"
ANNOTATORS = {f"a{i}": f"Name {i}" for i in range(6)}
PROTOCOL = contracts.Protocol(ANNOTATORS, "v1")


def rows(spark: SparkSession, sf_dir: str, columns: Columns, where: str = "true") -> DataFrame:
    return table(spark, sf_dir, "documents").where(where).selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])


def cte(name: str, columns: Columns, where: str = "true") -> str:
    return f"{name} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM documents WHERE {where})"


def listed(rules: list[tuple[str, str]], key: str, source: str) -> str:
    """SQL for the rules that each row breaks."""
    cases = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in rules)
    return f"SELECT rule, key, '' AS detail FROM (SELECT {key} AS key, unnest([{cases}]) AS rule FROM {source}) WHERE rule IS NOT NULL"


def changed(rule: str, pairs: list[tuple[str, str, str]], key: str, source: str) -> str:
    cases = ", ".join(f"CASE WHEN coalesce({a}, '') <> coalesce({b}, '') THEN '{name}' END" for name, a, b in pairs)
    return f"SELECT '{rule}' AS rule, key, detail FROM (SELECT {key} AS key, unnest([{cases}]) AS detail FROM {source}) WHERE detail IS NOT NULL"


def many(rule: str, source: str, by: str, bad: str = "count(*) > 1") -> str:
    return f"SELECT '{rule}' AS rule, concat_ws('|', {by}) AS key, CAST(count(*) AS VARCHAR) AS detail FROM {source} GROUP BY {by} HAVING {bad}"


def size(rule: str, source: str, due: int) -> str:
    return f"SELECT '{rule}' AS rule, '' AS key, CAST(n AS VARCHAR) AS detail FROM (SELECT count(*) AS n FROM {source}) WHERE n <> {due}"


@query(
    f"""WITH {cte("pool", FAULTY_POOL)} {size("pool_size", "pool", 60)}
UNION ALL {listed([("pair_blank", "trim(pair_id) = ''"), ("pool_version", "pool_version <> 'v1'")], "pair_id", "pool")}
UNION ALL {many("pair_twice", "(SELECT * FROM pool WHERE trim(pair_id) <> '')", "pair_id")}
UNION ALL SELECT 'query_count', '', CAST(n AS VARCHAR) FROM (SELECT count(DISTINCT research_query_id) AS n FROM pool) WHERE n <> 3
UNION ALL {many("query_size", "pool", "research_query_id", "count(*) <> 20")}
UNION ALL {many("work_twice", "pool", "research_query_id, openalex_id")}"""
)
def pool_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.pool_violations(rows(spark, sf_dir, FAULTY_POOL), PROTOCOL)


ASSIGNED_SQL = f"""{cte("pool", POOL)}, {cte("first_a", PRIMARY)}, {cte("second_a", SECONDARY, HAS_SECOND)}, a AS (SELECT * FROM first_a UNION ALL SELECT * FROM second_a),
p AS (SELECT pool.pair_id AS p, any_value(research_query_id) AS rq, count(a.pair_id) AS n, count(*) FILTER (assignment_role = 'primary') AS n1, count(*) FILTER (assignment_role = 'secondary') AS n2,
  min(annotator_slug) FILTER (assignment_role = 'primary') AS s1, min(annotator_slug) FILTER (assignment_role = 'secondary') AS s2 FROM pool LEFT JOIN a USING (pair_id) GROUP BY pool.pair_id),
due AS (SELECT unnest([{", ".join(f"'{s}'" for s in ANNOTATORS)}]) AS slug), sec AS (SELECT a.annotator_slug, pool.research_query_id AS rq FROM a JOIN pool USING (pair_id) WHERE assignment_role = 'secondary'),
mates AS (SELECT pair_id, min(annotator_slug) AS x, max(annotator_slug) AS y FROM a GROUP BY pair_id HAVING count(*) = 2)"""


@query(
    f"""WITH {ASSIGNED_SQL} {size("assignment_size", "a", 90)}
UNION ALL {many("annotator_twice", "a", "pair_id, annotator_slug")}
UNION ALL SELECT 'pair_unknown', pair_id, CAST(count(*) AS VARCHAR) FROM a WHERE pair_id NOT IN (SELECT pair_id FROM pool) GROUP BY pair_id
UNION ALL {listed([("annotator_unknown", "annotator_slug NOT IN (SELECT slug FROM due)"), ("role", "assignment_role NOT IN ('primary', 'secondary')"), ("annotator_name", "annotator_slug IN (SELECT slug FROM due) AND annotator_name <> replace(annotator_slug, 'a', 'Name ')")], "pair_id", "a")}
UNION ALL {listed([("one_primary", "n1 <> 1"), ("two_annotators_most", "n2 > 1 OR n > 2"), ("same_annotator", "s1 = s2")], "p", "p")}
UNION ALL SELECT 'annotator_load', slug, CAST(count(annotator_slug) AS VARCHAR) FROM due LEFT JOIN a ON slug = annotator_slug GROUP BY slug HAVING count(annotator_slug) <> 15
UNION ALL SELECT 'secondaries_of_query', q, CAST(count(rq) AS VARCHAR) FROM (SELECT DISTINCT research_query_id AS q FROM pool) LEFT JOIN sec ON q = rq GROUP BY q HAVING count(rq) <> 10
UNION ALL SELECT 'secondaries_uneven', concat(q, '|', slug), CAST(count(rq) AS VARCHAR) FROM (SELECT DISTINCT research_query_id AS q FROM pool) CROSS JOIN due LEFT JOIN sec ON q = rq AND slug = annotator_slug GROUP BY q, slug HAVING count(rq) NOT IN (1, 2)
UNION ALL SELECT 'partners', concat(u.slug, '|', v.slug), CAST(count(pair_id) AS VARCHAR) FROM due u JOIN due v ON u.slug < v.slug LEFT JOIN mates ON x = u.slug AND y = v.slug GROUP BY u.slug, v.slug HAVING count(pair_id) NOT BETWEEN 1 AND 3"""
)
def assignment_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = rows(spark, sf_dir, PRIMARY).unionByName(rows(spark, sf_dir, SECONDARY, HAS_SECOND))
    return contracts.assignment_violations(both, rows(spark, sf_dir, POOL), PROTOCOL)


CHECKED = "list_filter(list_transform(string_split(source_checked, ';'), lambda v: trim(v)), lambda v: v <> '')"
URLS = "list_filter(list_transform(string_split(evidence_url, ';'), lambda v: trim(v)), lambda v: v <> '')"
SOURCE_LIST = "['title_abstract', 'openalex', 'ads_scix', 'arxiv', 'publisher', 'doi_page', 'pdf_fulltext']"
ANNOTATION_RULES = [
    ("label", "trim(label) NOT IN ('2', '1', '0', '?')"),
    ("confidence", "confidence NOT IN ('high', 'medium', 'low')"),
    ("evidence_level", "evidence_level NOT IN ('A', 'B', 'C')"),
    ("reason_blank", "trim(reason) = ''"),
    ("ai_assistance", "ai_assistance NOT IN ('none', 'translation', 'explanation', 'label_suggestion')"),
    ("source_blank", f"len({CHECKED}) = 0"),
    ("source_value", f"NOT list_has_all({SOURCE_LIST}, {CHECKED})"),
    ("source_twice", f"len({CHECKED}) <> len(list_distinct({CHECKED}))"),
    ("landing_url", "landing_page_url <> '' AND NOT regexp_matches(landing_page_url, '^https?://[^/?#]')"),
    ("evidence_url", f"len(list_filter({URLS}, lambda u: NOT regexp_matches(u, '^https?://[^/?#]'))) > 0"),
    ("abstract_evidence_only", f"evidence_level = 'A' AND list_distinct({CHECKED}) <> ['title_abstract']"),
    ("external_source_needed", f"evidence_level IN ('B', 'C') AND NOT list_has_any({CHECKED}, {SOURCE_LIST}[2:])"),
    ("url_needed", f"evidence_level IN ('B', 'C') AND len({URLS}) = 0"),
    ("fulltext_needed", f"evidence_level = 'C' AND NOT list_contains({CHECKED}, 'pdf_fulltext')"),
]


@query(
    f"""WITH {cte("pool", POOL)}, {cte("t", TASK)}, {cte("due", {"s": "concat('a', doc_id % 6)", "p": "concat('P', doc_id)"})}
{listed(ANNOTATION_RULES, "concat(annotator, '|', pair_id)", "t")}
UNION ALL {changed("read_only_changed", [(c, f"t.{c}", f"pool.{c}") for c in ("research_query_id", "openalex_id", "title", "landing_page_url")], "concat(annotator, '|', t.pair_id)", "t JOIN pool USING (pair_id)")}
UNION ALL {many("pair_twice", "t", "annotator, pair_id")}
UNION ALL SELECT 'pair_missing', concat(s, '|', p), '' FROM due WHERE concat(s, '|', p) NOT IN (SELECT concat(annotator, '|', pair_id) FROM t)
UNION ALL SELECT DISTINCT 'pair_extra', concat(annotator, '|', pair_id), '' FROM t WHERE concat(annotator, '|', pair_id) NOT IN (SELECT concat(s, '|', p) FROM due)
UNION ALL SELECT 'row_count', coalesce(s, w), CAST(coalesce(n, 0) AS VARCHAR) FROM (SELECT annotator AS w, count(*) AS n FROM t GROUP BY 1) FULL JOIN (SELECT s, count(*) AS m FROM due GROUP BY 1) ON w = s WHERE n IS DISTINCT FROM m"""
)
def annotation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of all annotators at once."""
    due = rows(spark, sf_dir, {"annotator_slug": "concat('a', doc_id % 6)", "pair_id": "concat('P', doc_id)"})
    return contracts.annotation_violations(rows(spark, sf_dir, TASK), rows(spark, sf_dir, POOL), due)


def instant(c: str) -> str:
    """SQL: a day that there is, a time of that day and an offset below a day."""
    return f"(regexp_matches({c}, '^\\d{{4}}-\\d\\d-\\d\\d[T ]\\d\\d:\\d\\d(:\\d\\d([.,]\\d+)?)?(Z|[+-]\\d\\d:?\\d\\d)$') AND TRY_CAST(left({c}, 10) AS DATE) IS NOT NULL AND coalesce(TRY_CAST(regexp_extract({c}, '^.{{11}}(\\d\\d)', 1) AS INT), 0) < 24 AND NOT regexp_matches({c}, ':[6-9]\\d|[+-](2[4-9]|[3-9]\\d):?\\d\\d$|[+-]\\d\\d[6-9]\\d$'))"


PROPOSAL_RULES = [
    ("pair_blank", "x.pair_id = ''"),
    ("pair_unknown", "pool.pair_id IS NULL"),
    ("research_query_id", "pool.pair_id IS NOT NULL AND x.research_query_id IS DISTINCT FROM pool.research_query_id"),
    ("openalex_id", "pool.pair_id IS NOT NULL AND x.openalex_id IS DISTINCT FROM pool.openalex_id"),
    ("title", "x.title <> pool.title"),
    ("proposed_label", "proposed_final_label NOT IN ('0', '1', '2')"),
    ("status", "proposal_status NOT IN ('pending_human_review', 'reviewed')"),
    ("reason_or_sources_blank", "trim(proposal_reason) = '' OR evidence_sources = ''"),
    ("review_invented", "proposal_status = 'pending_human_review' AND concat(review_decision, reviewed_label, reviewer, reviewed_at, review_note) <> ''"),
    ("decision", "proposal_status = 'reviewed' AND review_decision NOT IN ('approve', 'modify')"),
    ("reviewed_label", "proposal_status = 'reviewed' AND reviewed_label NOT IN ('0', '1', '2')"),
    ("review_incomplete", "proposal_status = 'reviewed' AND (reviewer = '' OR reviewed_at = '' OR review_note = '')"),
    ("reviewed_at", f"proposal_status = 'reviewed' AND reviewed_at <> '' AND NOT {instant("reviewed_at")}"),
    ("approve_changes_label", "proposal_status = 'reviewed' AND review_decision = 'approve' AND reviewed_label <> proposed_final_label"),
    ("modify_keeps_label", "proposal_status = 'reviewed' AND review_decision = 'modify' AND reviewed_label = proposed_final_label"),
]


@query(f"""WITH {cte("pool", POOL)}, {cte("x", PROPOSAL, HAS_PROPOSAL)} {listed(PROPOSAL_RULES, "x.pair_id", "x LEFT JOIN pool USING (pair_id)")} UNION ALL {many("pair_twice", "x", "pair_id")}""")
def proposal_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.proposal_violations(rows(spark, sf_dir, PROPOSAL, HAS_PROPOSAL), rows(spark, sf_dir, POOL))


GRADE = "('0', '1', '2')"
NO_REVIEW = "concat(j.review_decision, j.reviewer, j.reviewed_at, j.review_note) = ''"
JUDGEMENT_RULES = [
    ("pair_blank", "j.pair_id = ''"),
    ("pair_unknown", "pool.pair_id IS NULL"),
    ("research_query_id", "pool.pair_id IS NOT NULL AND j.research_query_id IS DISTINCT FROM pool.research_query_id"),
    ("openalex_id", "pool.pair_id IS NOT NULL AND j.openalex_id IS DISTINCT FROM pool.openalex_id"),
    ("benchmark_version", "benchmark_version <> 'v1'"),
    ("judgement_status", "state NOT IN ('ready', 'adjudicated', 'pending_human_review')"),
    ("final_label", f"final_label <> '' AND final_label NOT IN {GRADE}"),
    ("proposed_label", f"proposed_label <> '' AND proposed_label NOT IN {GRADE}"),
    *[(c, f"{c} NOT IN ('', 'none', 'translation', 'explanation', 'label_suggestion')") for c in ("primary_ai_assistance", "secondary_ai_assistance", "adjudication_ai_assistance")],
    ("secondary_invented", "kind = 1 AND concat(secondary_annotator, secondary_label, secondary_ai_assistance) <> ''"),
    ("agreement_status", "agreement_status IS DISTINCT FROM ['single_annotation', 'agreement', 'disagreement'][kind]"),
    ("judgement_basis", "(kind < 3 AND state = 'ready' AND judgement_basis IS DISTINCT FROM ['primary_annotation', 'double_annotation_agreement'][kind]) OR (kind = 3 AND judgement_basis IS DISTINCT FROM 'ai_adjudication_proposal')"),
    ("final_not_annotated", "kind < 3 AND state = 'ready' AND final_label <> coalesce(primary_label, '')"),
    ("review_of_ready", f"kind < 3 AND state = 'ready' AND NOT ({NO_REVIEW} AND proposed_label = '' AND adjudication_ai_assistance = '')"),
    ("state", "(kind < 3 AND state = 'pending_human_review') OR (kind = 3 AND state = 'ready')"),
    ("override_basis", "kind < 3 AND state = 'adjudicated' AND judgement_basis IS DISTINCT FROM 'blind_ai_audit_human_review'"),
    ("override_label", f"kind < 3 AND state = 'adjudicated' AND (final_label NOT IN {GRADE} OR final_label = primary_label)"),
    ("override_with_proposal", "kind < 3 AND state = 'adjudicated' AND proposed_label <> ''"),
    ("override_decision", "kind < 3 AND state = 'adjudicated' AND j.review_decision <> 'modify'"),
    ("ai_suggestion_needed", "(kind = 3 OR state = 'adjudicated') AND adjudication_ai_assistance <> 'label_suggestion'"),
    ("proposal_missing", "kind = 3 AND x.pair_id IS NULL"),
    ("proposal_label", "kind = 3 AND proposed_label <> proposed_final_label"),
    ("review_of_pending", f"kind = 3 AND state = 'pending_human_review' AND (final_label <> '' OR NOT {NO_REVIEW})"),
    ("proposal_not_pending", "kind = 3 AND state = 'pending_human_review' AND proposal_status <> 'pending_human_review'"),
    ("review_incomplete", f"state = 'adjudicated' AND (final_label NOT IN {GRADE} OR j.reviewer = '' OR j.reviewed_at = '' OR j.review_note = '')"),
    ("reviewer_not_independent", "state = 'adjudicated' AND j.reviewer <> '' AND (j.reviewer = primary_annotator OR j.reviewer = secondary_annotator)"),
    ("reviewed_at", f"state = 'adjudicated' AND j.reviewed_at <> '' AND NOT {instant("j.reviewed_at")}"),
    ("proposal_not_reviewed", "kind = 3 AND state = 'adjudicated' AND proposal_status <> 'reviewed'"),
    ("decision", "kind = 3 AND state = 'adjudicated' AND j.review_decision NOT IN ('approve', 'modify')"),
    ("reviewed_label", "kind = 3 AND state = 'adjudicated' AND reviewed_label <> final_label"),
    ("approve_changes_label", "kind = 3 AND state = 'adjudicated' AND j.review_decision = 'approve' AND final_label <> proposed_label"),
    ("modify_keeps_label", "kind = 3 AND state = 'adjudicated' AND j.review_decision = 'modify' AND final_label = proposed_label"),
    ("primary_annotator", "primary_annotator IS DISTINCT FROM na.annotator"),
    ("primary_annotation_missing", "na.annotator IS NULL"),
    ("primary_label", "na.annotator IS NOT NULL AND primary_label IS DISTINCT FROM na.label"),
    ("primary_ai", "primary_ai_assistance <> na.ai_assistance"),
    ("secondary_annotator", "kind > 1 AND secondary_annotator <> nb.annotator"),
    ("secondary_label", "kind > 1 AND secondary_label <> nb.label"),
    ("secondary_ai", "kind > 1 AND secondary_ai_assistance <> nb.ai_assistance"),
    ("final_needed", f"final_label NOT IN {GRADE}"),
    ("still_pending", "state = 'pending_human_review'"),
    ("not_adjudicated", "agreement_status = 'disagreement' AND state <> 'adjudicated'"),
]
REPEATED = [(c, f"x.{c}", f"pool.{c}") for c in ("research_query_id", "openalex_id", "title")] + [(f"{w}_{s}", f"x.{w}_{s}", f"n{s}.{w}") for s in "ab" for w in ("annotator", "label", "reason")]


@query(
    f"""WITH {cte("pool", POOL)}, {cte("na", NOTE_A)}, {cte("nb", NOTE_B, HAS_SECOND)}, {cte("x", PROPOSAL, HAS_PROPOSAL)}, {cte("j0", JUDGEMENT)},
j AS (SELECT j0.*, judgement_status AS state, CASE WHEN nb.pair_id IS NULL THEN 1 WHEN primary_label IS NOT DISTINCT FROM secondary_label THEN 2 ELSE 3 END AS kind FROM j0 LEFT JOIN nb USING (pair_id)),
w AS (SELECT * FROM j WHERE kind = 3)
{listed(JUDGEMENT_RULES, "j.pair_id", "j LEFT JOIN pool USING (pair_id) LEFT JOIN na USING (pair_id) LEFT JOIN nb USING (pair_id) LEFT JOIN x USING (pair_id)")}
UNION ALL {changed("proposal_provenance", REPEATED, "w.pair_id", "w JOIN x USING (pair_id) LEFT JOIN pool USING (pair_id) LEFT JOIN na USING (pair_id) LEFT JOIN nb USING (pair_id)")}
UNION ALL {changed("review_provenance", [(c, f"w.{c}", f"x.{c}") for c in contracts.REVIEW], "w.pair_id", "(SELECT * FROM w WHERE state = 'adjudicated') w JOIN x USING (pair_id)")}
UNION ALL {many("pair_twice", "j", "pair_id")}
UNION ALL SELECT 'pair_missing', pair_id, '' FROM pool WHERE pair_id NOT IN (SELECT pair_id FROM j)
UNION ALL SELECT 'proposal_without_disagreement', pair_id, '' FROM x WHERE pair_id NOT IN (SELECT pair_id FROM w)
UNION ALL {size("judgement_size", "j", 60)}"""
)
def judgement_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements, assignments, annotations and proposals of a package that is meant to be approved."""
    notes = rows(spark, sf_dir, NOTE_A).unionByName(rows(spark, sf_dir, NOTE_B, HAS_SECOND))
    roles = rows(spark, sf_dir, {"pair_id": NOTE_A["pair_id"], "annotator_slug": NOTE_A["annotator"], "assignment_role": "'primary'"})
    roles = roles.unionByName(rows(spark, sf_dir, {"pair_id": NOTE_B["pair_id"], "annotator_slug": NOTE_B["annotator"], "assignment_role": "'secondary'"}, HAS_SECOND))
    return contracts.judgement_violations(rows(spark, sf_dir, JUDGEMENT), rows(spark, sf_dir, POOL), roles, notes, rows(spark, sf_dir, PROPOSAL, HAS_PROPOSAL), "v1", pairs=60)


@query(
    f"""WITH {cte("pool", POOL)}, {cte("na", NOTE_A)}, {cte("nb", NOTE_B, HAS_SECOND)},
d AS (SELECT pool.*, na.annotator AS a, na.label AS la, nb.annotator AS b, nb.label AS lb, CASE WHEN nb.label IS NULL THEN 1 WHEN na.label = nb.label THEN 2 ELSE 3 END AS kind FROM pool JOIN na USING (pair_id) LEFT JOIN nb USING (pair_id))
SELECT pair_id, CASE kind WHEN 3 THEN '' ELSE la END AS final_label, CASE kind WHEN 3 THEN 'pending_human_review' ELSE 'ready' END AS judgement_status, ['single_annotation', 'agreement', 'disagreement'][kind] AS agreement_status,
  ['primary_annotation', 'double_annotation_agreement', 'ai_adjudication_proposal'][kind] AS judgement_basis, a AS primary_annotator, coalesce(b, '') AS secondary_annotator, coalesce(lb, '') AS secondary_label FROM d"""
)
def judgement_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgements before any review."""
    notes = rows(spark, sf_dir, NOTE_A).unionByName(rows(spark, sf_dir, NOTE_B, HAS_SECOND))
    assigned = rows(spark, sf_dir, {"pair_id": NOTE_A["pair_id"], "annotator_slug": NOTE_A["annotator"], "assignment_role": "'primary'"})
    assigned = assigned.unionByName(rows(spark, sf_dir, {"pair_id": NOTE_B["pair_id"], "annotator_slug": NOTE_B["annotator"], "assignment_role": "'secondary'"}, HAS_SECOND))
    made, _ = benchmark.draft(rows(spark, sf_dir, POOL), assigned, notes, None, "v1-draft")
    return made.select("pair_id", "final_label", "judgement_status", "agreement_status", "judgement_basis", "primary_annotator", "secondary_annotator", "secondary_label")


METHOD: Columns = {
    "pair_id": "CASE WHEN doc_id % 83 = 0 THEN concat('X', doc_id) WHEN doc_id % 79 = 2 THEN concat('P', doc_id - 1) ELSE concat('P', doc_id) END",
    "research_query_id": "CASE WHEN doc_id % 73 = 1 THEN 'RQ-xx' ELSE concat('RQ-', lang) END",
    "method_id": "CASE WHEN doc_id % 71 = 0 THEN 'other' ELSE 'm' END",
    "score": "CASE WHEN doc_id % 67 = 0 THEN 'high' ELSE CAST(n_chars % 100 AS STRING) END",
    "rank": "CASE WHEN doc_id % 61 = 0 THEN '1.0' ELSE CAST(doc_id % 7 + 1 AS STRING) END",
}


@query(
    f"""WITH {cte("r", METHOD)}, {cte("p", {"pair_id": POOL["pair_id"], "q": POOL["research_query_id"]})},
o AS (SELECT *, row_number() OVER (PARTITION BY research_query_id ORDER BY TRY_CAST(score AS DOUBLE) DESC NULLS LAST, pair_id) AS due FROM r)
{listed([("method", "method_id <> 'm'"), ("score_not_finite", "TRY_CAST(score AS DOUBLE) IS NULL"), ("rank_not_canonical", "rank LIKE '%.%'")], "pair_id", "r")}
UNION ALL SELECT 'rank_not_by_score', pair_id, '' FROM o WHERE rank NOT LIKE '%.%' AND CAST(rank AS INT) <> due AND pair_id NOT IN (SELECT pair_id FROM r GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'query_size', research_query_id, '' FROM r GROUP BY research_query_id HAVING count(*) <> 20
UNION ALL SELECT 'pair_missing', pair_id, '' FROM p WHERE pair_id NOT IN (SELECT pair_id FROM r) UNION ALL SELECT 'pair_unknown', pair_id, '' FROM r WHERE pair_id NOT IN (SELECT pair_id FROM p)
UNION ALL SELECT 'pair_of_other_query', pair_id, '' FROM r JOIN p USING (pair_id) WHERE research_query_id <> q UNION ALL SELECT 'pair_twice', pair_id, '' FROM r GROUP BY pair_id HAVING count(*) > 1"""
)
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A method's ranking against its pool; where a pair occurs twice, its ranks are left out, as their order is open."""
    given = rows(spark, sf_dir, METHOD)
    found = package.ranking_violations(given, rows(spark, sf_dir, {"pair_id": POOL["pair_id"], "research_query_id": POOL["research_query_id"]}), "m", 20)
    again = given.groupBy("pair_id").agg(F.count("*").alias("n")).where("n > 1")
    found = found.join(again, (F.col("rule") == "rank_not_by_score") & (F.col("key") == F.col("pair_id")), "left_anti")
    return found.select("rule", "key", F.lit("").alias("detail"))


LATER = JUDGEMENT | {"primary_label": "CASE WHEN doc_id % 29 = 0 THEN '2' ELSE CAST(doc_id % 3 AS STRING) END", "agreement_status": f"CASE WHEN {APART} THEN 'disagreement' ELSE 'agreement' END"}


@query(
    f"""WITH {cte("a", LATER, "doc_id % 139 <> 0 AND doc_id % 31 <> 0")}, {cte("b", JUDGEMENT, "doc_id % 139 <> 0 AND doc_id % 37 <> 0")}
SELECT 'pair_added' AS rule, pair_id AS key, '' AS detail FROM a WHERE pair_id NOT IN (SELECT pair_id FROM b)
UNION ALL SELECT 'pair_removed', pair_id, '' FROM b WHERE pair_id NOT IN (SELECT pair_id FROM a)
UNION ALL {changed("frozen_changed", [(c, f"a.{c}", f"b.{c}") for c in contracts.JUDGEMENT_FROZEN], "a.pair_id", "a JOIN b USING (pair_id)")}"""
)
def parent_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an approved package changed of the draft that was reviewed."""
    now, then = rows(spark, sf_dir, LATER, "doc_id % 139 <> 0 AND doc_id % 31 <> 0"), rows(spark, sf_dir, JUDGEMENT, "doc_id % 139 <> 0 AND doc_id % 37 <> 0")
    return contracts.parent_violations(now, then, contracts.JUDGEMENT_FROZEN)


@query(
    f"""WITH {cte("t", TASK)}, {cte("a", PRIMARY)}, done AS (SELECT DISTINCT annotator AS s, pair_id AS p FROM t WHERE trim(label) <> '')
SELECT annotator_slug, count(*) AS due, count(p) AS done, CASE WHEN count(p) = count(*) THEN 'complete' WHEN count(p) > 0 THEN 'partial' ELSE 'missing' END AS status
FROM (SELECT DISTINCT annotator_slug, pair_id FROM a) LEFT JOIN done ON s = annotator_slug AND p = pair_id GROUP BY annotator_slug"""
)
def annotator_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.coverage(rows(spark, sf_dir, PRIMARY), rows(spark, sf_dir, TASK))


TERMS: Columns = {
    "term_id": "CASE WHEN doc_id % 83 = 0 THEN '' WHEN doc_id % 61 = 1 THEN concat('T', doc_id - 1) ELSE concat('T', doc_id) END",
    "term": "CASE WHEN doc_id % 71 = 0 THEN ' ' ELSE concat('term ', doc_id) END",
    "normalized_term": "CASE WHEN doc_id % 47 = 0 THEN concat('TERM ', doc_id + 1) ELSE concat('term ', doc_id) END",
    "category": "CASE doc_id % 5 WHEN 0 THEN 'object_term' WHEN 1 THEN 'weak_term' WHEN 2 THEN 'synonym' WHEN 3 THEN 'abbreviation' ELSE CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'task_term' END END",
    "strength": "CASE WHEN doc_id % 43 = 0 THEN '3.5' WHEN doc_id % 41 = 0 THEN '' ELSE CAST(doc_id % 12 AS STRING) END",
    "include_in_query": "CASE doc_id % 9 WHEN 0 THEN 'yes' WHEN 1 THEN 'True' ELSE 'false' END",
}


@query(
    f"""WITH {cte("t", TERMS)} {listed([("term_id_blank", "term_id = ''"), ("term_blank", "trim(term) = ''"), ("strength", "TRY_CAST(strength AS INT) IS NULL OR strength LIKE '%.%' OR TRY_CAST(strength AS INT) NOT BETWEEN 1 AND 10"), ("include_in_query", "lower(include_in_query) NOT IN ('true', 'false')"), ("category", "category = 'other'")], "term_id", "t")}
UNION ALL {many("term_id_twice", "(SELECT * FROM t WHERE term_id <> '')", "term_id")} UNION ALL {many("normalized_term_twice", "(SELECT lower(normalized_term) AS lowered FROM t)", "lowered")}"""
)
def term_dictionary_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.term_violations(rows(spark, sf_dir, TERMS))


#: Files of a repository: names that may hold keys, texts, and tests whose values may be placeholders.
FILE = "CASE WHEN doc_id % 61 = 0 THEN '.env' WHEN doc_id % 59 = 0 THEN '.env.example' WHEN doc_id % 53 = 0 THEN 'keys/id_rsa.pub' WHEN doc_id % 47 = 0 THEN 'a.PEM' WHEN doc_id % 3 = 0 THEN concat('tests/', doc_id, '.md') WHEN doc_id % 43 = 0 THEN concat('data/', doc_id, '.bin') ELSE concat('docs/', doc_id, '.md') END"
CONTENT = "concat(text, CASE doc_id % 5 WHEN 0 THEN concat(' /home/', lang, '/x') WHEN 1 THEN concat(' api_key = \"fake-', 'value-0123456789', '\"') WHEN 2 THEN concat(' token: \"abcdefghijklmnop', doc_id, '\"') ELSE '' END)"
MARK = "(^|[^a-z0-9])(test|dummy|fake|placeholder|example|not-real|must-never-appear)([^a-z0-9]|$)"
VALUES = [f"regexp_extract_all(content, '{p}', 1)" for p in ("(sk-[A-Za-z0-9_-]{20,})", "(gh[pousr]_[A-Za-z0-9]{20,})", "(AKIA[0-9A-Z]{16})", r"(?i)(?:api[_-]?key|token|password)\s*[:=]\s*[''\x22]([A-Za-z0-9_./+-]{16,})[''\x22]")]


@query(
    f"""WITH f AS (SELECT {FILE} AS path, {CONTENT} AS content FROM documents), s AS (SELECT *, regexp_matches(path, '(?i)(^|/)(\\.env(\\..+)?|id_(rsa|dsa|ecdsa|ed25519)(\\.pub)?|[^/]*\\.(pem|key|p12|pfx))$') AS sensitive, regexp_matches(lower(path), '\\.(py|md|json|csv|txt|yml|yaml|toml)$') AS texty FROM f)
{listed([("sensitive_name", "sensitive AND path <> '.env.example'"), ("secret", f"NOT sensitive AND texty AND len(list_filter(list_concat({VALUES[0]}, {VALUES[1]}, {VALUES[2]}, {VALUES[3]}), lambda v: NOT (path LIKE 'tests/%' AND regexp_matches(lower(v), '{MARK}')))) > 0"), ("personal_path", "NOT sensitive AND texty AND regexp_matches(content, '[A-Za-z]:\\\\Users\\\\[^\\\\\\s]+|/home/[^/\\s]+|/Users/[^/\\s]+')")], "path", "s")}"""
)
def sensitive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and contents of files that should not be handed on; what was found is not shown."""
    return checks.sensitive_files(rows(spark, sf_dir, {"path": FILE, "content": CONTENT}))
