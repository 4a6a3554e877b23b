"""The quality gate of a project: rules over a table of its files (path, content), each with a purpose, a severity and a level.

Rules on single files are one pass over the table: a rule names the paths that it is for, the condition, and whether it breaks the
gate or only warns. CSV files become a table of cells, on which ids, labels, scores and references are checked by joins and counts.
Contents never show in what is found.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.norm import clean_text
from paperloom.store import cut

from . import checks

ERROR, WARNING = "error", "warning"
BASIC, FULL = "basic", "full"
#: The folders that a project has, and what tells files that tests use to see a failure.
FOLDERS = ("app", "src", "tests", "docs", "data")
FAILING_FOLDERS = ("invalid", "negative", "expected_fail", "expected-fail")
FAILING_NAME = r"invalid|deliberate|negative|expected_fail|expected-fail"
#: Columns of CSV files that hold ids, labels, and scores from 0 to 1.
ID_COLUMNS = ("annotation_id", "case_id", "term_id")
LABEL_COLUMNS = ("label", "relevance_label")
SCORE_COLUMNS = ("similarity", "similarity_score", "precision", "recall", "ndcg", "metric_value")
#: The labels of files, of those in a folder of annotation tasks, and that folder.
LABELS, GRADES, GRADED_FOLDER = ("高度相关", "部分相关", "不相关", "待讨论"), ("2", "1", "0", "?"), "data/annotation_tasks/w4/"
#: An old file whose structure only warns, and where works must be unique, are samples, or refer to samples.
OLD_LABELS = "data/manual/relevance_labels_w1.csv"
UNIQUE_WORKS, REPEATED_WORKS = r"^(data/(samples|manual)/|data/analysis/w2_dedup/(.*/)?deduplicated[^/]*$)", r"^data/samples/w2/dedup/"
SAMPLES, REFERRING = r"data/samples/|(^|/)papers_ranked\.csv$", r"data/manual/"
#: Fields of a run's configuration with their type and rule.
RUN_CONFIG = (
    *[(name, "any", "present") for name in ("run_id", "created_at", "mode", "keyword", "max_results", "status")],
    ("status", "string", ("running", "completed", "failed")),
    ("success", "boolean", "if present"),
)
#: Fixed value: links and pictures of Markdown.
MARKDOWN_LINK = r"!?\[[^\]]*\]\(([^)]+)\)"
EXTERNAL = r"(?i)^(https?://|mailto:|ftp://|#)"


@dataclass(frozen=True)
class Rule:
    name: str
    #: Paths that it is for.
    purpose: Column
    broken: Column
    severity: str = ERROR
    level: str = BASIC


def fails_on_purpose(path: Column) -> Column:
    """Whether a file is there so that a test sees it fail."""
    parts = F.split(F.lower(path), "/")
    folders = F.slice(parts, 3, F.greatest(F.size(parts) - 3, F.lit(0)))
    named = F.arrays_overlap(folders, F.array(*[F.lit(f) for f in FAILING_FOLDERS])) | F.element_at(parts, -1).rlike(FAILING_NAME)
    return F.lower(path).startswith("tests/fixtures/") & named


def normal_path(path: Column) -> Column:
    """path without empty and ``.`` segments, ``..`` taken back; what leads out of the root keeps its ``..``."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    step = lambda acc, s: (
        F.when(s.isin("", "."), acc).when((s == "..") & (F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def link_target(raw: Column) -> Column:
    """A Markdown link's target without title, angle brackets, anchor and escapes; empty for one outside the project or on the page."""
    trimmed = F.trim(raw)
    bracketed = F.trim(F.substring_index(F.substr(trimmed, F.lit(2)), ">", 1))
    plain = F.substring_index(F.substring_index(trimmed, ' "', 1), " '", 1)
    target = F.when(trimmed.startswith("<") & F.contains(trimmed, F.lit(">")), bracketed).otherwise(plain)
    path = F.substring_index(target, "#", 1)
    return F.when(target.rlike(EXTERNAL), "").otherwise(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))


def broken_links(files: DataFrame) -> DataFrame:
    """(rule, key, detail): local links of Markdown files that no file or folder of the table answers, one row for each occurrence."""
    pages = files.where(F.col("path").rlike(r"(?i)\.md$") & ~fails_on_purpose(F.col("path")))
    links = pages.select("path", F.explode(F.regexp_extract_all("content", F.lit(MARKDOWN_LINK), 1)).alias("raw")).select("path", link_target(F.col("raw")).alias("target")).where("target <> ''")
    parent = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    found = links.withColumn("at", normal_path(F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(parent, F.col("target")))))
    parts = F.split("path", "/")
    known = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("known")).distinct()
    lost = found.where("at <> ''").join(known, F.col("at") == F.col("known"), "left_anti")
    return lost.select(F.lit("broken_link").alias("rule"), F.col("path").alias("key"), F.col("target").alias("detail"))


def contract_rules(value: Column, contract: Sequence[tuple[str, str, object]]) -> list[tuple[str, Column]]:
    """(rule, condition) for each row (field, type, rule) of a contract over a VARIANT.

    Rules: ``present`` (there, and neither null nor the empty text), a tuple of allowed texts, and ``if present`` (of that type).
    """
    out = []
    for name, kind, rule in contract:
        text = F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit(""))
        if rule == "present":
            out.append((f"{name}_missing", text == ""))
        elif rule == "if present":
            there = F.try_variant_get(value, f"$.{name}", "variant")
            out.append((f"{name}_type", F.coalesce(F.schema_of_variant(there) != kind.upper(), F.lit(False))))
        else:
            out.append((f"{name}_value", ~text.isin(*rule)))
    return out


def rules(folders: Sequence[str] = FOLDERS) -> list[Rule]:
    """The rules on single files. Columns: path, content, on_purpose, json (VARIANT, null where it isn't JSON)."""
    path, content = F.col("path"), F.col("content")
    name = F.substring_index("path", "/", -1)
    eligible, text = ~F.col("on_purpose"), path.rlike(checks.TEXT_SUFFIX)
    sensitive = name.rlike(checks.SENSITIVE_NAME)
    is_json = eligible & path.rlike(r"(?i)\.json$")
    config = is_json & (name == "run_config.json")
    placeholder = lambda v: F.lower(path).startswith("tests/") & F.lower(v).rlike(checks.PLACEHOLDER)
    secret = reduce(Column.__or__, [F.exists(F.regexp_extract_all(content, F.lit(p), 1), lambda v: ~placeholder(v)) for p in checks.SECRETS])
    found = [
        Rule("json_invalid", is_json, F.col("json").isNull()),
        Rule("sensitive_name", sensitive, name != checks.SAMPLE_NAME),
        Rule("secret", ~sensitive & text, secret),
        Rule("personal_path", ~sensitive & text, content.rlike(checks.PERSONAL_PATH)),
        Rule("tracked_experiment", path.rlike("^outputs/experiments/[^/]+/."), F.lit(True), WARNING, FULL),
    ]
    return found + [Rule(f"run_config_{r}", config & F.col("json").isNotNull(), bad, ERROR, FULL) for r, bad in contract_rules(F.col("json"), RUN_CONFIG)]


def by_file(files: DataFrame, level: str = BASIC, given: Sequence[Rule] | None = None) -> DataFrame:
    """(rule, key, detail, severity) of the rules of a level, in one pass over the files."""
    value = F.try_parse_json(F.regexp_replace("content", "^﻿", ""))
    rows = files.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("on_purpose", fails_on_purpose(F.col("path")))
    rows = rows.withColumn("json", F.when(F.col("path").rlike(r"(?i)\.json$"), value))
    asked = [r for r in (given if given is not None else rules()) if level == FULL or r.level == BASIC]
    broken = F.array_compact(F.array(*[F.when(r.purpose & F.coalesce(r.broken, F.lit(False)), F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"))) for r in asked]))
    return rows.select(F.explode(broken).alias("b"), "path").select("b.rule", F.col("path").alias("key"), F.lit("").alias("detail"), "b.severity")


def run_config_violations(files: DataFrame) -> DataFrame:
    """(rule, key, detail) of the configurations of runs among the files."""
    found = by_file(files, FULL, [r for r in rules() if r.name == "json_invalid" or r.name.startswith("run_config_")])
    named = F.substring_index("key", "/", -1) == "run_config.json"
    return found.where(named).select("rule", "key", "detail")


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of CSV texts: (path, row, name, value); faults of a file have a null name, and the fault as value."""
    for b in batches:
        out: list[tuple[str, int, str | None, str]] = []
        for path, content in zip(b["path"], b["content"], strict=True):
            reader = csv.reader(io.StringIO((content or "").removeprefix("﻿"), newline=""))
            try:
                header = [h.strip() for h in next(reader, [])]
                if not header:
                    out.append((path, 1, None, "csv_empty"))
                elif any(not h for h in header):
                    out.append((path, 1, None, "header_blank"))
                if len(set(header)) < len(header):
                    out.append((path, 1, None, "header_twice"))
                for at, row in enumerate(reader if header else (), 2):
                    if len(row) != len(header):
                        out.append((path, at, None, "row_width"))
                    else:
                        out += [(path, at, h, v.strip()) for h, v in zip(header, row, strict=True)]
                    if len(out) > 50_000:
                        yield pd.DataFrame(out, columns=["path", "row", "name", "value"])
                        out = []
            except csv.Error:
                out.append((path, reader.line_num, None, "csv_unreadable"))
        yield pd.DataFrame(out, columns=["path", "row", "name", "value"])


def csv_cells(files: DataFrame) -> DataFrame:
    return files.select("path", "content").mapInPandas(_cells, "path string, row long, name string, value string")


def in_csv_files(files: DataFrame) -> DataFrame:
    """(rule, key, detail, severity) of the CSV files: structure, ids, labels, scores and references; the detail is row:column.

    A file whose structure is broken is not looked into further, but for the old one, whose faults are a warning with their number.
    """
    cells = cut(csv_cells(files.where(F.col("path").rlike(r"(?i)\.csv$") & ~fails_on_purpose(F.col("path")))), "cells")
    path, name, value, old = F.col("path"), F.col("name"), F.col("value"), F.col("path") == OLD_LABELS
    at = F.concat_ws(":", F.col("row").cast("string"), name)
    said = lambda df, rule, severity=ERROR, detail=at: df.select(rule.alias("rule") if isinstance(rule, Column) else F.lit(rule).alias("rule"), path.alias("key"), detail.cast("string").alias("detail"), F.lit(severity).alias("severity"))
    faults = cells.where(name.isNull())
    parts = [said(faults.where(~old), value, detail=F.col("row"))]
    parts.append(said(faults.where(old).groupBy("path").agg(F.count("*").alias("n")), "old_structure", WARNING, F.col("n")))
    sound = cells.where(name.isNotNull()).join(faults.where(~old).select(path.alias("p")).distinct(), path == F.col("p"), "left_anti")
    lower = F.lower(path)
    unique = name.isin(*ID_COLUMNS) | ((name == "openalex_id") & lower.rlike(UNIQUE_WORKS) & ~lower.rlike(REPEATED_WORKS))
    ids = sound.where(unique)
    parts.append(said(ids.where(value == ""), "id_blank"))
    again = ids.where(value != "").groupBy("path", "name", "value").agg((F.count("*") - 1).alias("n")).where("n > 0")
    parts.append(said(again.groupBy("path", "name").agg(F.sum("n").alias("n")), "id_twice", detail=F.concat_ws(":", F.col("n").cast("string"), name)))
    allowed = F.when(lower.startswith(GRADED_FOLDER), value.isin(*GRADES)).otherwise(value.isin(*LABELS))
    parts.append(said(sound.where(name.isin(*LABEL_COLUMNS) & ~allowed), "label"))
    score = value.try_cast("double")
    scores = sound.where((name.isin(*SCORE_COLUMNS) | name.endswith("_score")) & (value != ""))
    parts.append(said(scores.where(score.isNull() | F.isnan(score) | (score < 0) | (score > 1)), "score"))
    works = sound.where(name == "openalex_id")
    samples = works.where(path.rlike(SAMPLES) & (value != "")).select(value.alias("known")).distinct()
    lost = works.where(path.rlike(REFERRING)).join(samples, value == F.col("known"), "left_anti")
    recent = F.contains(F.lower(F.substring_index("path", "/", -1)), F.lit("w2"))
    parts.append(said(lost.where(recent), "reference"))
    parts.append(said(lost.where(~recent).groupBy("path").agg(F.count("*").alias("n")), "old_reference", WARNING, F.col("n")))
    return checks.union(parts)


def missing_folders(files: DataFrame, folders: Sequence[str] = FOLDERS) -> DataFrame:
    due = files.sparkSession.createDataFrame([(f,) for f in folders], "folder string")
    there = files.where(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("f")).distinct()
    return due.join(there, F.col("folder") == F.col("f"), "left_anti").select(F.lit("folder_missing").alias("rule"), F.col("folder").alias("key"), F.lit("").alias("detail"))


def gate(files: DataFrame, level: str = BASIC, folders: Sequence[str] = FOLDERS) -> DataFrame:
    """(rule, key, detail, severity): all that a level finds in the files (path, content); a null content is empty.

    basic: folders, JSON, Markdown links, names and contents that should not be handed on. full: also CSV files, configurations of
    runs, and results that should not be kept with the project.
    """
    if level not in (BASIC, FULL):
        raise ValueError(f"level {level}")
    # Written once, as each part of the gate reads it; so are the cells, which are parsed once.
    files = cut(files.select(clean_text(F.col("path")).alias("path"), "content"), "files")
    as_error = lambda df: df.withColumn("severity", F.lit(ERROR))
    parts = [as_error(missing_folders(files, folders)), by_file(files, level), as_error(broken_links(files))]
    return checks.union(parts + [in_csv_files(files)] * (level == FULL))


def summary(found: DataFrame) -> DataFrame:
    """(rule, errors, warnings, status) of each rule that found something; an error fails it."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1))
    rows = found.groupBy("rule").agg(n(ERROR).alias("errors"), n(WARNING).alias("warnings"))
    return rows.withColumn("status", F.when(F.col("errors") > 0, "failed").otherwise("warning"))
