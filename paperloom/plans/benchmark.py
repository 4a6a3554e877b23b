"""Annotation tasks, judged packages and their evaluation: what the driver does around the contracts and metrics.

A package is a manifest (JSON) beside its files: inputs (candidate_pool, assignments, annotations by annotator), artifacts
(judgements, adjudication_proposals), each with path and sha256, counts, approval, and, once approved, the draft that was reviewed.
"""

from __future__ import annotations

import importlib.metadata
import json
import platform
import sys
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions.norm import clean_text
from paperloom.operators import checks, contracts, evaluate, lineage
from paperloom.sources import files

from . import package, runs

#: The cells that an annotator fills in, the columns of judgements and proposals, and the keys of an approval's checklist.
ANSWERS = ("label", "confidence", "evidence_level", "reason", "source_checked", "evidence_url", "ai_assistance")
JUDGEMENT = (
    "pair_id", "research_query_id", "openalex_id", "final_label", "proposed_label", "judgement_status", "agreement_status", "judgement_basis", "primary_annotator", "primary_label", "primary_ai_assistance",
    "secondary_annotator", "secondary_label", "secondary_ai_assistance", "adjudication_ai_assistance", *contracts.REVIEW, "benchmark_version",
)
PROPOSAL = ("pair_id", *contracts.PROPOSAL_FROZEN, "proposal_status", "review_decision", "reviewed_label", "reviewer", "reviewed_at", "review_note")
CHECKLIST = {"all_disagreements_human_reviewed", "original_annotation_provenance_verified", "frozen_input_anchor_verified", "parent_draft_reviewed"}


def create_task(pool: DataFrame, assignments: DataFrame, annotator: str, path: str, force: bool = False) -> int:
    """An annotator's file: what may be read of each assigned pair and empty answers; neither score, rank nor bucket is told."""
    if Path(path).exists() and not force:
        raise FileExistsError(f"{path} is there and may hold answers")
    mine = assignments.where(F.col("annotator_slug") == annotator).select(F.col("pair_id").alias("p")).distinct()
    if not mine.take(1):
        raise ValueError(f"{annotator} has no pairs")
    shown = [F.col(c) if c in pool.columns else F.lit("").alias(c) for c in contracts.READ_ONLY]
    task = pool.join(mine, F.col("pair_id") == F.col("p"), "left_semi").select(*shown, F.lit(annotator).alias("annotator"), *[F.lit("").alias(c) for c in ANSWERS])
    return files.write_csv_file(task.orderBy("pair_id"), path, [*contracts.READ_ONLY, "annotator", *ANSWERS], bom=False)


def draft(pool: DataFrame, assignments: DataFrame, annotations: DataFrame, suggestions: DataFrame | None, version: str) -> tuple[DataFrame, DataFrame]:
    """(judgements, proposals) before any review: single annotations and agreements are ready, disagreements wait for one.

    suggestions: pair_id, proposed_final_label, proposal_reason, evidence_level, evidence_sources, confidence, one for each disagreement.
    """
    notes = annotations.select(F.col("pair_id").alias("np"), F.col("annotator").alias("who"), clean_text(F.col("label")).alias("said"), clean_text(F.col("ai_assistance")).alias("helped"), "reason")
    met = assignments.join(notes, F.col("pair_id").eqNullSafe(F.col("np")) & F.col("annotator_slug").eqNullSafe(F.col("who")), "left")
    of = lambda role, what: F.when(F.col("assignment_role") == role, what)
    note = F.when(F.col("np").isNotNull(), F.struct("who", "said", "helped", "reason"))
    sides = met.groupBy(F.col("pair_id").alias("p")).agg(
        *[F.min(of(r, note)).alias(r) for r in contracts.ROLES],
        *[F.count(of(r, F.lit(1))).alias(f"{r}_rows") for r in contracts.ROLES],
        *[F.count(of(r, note)).alias(f"{r}_notes") for r in contracts.ROLES],
    )
    rows = pool.select("pair_id", "research_query_id", "openalex_id", "title").join(sides, F.col("pair_id") == F.col("p"), "left")
    # One row of each pair and side, or the draft would be short or long of pairs without a word.
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    faults = [("a pair has no primary annotation", n("primary_notes") == 0), ("a secondary annotation is missing", n("secondary_notes") < n("secondary_rows"))]
    faults += [(f"a pair has several {r} annotations", n(f"{r}_notes") > 1) for r in contracts.ROLES]
    told = rows.agg(*[F.min(F.when(bad, F.coalesce("pair_id", F.lit("")))).alias(f"f{i}") for i, (_, bad) in enumerate(faults)]).first()
    if any(v is not None for v in told):
        raise checks.ContractError("; ".join(f"{said}: {v}" for (said, _), v in zip(faults, told, strict=True) if v is not None))
    single = F.col("secondary").isNull()
    apart = ~single & (F.col("primary.said") != F.col("secondary.said"))
    if suggestions is not None:
        given = suggestions.select(F.struct(*[F.col(c) for c in ("pair_id", "proposed_final_label", "proposal_reason", "evidence_level", "evidence_sources", "confidence")]).alias("s"))
        rows = rows.join(given, F.col("pair_id") == F.col("s.pair_id"), "left")
        if rows.where(apart & F.col("s").isNull()).take(1):
            raise checks.ContractError("a disagreement has no proposal")
        if rows.where(~apart & F.col("s").isNotNull()).take(1):
            raise checks.ContractError("a proposal has no disagreement")
    else:
        rows = rows.withColumn("s", F.lit(None).cast("struct<pair_id:string,proposed_final_label:string,proposal_reason:string,evidence_level:string,evidence_sources:string,confidence:string>"))
    blank = F.lit("")
    second = lambda c: F.coalesce(F.col(f"secondary.{c}"), blank)
    judgements = rows.select(
        "pair_id",
        "research_query_id",
        "openalex_id",
        F.when(apart, "").otherwise(F.col("primary.said")).alias("final_label"),
        F.when(apart, F.coalesce("s.proposed_final_label", blank)).otherwise("").alias("proposed_label"),
        F.when(apart, contracts.PENDING).otherwise(contracts.READY).alias("judgement_status"),
        F.when(single, "single_annotation").when(apart, "disagreement").otherwise("agreement").alias("agreement_status"),
        F.when(single, "primary_annotation").when(apart, "ai_adjudication_proposal").otherwise("double_annotation_agreement").alias("judgement_basis"),
        F.col("primary.who").alias("primary_annotator"),
        F.col("primary.said").alias("primary_label"),
        F.col("primary.helped").alias("primary_ai_assistance"),
        second("who").alias("secondary_annotator"),
        second("said").alias("secondary_label"),
        second("helped").alias("secondary_ai_assistance"),
        F.when(apart, "label_suggestion").otherwise("").alias("adjudication_ai_assistance"),
        *[blank.alias(c) for c in contracts.REVIEW],
        F.lit(version).alias("benchmark_version"),
    )
    proposals = rows.where(apart).select(
        "pair_id", "research_query_id", "openalex_id", "title",
        F.col("primary.who").alias("annotator_a"), F.col("primary.said").alias("label_a"), F.col("primary.reason").alias("reason_a"),
        F.col("secondary.who").alias("annotator_b"), F.col("secondary.said").alias("label_b"), F.col("secondary.reason").alias("reason_b"),
        "s.proposed_final_label", "s.proposal_reason", "s.evidence_level", "s.evidence_sources", "s.confidence",
        F.lit(contracts.PENDING).alias("proposal_status"), *[blank.alias(c) for c in ("review_decision", "reviewed_label", "reviewer", "reviewed_at", "review_note")],
    )
    return judgements.select(*JUDGEMENT), proposals.select(*PROPOSAL)


def pinned(root: Path, ref: object) -> Path:
    """The file of a reference {path, sha256} under root; a missing or changed one is an error."""
    if not isinstance(ref, dict):
        raise checks.ContractError("a reference has path and sha256")
    path = package.inside(root, str(ref.get("path") or ""))
    if not path.is_file() or package.file_sha256(path) != ref.get("sha256"):
        raise checks.ContractError(f"{ref.get('path')} is missing or changed")
    return path


def inputs_identity(inputs: Mapping) -> str:
    """The digest of all inputs' paths and digests, whatever their order."""
    return "sha256:" + runs.input_identity(inputs)


def manifest_faults(m: Mapping, approved: bool) -> list[str]:
    """What a manifest itself gets wrong."""
    out = []
    status, approval, version = m.get("status"), m.get("approval"), str(m.get("benchmark_version") or "")
    checklist = approval.get("checklist") if isinstance(approval, dict) else None
    texts = [str((approval or {}).get(k) or "").strip() for k in ("approved_by", "approved_at", "review_note")]
    rules = [
        ("schema_version", m.get("schema_version") != "1.0"),
        ("benchmark_version", not version.strip()),
        ("label_scheme", m.get("label_scheme") != {"type": "graded_relevance", "allowed_values": [0, 1, 2]}),
        ("record_unit", m.get("record_unit") != "research_query_id + openalex_id"),
        ("status", status not in ("proposed", "approved")),
        ("draft_approved", status == "approved" and "draft" in version.lower()),
        ("not_approved", approved and status != "approved"),
        ("checklist", not isinstance(checklist, dict) or set(checklist) != CHECKLIST),
        ("inputs_identity", m.get("input_set_identity") != inputs_identity(m.get("inputs") or {})),
        ("approval_invented", status == "proposed" and (any(texts) or any(v is not False for v in (checklist or {}).values()) or m.get("parent_package") is not None)),
        ("approval_incomplete", status == "approved" and (not all(texts) or any(v is not True for v in (checklist or {}).values()) or not isinstance(m.get("parent_package"), dict))),
    ]
    out += [name for name, bad in rules if bad]
    return out + (audit_faults(m.get("blind_ai_audit_provenance")) if status == "approved" else [])


def audit_faults(audit: object) -> list[str]:
    """What the provenance of a blind audit lacks: how the package was made, the order of its steps, all reviews, and its files."""
    if not isinstance(audit, dict):
        return ["audit_missing"]
    required = audit.get("required_review_count")
    whole = isinstance(required, int) and not isinstance(required, bool) and required > 0
    rules = [
        ("audit_description", audit.get("description") != lineage.AUDIT),
        ("audit_not_blind", any(audit.get(k) is not True for k in ("blind_phase_completed_before_human_comparison", "reviewer_independence_checked"))),
        ("audit_reviews", not whole or audit.get("completed_review_count") != required),
        ("audit_files", not isinstance(audit.get("files"), dict) or set(audit["files"]) != set(lineage.AUDIT_FILES)),
    ]
    return [name for name, bad in rules if bad]


def validate(spark: SparkSession, manifest_path: str, protocol: contracts.Protocol, approved: bool = True, trusted: Mapping[str, str] | None = None) -> tuple[dict, dict[str, DataFrame], DataFrame]:
    """(manifest, tables, violations) of a package.

    ``trusted`` pins digests of inputs from outside the package, which can't bless changed inputs by naming them itself.
    """
    path = Path(manifest_path).resolve()
    m = json.loads(path.read_text(encoding="utf-8-sig"))
    if faults := manifest_faults(m, approved):
        raise checks.ContractError(", ".join(faults))
    root, inputs, artifacts = path.parent, m["inputs"], m["artifacts"]
    for name, digest in (trusted or {}).items():
        if (inputs.get(name) or {}).get("sha256") != digest:
            raise checks.ContractError(f"{name} is not the frozen input")
    if set(inputs["annotations"]) != set(protocol.annotators):
        raise checks.ContractError("a file of each annotator is needed")
    read = lambda ref: files.read_strict_csv(spark, str(pinned(root, ref)))
    t = {"candidate_pool": read(inputs["candidate_pool"]), "assignments": read(inputs["assignments"])}
    t |= {k: read(artifacts[k]) for k in ("judgements", "adjudication_proposals")}
    notes = [read(inputs["annotations"][a]).withColumn("file_", F.lit(a)) for a in sorted(protocol.annotators)]
    t["annotations"] = reduce(DataFrame.unionByName, notes)
    for name, due in (("judgements", JUDGEMENT), ("adjudication_proposals", PROPOSAL)):
        if tuple(t[name].columns) != due:
            raise checks.ContractError(f"columns of {name}")
    t |= {k: df.na.fill("") for k, df in t.items()}
    found = [
        contracts.pool_violations(t["candidate_pool"], protocol),
        contracts.assignment_violations(t["assignments"], t["candidate_pool"], protocol),
        checks.violations(t["annotations"], "annotator_of_file", F.col("annotator") != F.col("file_"), F.col("pair_id"), F.col("file_")),
        contracts.annotation_violations(t["annotations"].drop("file_"), t["candidate_pool"], t["assignments"]),
        contracts.proposal_violations(t["adjudication_proposals"], t["candidate_pool"]),
        contracts.judgement_violations(t["judgements"], t["candidate_pool"], t["assignments"], t["annotations"], t["adjudication_proposals"], m["benchmark_version"], m["status"] == "approved", protocol.pairs),
    ]
    counts = {r["agreement_status"]: r["n"] for r in t["judgements"].groupBy("agreement_status").agg(F.count("*").alias("n")).collect()}
    pending = t["judgements"].where(F.col("judgement_status") == contracts.PENDING).count()
    due = {"pair_count": sum(counts.values()), "single_annotation_pairs": counts.get("single_annotation", 0), "agreement_pairs": counts.get("agreement", 0), "disagreement_pairs": counts.get("disagreement", 0), "pending_human_review_pairs": pending}
    if m.get("counts") != due:
        raise checks.ContractError(f"counts {m.get('counts')} are not {due}")
    if m["status"] == "approved":
        for ref in m["blind_ai_audit_provenance"]["files"].values():
            pinned(root, ref)
        parent = pinned(root, m["parent_package"])
        if parent == path:
            raise checks.ContractError("a package is not its own parent")
        before, earlier, _ = validate(spark, str(parent), protocol, False, trusted)
        if before["status"] != "proposed" or before["input_set_identity"] != m["input_set_identity"]:
            raise checks.ContractError("the parent is no draft on the same inputs")
        found += [
            contracts.parent_violations(t["judgements"], earlier["judgements"], contracts.JUDGEMENT_FROZEN),
            contracts.parent_violations(t["adjudication_proposals"], earlier["adjudication_proposals"], contracts.PROPOSAL_FROZEN),
        ]
    return m, t, checks.union(found)


def environment(folder: Path) -> dict:
    """What a result depends on besides its inputs: revision, changes, and the versions of what runs."""
    versions = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    return {"revision": runs.revision(folder), "dirty": runs.dirty(folder), "python": platform.python_version(), "platform": f"{platform.system()} {platform.machine()}", "implementation": sys.implementation.cache_tag, "dependencies": versions}


def evaluate_judged(judgements: DataFrame, rankings: DataFrame, ks: Sequence[int]) -> DataFrame:
    """(method, research_query_id, k, metrics) and their means, of rankings (method, pair_id, research_query_id, rank)."""
    grades = judgements.select(F.col("pair_id").alias("j"), F.col("final_label").try_cast("int").alias("grade"))
    rows = rankings.join(grades, F.col("pair_id") == F.col("j"), "left").drop("j")
    m = evaluate.metrics(rows, ["method", "research_query_id"], list(ks))
    means = evaluate.macro(m, ["method", "k"], ["precision", "ndcg", "coverage"]).withColumn("research_query_id", F.lit("macro"))
    columns = ["method", "research_query_id", "k", "precision", "ndcg", "coverage"]
    return m.select(*columns).unionByName(means.select(*columns))


def evaluate_package(spark: SparkSession, manifest_path: str, rankings: DataFrame, protocol: contracts.Protocol, output: str, ks: Sequence[int] = (5, 10), allow_dirty: bool = False) -> list[dict]:
    """Metrics of rankings on an approved package, with a manifest of the experiment beside them; a changed tree is refused."""
    where = environment(Path.cwd())
    if where["dirty"] and not allow_dirty:
        raise checks.ContractError("the working tree has changes")
    m, t, found = validate(spark, manifest_path, protocol)
    checks.require(found)
    rows = [r.asDict() for r in evaluate_judged(t["judgements"], rankings, ks).orderBy("method", "research_query_id", "k").collect()]
    files.write_json({"benchmark_version": m["benchmark_version"], "benchmark_sha256": package.file_sha256(Path(manifest_path)), "input_set_identity": m["input_set_identity"], "environment": where, "ks": list(ks), "created_at": runs.now(), "metrics": rows}, output)
    return rows
