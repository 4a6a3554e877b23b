from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paperloom.operators import checks, contracts
from paperloom.plans import benchmark


def test_instants_are_those_that_exist(spark):
    good = ["2026-01-02T03:04:05+08:00", "2026-01-02T03:04Z", "2024-02-29 23:59:59.123456-23:59", "2026-01-02T00:00:00+0530"]
    bad = ["2026-01-02T99:99:99+08:00", "2026-01-02T24:00Z", "2026-01-02T03:60Z", "2026-01-02T03:04:60Z", "2026-01-02T03:04:05+99:99", "2026-01-02T03:04:05+24:00", "2026-01-02T03:04:05+08:60", "2026-02-30T03:04:05Z", "2025-02-29T03:04:05Z", "2026-01-02T03:04:05", "today", ""]
    df = spark.createDataFrame([(t,) for t in good + bad], "t string")
    got = {r["t"] for r in df.where(contracts.is_instant(F.col("t"))).collect()}
    assert got == set(good)
    for t in good:
        assert datetime.fromisoformat(t).tzinfo


POOL, ASSIGNED, NOTE = "pair_id string, research_query_id string, openalex_id string, title string", "pair_id string, annotator_slug string, assignment_role string", "pair_id string, annotator string, label string, ai_assistance string, reason string"


def drafted(spark, assigned, notes):
    pool = spark.createDataFrame([(f"p{i}", "q", f"w{i}", "t") for i in range(3)], POOL)
    made, _ = benchmark.draft(pool, spark.createDataFrame(assigned, ASSIGNED), spark.createDataFrame(notes, NOTE), None, "v1")
    return {r["pair_id"]: (r["agreement_status"], r["final_label"]) for r in made.collect()}


def test_a_draft_has_every_pair_or_none(spark):
    assigned = [(f"p{i}", "a", "primary") for i in range(3)] + [("p1", "b", "secondary"), ("p2", "b", "secondary")]
    notes = [(f"p{i}", "a", str(i), "none", "r") for i in range(3)] + [("p1", "b", "1", "none", "r"), ("p2", "b", "0", "none", "r")]
    assert drafted(spark, assigned, notes) == {"p0": ("single_annotation", "0"), "p1": ("agreement", "1"), "p2": ("disagreement", "")}
    for fault, a, n in (
        ("no primary annotation: p0", assigned[1:], notes),
        ("no primary annotation: p0", assigned, notes[1:]),
        ("secondary annotation is missing: p1", assigned, [x for x in notes if x[:2] != ("p1", "b")]),
        ("several primary annotations: p2", [*assigned, ("p2", "c", "primary")], [*notes, ("p2", "c", "1", "none", "r")]),
        ("several secondary annotations: p1", assigned, [*notes, ("p1", "b", "2", "none", "r")]),
    ):
        with pytest.raises(checks.ContractError, match=fault):
            drafted(spark, a, n)


def test_null_cells_are_blank_ones(spark):
    pool = spark.createDataFrame([("p0", "q", "w0", "t"), ("p1", "q", None, "t")], POOL)
    cells = {c: "" for c in benchmark.PROPOSAL} | {"proposed_final_label": "1", "proposal_status": contracts.PENDING, "proposal_reason": "r", "evidence_sources": "s"}

    def broken(**over):
        row = cells | {"pair_id": "p0", "research_query_id": "q", "openalex_id": "w0", "title": "t"} | over
        df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
        return {(r["rule"], r["key"]) for r in contracts.proposal_violations(df, pool).collect()}

    assert broken() == set()
    assert broken(research_query_id=None) == {("research_query_id", "p0")}
    assert broken(title=None) == {("title", "p0")}
    assert broken(pair_id="p1", openalex_id=None) == set()
    assert broken(pair_id="p1") == {("openalex_id", "p1")}
    assert ("status", "p0") in broken(proposal_status=None)
    assert broken(pair_id="x") == {("pair_unknown", "x")}


def test_repeated_annotations_are_one_violation(spark):
    pool = spark.createDataFrame([("p0", "q", "w0", "t")], POOL)
    assigned = spark.createDataFrame([("p0", "a", "primary")], ASSIGNED)
    notes = spark.createDataFrame([("p0", "a", "1", "none", "r"), ("p0", "a", "2", "none", "r")], NOTE)
    row = {c: "" for c in benchmark.JUDGEMENT} | {
        "pair_id": "p0", "research_query_id": "q", "openalex_id": "w0", "final_label": "1", "judgement_status": "ready", "agreement_status": "single_annotation", "judgement_basis": "primary_annotation",
        "primary_annotator": "a", "primary_label": "1", "primary_ai_assistance": "none", "benchmark_version": "v1",
    }
    judgements = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} string" for c in row))
    proposals = spark.createDataFrame([], ", ".join(f"{c} string" for c in benchmark.PROPOSAL))
    got = contracts.judgement_violations(judgements, pool, assigned, notes, proposals, "v1").collect()
    assert [(r["rule"], r["key"], r["detail"]) for r in got] == [("annotation_twice", "p0|a", "2")]
    nothing = judgements.withColumns({c: F.lit(None).cast("string") for c in ("judgement_basis", "agreement_status", "primary_label")})
    got = {r["rule"] for r in contracts.judgement_violations(nothing, pool, assigned, notes, proposals, "v1").collect()}
    assert {"judgement_basis", "agreement_status", "primary_label", "final_not_annotated"} <= got


def test_a_missing_label_is_no_agreement_with_a_blank_one(spark):
    pool = spark.createDataFrame([("p0", "q", "w0", "t")], POOL)
    assigned = spark.createDataFrame([("p0", "a", "primary"), ("p0", "b", "secondary")], ASSIGNED)
    notes = spark.createDataFrame([("p0", "a", "1", "none", "r"), ("p0", "b", "1", "none", "r")], NOTE)
    row = {c: "" for c in benchmark.JUDGEMENT} | {"pair_id": "p0", "final_label": "1", "judgement_status": "ready", "primary_annotator": "a", "secondary_annotator": "b", "benchmark_version": "v1"}
    proposals = spark.createDataFrame([], ", ".join(f"{c} string" for c in benchmark.PROPOSAL))

    def broken(primary, secondary):
        cells = tuple((row | {"primary_label": primary, "secondary_label": secondary}).values())
        judgements = spark.createDataFrame([cells], ", ".join(f"{c} string" for c in row))
        return {r["rule"] for r in contracts.judgement_violations(judgements, pool, assigned, notes, proposals, "v1").collect()}

    for one, other in ((None, ""), ("", None), (None, "1")):
        got = broken(one, other)
        assert {"state", "proposal_missing"} <= got and "final_not_annotated" not in got
    for one, other in ((None, None), ("", "")):
        got = broken(one, other)
        assert "final_not_annotated" in got and not {"state", "proposal_missing"} & got
