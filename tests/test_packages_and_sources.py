import csv
import json

import pytest
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.operators import checks, contracts, lineage
from paperloom.plans import benchmark, package
from paperloom.sources import files, rest

NAMES = {f"a{i}": f"Name {i}" for i in range(3)}
PROTOCOL = contracts.Protocol(NAMES, "v1", pairs=6, queries=2, per_query=3, secondaries_per_query=3, per_annotator=4, partners_most=2)
POOL = [
    dict(pair_id=f"P{i}", research_query_id=f"RQ{i // 3}", openalex_id=f"W{i}", title=f"title {i}", abstract="words", landing_page_url="https://example.org/1", publication_year="2020", doi="", research_question_zh="问", research_question_en="q", pool_version="v1")
    for i in range(6)
]
ASSIGNED = [dict(pair_id=f"P{i}", annotator_slug=f"a{i % 3}", annotator_name=f"Name {i % 3}", assignment_role="primary") for i in range(6)]
ASSIGNED += [dict(pair_id=f"P{i}", annotator_slug=f"a{(i + 1) % 3}", annotator_name=f"Name {(i + 1) % 3}", assignment_role="secondary") for i in range(6)]


def note(pair, who, label):
    return {c: POOL[pair][c] for c in contracts.READ_ONLY} | dict(annotator=who, label=label, confidence="high", evidence_level="A", reason="because", source_checked="title_abstract", evidence_url="", ai_assistance="none")


def write(path, rows):
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, list(rows[0]))
        out.writeheader()
        out.writerows(rows)
    return str(path)


def text_frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0]))


@pytest.fixture
def annotated(tmp_path):
    """Pair 2 is a disagreement, all others agree."""
    notes = {s: [] for s in NAMES}
    for a in ASSIGNED:
        i = int(a["pair_id"][1:])
        notes[a["annotator_slug"]].append(note(i, a["annotator_slug"], "0" if i == 2 and a["assignment_role"] == "secondary" else str(i % 3)))
    paths = {"pool": write(tmp_path / "pool.csv", POOL), "assignments": write(tmp_path / "assignments.csv", ASSIGNED)}
    return notes, paths | {s: write(tmp_path / f"{s}.csv", rows) for s, rows in notes.items()}


def reference(path):
    return {"path": path.name, "sha256": package.file_sha256(path)}


def manifest(folder, names, judgements, proposals, status, version, parent=None):
    m = {
        "schema_version": "1.0", "benchmark_version": version, "label_scheme": {"type": "graded_relevance", "allowed_values": [0, 1, 2]}, "record_unit": "research_query_id + openalex_id", "status": status,
        "inputs": {"candidate_pool": reference(folder / "pool.csv"), "assignments": reference(folder / "assignments.csv"), "annotations": {s: reference(folder / f"{s}.csv") for s in names}},
        "artifacts": {"judgements": reference(judgements), "adjudication_proposals": reference(proposals)},
        "counts": {"pair_count": 6, "single_annotation_pairs": 0, "agreement_pairs": 5, "disagreement_pairs": 1, "pending_human_review_pairs": int(status == "proposed")},
        "approval": {"checklist": dict.fromkeys(benchmark.CHECKLIST, status == "approved")} | ({"approved_by": "b", "approved_at": "2026-01-01T00:00Z", "review_note": "n"} if status == "approved" else {}),
    }
    m["input_set_identity"] = benchmark.inputs_identity(m["inputs"])
    if parent:
        m["parent_package"] = reference(parent)
    if status == "approved":
        (folder / "audit.csv").write_text("pair_id\n")
        m["blind_ai_audit_provenance"] = {
            "description": lineage.AUDIT, "blind_phase_completed_before_human_comparison": True, "reviewer_independence_checked": True, "required_review_count": 1, "completed_review_count": 1,
            "files": dict.fromkeys(lineage.AUDIT_FILES, reference(folder / "audit.csv")),
        }
    path = folder / f"manifest_{status}.json"
    path.write_text(json.dumps(m))
    return path


def test_a_package_from_draft_to_evaluation(spark, annotated, tmp_path, capsys):
    notes, paths = annotated
    pool, assigned = text_frame(spark, POOL), text_frame(spark, ASSIGNED)
    said = text_frame(spark, [r for rows in notes.values() for r in rows])
    suggestion = text_frame(spark, [dict(pair_id="P2", proposed_final_label="2", proposal_reason="why", evidence_level="A", evidence_sources="title_abstract", confidence="high")])
    with pytest.raises(checks.ContractError):
        benchmark.draft(pool, assigned, said, suggestion.limit(0), "v1-draft")
    judgements, proposals = benchmark.draft(pool, assigned, said, suggestion, "v1-draft")
    rows = [r.asDict() for r in judgements.orderBy("pair_id").collect()]
    assert [r["judgement_status"] for r in rows] == ["ready", "ready", contracts.PENDING, "ready", "ready", "ready"] and [r["final_label"] for r in rows] == ["0", "1", "", "0", "1", "2"]
    j = tmp_path / "j_draft.csv"
    p = tmp_path / "p_draft.csv"
    write(j, rows)
    write(p, [r.asDict() for r in proposals.collect()])
    first = manifest(tmp_path, NAMES, j, p, "proposed", "v1-draft")
    assert [tuple(r) for r in benchmark.validate(spark, str(first), PROTOCOL, False)[2].collect()] == []
    with pytest.raises(checks.ContractError, match="not_approved"):
        benchmark.validate(spark, str(first), PROTOCOL)
    with pytest.raises(checks.ContractError, match="frozen"):
        benchmark.validate(spark, str(first), PROTOCOL, False, {"candidate_pool": "0" * 64})
    # The review approves the proposal.
    review = {"review_decision": "approve", "reviewer": "a1", "reviewed_at": "2026-01-02T03:04:05+00:00", "review_note": "seen"}
    assert {a["annotator_slug"] for a in ASSIGNED if a["pair_id"] == "P2"} == {"a2", "a0"}
    for r in rows:
        r["benchmark_version"] = "v1"
    rows[2] |= review | {"final_label": "2", "judgement_status": "adjudicated"}
    proposal = proposals.collect()[0].asDict() | review | {"proposal_status": "reviewed", "reviewed_label": "2"}
    j2, p2 = tmp_path / "j.csv", tmp_path / "p.csv"
    write(j2, rows)
    write(p2, [proposal])
    second = manifest(tmp_path, NAMES, j2, p2, "approved", "v1", first)
    assert [tuple(r) for r in benchmark.validate(spark, str(second), PROTOCOL)[2].collect()] == []
    ranking = spark.createDataFrame([("m", x["pair_id"], x["research_query_id"], i % 3 + 1) for i, x in enumerate(POOL)], "method string, pair_id string, research_query_id string, rank int")
    out = tmp_path / "experiment.json"
    found = benchmark.evaluate_package(spark, str(second), ranking, PROTOCOL, str(out), (3,), allow_dirty=True)
    assert [(r["research_query_id"], round(r["precision"], 3)) for r in found] == [("RQ0", 0.667), ("RQ1", 0.667), ("macro", 0.667)]
    assert json.loads(out.read_text())["environment"]["dependencies"]["pyspark"]
    # What the approved package changes of the draft, and a reviewer who annotated the pair.
    rows[0]["primary_label"], rows[2]["reviewer"] = "2", "a0"
    write(j2, rows)
    third = manifest(tmp_path, NAMES, j2, p2, "approved", "v1", first)
    broken = {(r["rule"], r["key"], r["detail"]) for r in benchmark.validate(spark, str(third), PROTOCOL)[2].collect()}
    assert {("frozen_changed", "P0", "primary_label"), ("reviewer_not_independent", "P2", ""), ("primary_label", "P0", "")} <= broken
    (tmp_path / "pool.csv").write_text("changed")
    with pytest.raises(checks.ContractError, match="changed"):
        benchmark.validate(spark, str(third), PROTOCOL)


def test_tasks(spark, annotated, tmp_path, capsys):
    notes, paths = annotated
    args = ["--pool", paths["pool"], "--assignments", paths["assignments"], "--annotator", "a0", "--file", str(tmp_path / "a0_task.csv")]
    assert cli.main(["task", *args]) == 0
    with pytest.raises(FileExistsError):
        cli.main(["task", *args])
    with open(tmp_path / "a0_task.csv", encoding="utf-8") as f:
        made = list(csv.DictReader(f))
    assert [r["pair_id"] for r in made] == ["P0", "P2", "P3", "P5"] and all(r["label"] == "" for r in made) and "pool_version" not in made[0]
    assert cli.main(["check-task", *args]) == 1
    assert "label P0" in capsys.readouterr().out
    assert cli.main(["check-task", *args[:-1], paths["a0"]]) == 0
    bad = [dict(r) for r in notes["a0"]]
    bad[0] |= {"title": "other", "evidence_level": "C", "evidence_url": "ftp://x"}
    write(tmp_path / "bad.csv", bad + bad[-1:])
    assert cli.main(["check-task", *args[:-1], str(tmp_path / "bad.csv")]) == 1
    said = capsys.readouterr().out
    assert all(x in said for x in ("read_only_changed P0 title", "fulltext_needed P0", "evidence_url P0", "external_source_needed P0", "pair_twice"))
    assert cli.main(["agreement", "--assignments", paths["assignments"], "--annotations", *[paths[s] for s in NAMES]]) == 0
    said = capsys.readouterr().out
    assert '"exact": 5' in said and "a0 4 4 complete" in said


def test_label_sources(spark, tmp_path):
    twice = write(tmp_path / "l.csv", [dict(openalex_id="W1", label="高度相关"), dict(openalex_id=" W1", label="不相关"), dict(openalex_id="W2", label="?")])
    assert sorted(map(tuple, files.read_labels(spark, twice).collect())) == [("W1", "不相关"), ("W2", "?")]
    with pytest.raises(checks.ContractError):
        files.read_labels(spark, twice, "unique")
    reviewed = write(tmp_path / "r.csv", [dict(openalex_id=f"W{i}", label="1", annotator=a, review_status=s) for i, (a, s) in enumerate([("me", ""), ("AI-assisted-draft", ""), ("me", "待人工复核!")])])
    kept, dropped = files.read_reviewed_labels(spark, reviewed)
    assert [r["openalex_id"] for r in kept.collect()] == ["W0"] and dropped == {"ai_draft": 1, "pending_review": 1}
    row = dict.fromkeys(files.LABEL_COLUMNS, "x") | {"openalex_id": "https://openalex.org/W12"}
    good = write(tmp_path / "g.csv", [row])
    sample = write(tmp_path / "s.csv", [dict(openalex_id="https://openalex.org/W13", title="t")])
    assert files.read_provenance_labels(spark, good).count() == 1
    with pytest.raises(checks.ContractError, match="missing_reference"):
        files.read_provenance_labels(spark, good, [sample])
    with pytest.raises(checks.ContractError, match="openalex_id"):
        files.read_provenance_labels(spark, write(tmp_path / "b.csv", [row | {"openalex_id": "W12"}]))


def test_terms_become_queries(spark, tmp_path, capsys):
    term = dict(term_id="T1", term="Deep Sea", normalized_term="deep sea", category="object_term", strength="3", include_in_query="true", example="", note="", source="s")
    rows = [term, term | dict(term_id="T2", term="fish", normalized_term="fish", category="weak_term"), term | dict(term_id="T3", term="no", normalized_term="no", include_in_query="False")]
    path, blueprint, out = write(tmp_path / "t.csv", rows), tmp_path / "b.json", tmp_path / "q.json"
    blueprint.write_text(json.dumps([{"query_id": "q1", "terms": ["FISH", "deep sea"]}]))
    assert cli.main(["terms", "--terms", path, "--blueprint", str(blueprint), "--output", str(out)]) == 0
    assert json.loads(out.read_text())["queries"] == [{"query_id": "q1", "keyword": "fish Deep Sea", "included_terms": ["fish", "Deep Sea"], "included_term_ids": ["T2", "T1"], "categories": ["weak_term", "object_term"]}]
    blueprint.write_text(json.dumps([{"query_id": "q1", "terms": ["no"]}]))
    assert cli.main(["terms", "--terms", path, "--blueprint", str(blueprint), "--output", str(out)]) == 1
    with pytest.raises(checks.ContractError, match="strength"):
        files.read_terms(spark, write(tmp_path / "bad.csv", [term | dict(strength="11")]))


def test_other_sources(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("a,b,c\n1,x,2.5\n2,,NaN\n")
    assert [tuple(r) for r in files.read_inferred_csv(spark, str(path)).collect()] == [(1, "x", 2.5), (2, None, None)]
    q = {"research_query_id": "RQ1", "question_zh": "问", "question_en": "q", "ranking_keyword": "k", "acquisition_query_ids": ["a"], "scope_in": ["i"], "scope_out": ["o"]}
    path = tmp_path / "rq.json"
    path.write_text(json.dumps({"queries": [q | {"research_query_id": f"RQ{i}"} for i in range(3)]}))
    assert len(files.read_research_queries(str(path))) == 3
    for bad in ([q] * 3, [q | {"scope_in": []}, q, q], [q]):
        path.write_text(json.dumps({"queries": bad}))
        with pytest.raises(ValueError):
            files.read_research_queries(str(path))


def test_files_of_a_project(spark, tmp_path, capsys):
    root = tmp_path / "project"
    for name, text in (
        (".env", "x"), (".env.example", ""), ("keys/id_rsa", "x"), ("a b+c.md", "see /home/" + "someone/x"), ("tests/t.py", 'token = "fake-value-0123456789"'), ("tests/u.py", 'token = "fakevalue0123456789"'),
        ("docs/d.md", 'token = "fake-value-0123456789"'), (".venv/x.py", 'token = "0123456789abcdefgh"'), ("img.bin", "AKIA" + "A" * 16),
    ):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert cli.main(["files", "--root", str(root)]) == 1
    found = {tuple(line.split(" ", 1)) for line in capsys.readouterr().out.splitlines() if line}
    assert {(r, k.strip()) for r, k in found} == {("sensitive_name", ".env"), ("sensitive_name", "keys/id_rsa"), ("personal_path", "a b+c.md"), ("secret", "tests/u.py"), ("secret", "docs/d.md")}


def pages(*answers):
    left = list(answers)
    return lambda url, timeout: left.pop(0) if left else (500, {}, b"")


def test_a_single_page():
    page = (200, {}, json.dumps({"results": [{"id": "W1"}, {"id": "W2"}], "meta": {}}).encode())
    assert [w["id"] for w in rest.fetch_page("http://x", "k", 1, get=pages(page))] == ["W1"]
    with pytest.raises(RuntimeError):
        rest.fetch_page("http://x", "k", get=pages((404, {}, b"")))
    with pytest.raises(ValueError):
        rest.fetch_page("http://x", " ")


def test_bounds_meet_and_a_failed_scan_is_no_scan(monkeypatch):
    class AtLeast:
        attribute, value = ("publication_year",), 2010

    AtLeast.__name__ = "GreaterThanOrEqual"
    reader = rest.WorksReader({"url": "http://x", "queries": '{"q": "k"}', "from_year": "2015", "to_year": "2020"})
    assert len(list(reader.pushFilters([AtLeast()]))) == 1 and reader.bounds == {"from_year": 2015, "to_year": 2020}
    AtLeast.value = 2018
    list(reader.pushFilters([AtLeast()]))
    assert reader.bounds["from_year"] == 2018
    AtLeast.value = 2030
    list(reader.pushFilters([AtLeast()]))
    assert list(reader.read(reader.partitions()[0])) == []
    monkeypatch.setattr(rest, "fetch", lambda *a, **k: rest.FetchResult(works=[{"id": "W1"}], stop_reason="request_failed", pages=1))
    with pytest.raises(RuntimeError, match="after 1 pages"):
        list(rest.WorksReader({"url": "http://x", "queries": '{"q": "k"}'}).read(rest.QueryPartition("q", "k")))


def test_summary_of_a_fetch(tmp_path):
    asked = {"keyword": "k", "max_results": 3, "from_year": None}
    row = rest.write_summary(rest.FetchResult(works=[{}], stop_reason="cursor_exhausted", pages=1, requests=1), asked, str(tmp_path / "s.csv"))
    with open(tmp_path / "s.csv", encoding="utf-8") as f:
        assert list(csv.DictReader(f))[0]["stop_reason"] == "cursor_exhausted"
    assert row["query_id"] == rest.query_identity(dict(reversed(asked.items()))) and len(row["query_id"]) == 12


def test_ranking_against_labels(spark, tmp_path, capsys):
    ranking = write(tmp_path / "r.csv", [dict(openalex_id=f"W{i}", rank=str(i + 1)) for i in range(4)])
    labels = write(tmp_path / "l.csv", [dict(openalex_id=f"W{i}", label=x) for i, x in enumerate("2001")])
    assert cli.main(["evaluate", "--ranking", ranking, "--labels", labels, "--k", "3"]) == 0
    assert json.loads(capsys.readouterr().out)[0]["precision"] == pytest.approx(1 / 3)


def test_ranks_within_groups_equal_a_window(spark):
    from pyspark.sql import Window

    from paperloom.operators.rank import ranked

    df = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 10 < 8, "hot").when(F.col("id") % 10 == 8, "b").alias("g"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    order = [F.desc("v"), F.asc("id")]
    due = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(tuple, ranked(df, "r", order, ["g"]).collect()), key=str) == sorted(map(tuple, due.collect()), key=str)
    assert ranked(df.limit(0), "r", order, ["g"]).collect() == []


def test_lineage_never_broadcasts_a_table_of_packages(spark, monkeypatch):
    from paperloom.operators import lineage

    plans, cut = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, label))
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(9)], "id long, parent long")
    assert {r["id"]: (r["root"], r["depth"]) for r in lineage.lineage(df).collect()} == {i: (0, i) for i in range(9)}
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
