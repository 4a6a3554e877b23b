"""The gate, lineage of packages, and reviews that keep each decision."""

import os
import posixpath
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.operators import gate, lineage
from paperloom.plans import benchmark, reviews


def table(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def found(df):
    return sorted(tuple(r[c] for c in df.columns) for r in df.collect())


def test_paths_are_normalised_as_a_file_system_does(spark):
    paths = ["a/b/../c", "a/./b//c/", "../x", "a/../../x/..", "", ".", "a/..", "/r/s", "a/b/c/../../../d", "../../a"]
    got = {r["p"]: r["n"] for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", gate.normal_path(F.col("p")).alias("n")).collect()}
    assert got == {p: "" if (n := posixpath.normpath(p.lstrip("/") or ".")) == "." else n for p in paths}


def test_links_with_titles_escapes_and_anchors(spark):
    files = {
        "docs/a.md": "[1](b.md) ![2](<my file.md> \"t\") [3](my%20file.md#x) [4](a+b.md) [5](sub) [6](sub/) [7](/docs/b.md) [8](b.md 'title') [9](100%.md) [10](#top) [11](HTTP://x) [12](mailto:x@y) [13](sub/../b.md)",
        "docs/b.md": "[gone](c.md) [gone](c.md) [out](../../x.md) [code](../src/no.py#L1)",
        "docs/my file.md": "",
        "docs/a+b.md": None,
        "docs/100%.md": "",
        "docs/sub/x.txt": "[no](page.md)",
        "tests/fixtures/invalid/l.md": "[gone](c.md)",
    }
    got = found(gate.broken_links(table(spark, files)))
    assert got == [("broken_link", "docs/b.md", t) for t in ("../../x.md", "../src/no.py", "c.md", "c.md")]
    assert unquote("my%20file.md") == "my file.md"


def project():
    return {
        "app/x.py": "x", "src/x.py": "x", "tests/x.py": 'token = "fake-value-0123456789"', "docs/x.md": "[x](../app/x.py)", "data/x.txt": "x",
        "conf/a.json": '﻿{"a": 1}', "tests/fixtures/a/deliberate.json": "{", "tests/fixtures/expected-fail/a.csv": "a,a\n",
        "data/samples/s.csv": "openalex_id,precision\nW1,0.5\nW2,\n", "data/samples/w2/dedup/raw.csv": "openalex_id\nW3\nW3\n",
        "data/manual/w2_labels.csv": 'annotation_id,openalex_id,label,note\nA,W1,高度相关,"two\nlines, one"\n',
        "outputs/r/run_config.json": '{"run_id": "r", "created_at": "t", "mode": "m", "keyword": "k", "max_results": 0, "status": "completed", "success": false}',
    }


def test_a_sound_project_passes_both_levels(spark):
    for level in (gate.BASIC, gate.FULL):
        assert found(gate.gate(table(spark, project()), level)) == []
    with pytest.raises(ValueError):
        gate.gate(table(spark, project()), "half")


def test_each_fault_is_found_at_its_level(spark):
    files = project() | {
        "conf/b.json": "{", ".env": "x", "app/.env.example": "", "src/y.py": 'password: "abcdefghij0123456789"', "src/z.md": "/home/someone/x [q](no.md)",
        "data/manual/relevance_labels_w1.csv": "a,a\n1,2,3\n", "data/manual/w1.csv": "openalex_id,openalex_id \nW1,W1\n", "data/manual/old.csv": "openalex_id,label\nW9,高度相关\nW1,x\n",
        "data/manual/w2_more.csv": "annotation_id,openalex_id,similarity_score\nA,W8,nan\n,W2,2\nA,W2,1\n", "data/annotation_tasks/w4/t.csv": "label\n2\n高度相关\n",
        "data/empty.csv": "", "data/blank.csv": "a,\n1,2\n", "outputs/experiments/e1/r.txt": "", "outputs/s/run_config.json": '{"run_id": null, "status": 1, "success": null, "max_results": []}', "outputs/t/run_config.json": "[]",
    }
    del files["data/x.txt"], files["docs/x.md"]
    basic = [("broken_link", "src/z.md", "no.md", "error"), ("folder_missing", "docs", "", "error"), ("json_invalid", "conf/b.json", "", "error"), ("personal_path", "src/z.md", "", "error"), ("secret", "src/y.py", "", "error"), ("sensitive_name", ".env", "", "error")]
    assert found(gate.gate(table(spark, files))) == basic
    names = ("run_id", "created_at", "mode", "keyword", "max_results", "status")
    full = basic + [
        ("old_structure", "data/manual/relevance_labels_w1.csv", "2", "warning"), ("header_twice", "data/manual/w1.csv", "1", "error"), ("old_reference", "data/manual/old.csv", "1", "warning"), ("label", "data/manual/old.csv", "3:label", "error"),
        ("reference", "data/manual/w2_more.csv", "2:openalex_id", "error"), ("id_blank", "data/manual/w2_more.csv", "3:annotation_id", "error"), ("id_twice", "data/manual/w2_more.csv", "1:annotation_id", "error"), ("id_twice", "data/manual/w2_more.csv", "1:openalex_id", "error"),
        ("score", "data/manual/w2_more.csv", "2:similarity_score", "error"), ("score", "data/manual/w2_more.csv", "3:similarity_score", "error"), ("label", "data/annotation_tasks/w4/t.csv", "3:label", "error"),
        ("csv_empty", "data/empty.csv", "1", "error"), ("header_blank", "data/blank.csv", "1", "error"), ("tracked_experiment", "outputs/experiments/e1/r.txt", "", "warning"),
        *[(f"run_config_{c}_missing", f"outputs/{d}/run_config.json", "", "error") for d in "st" for c in names if (d, c) not in (("s", "status"), ("s", "max_results"))],
        *[("run_config_status_value", f"outputs/{d}/run_config.json", "", "error") for d in "st"], ("run_config_success_type", "outputs/s/run_config.json", "", "error"),
    ]
    got = gate.gate(table(spark, files), gate.FULL)
    assert found(got) == sorted(full)
    told = {r["rule"]: (r["errors"], r["warnings"], r["status"]) for r in gate.summary(got).collect()}
    assert told["label"] == (2, 0, "failed") and told["old_reference"] == (0, 1, "warning")


def test_the_gate_of_a_folder(spark, tmp_path, capsys):
    for name, content in project().items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content, encoding="utf-8", newline="")
    assert cli.main(["files", "--root", str(tmp_path), "--level", "full", "--folders", *gate.FOLDERS]) == 0
    (tmp_path / "docs/x.md").write_text("[x](no.md)")
    assert cli.main(["files", "--root", str(tmp_path)]) == 1
    assert "broken_link docs/x.md no.md" in capsys.readouterr().out


def test_lineage_of_long_chains_and_cycles(spark):
    n = 600
    rows = [(i, i - 1 if i else None) for i in range(n)] + [(1000, 1001), (1001, 1002), (1002, 1000), (1003, 1000), (2000, 9999), (2001, 2000), (3000, 3000), (None, 5), (4000, None), (4000, 4001)]
    got = {r["id"]: (r["root"], r["depth"], r["state"]) for r in lineage.lineage(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert {i: got.pop(i) for i in range(n)} == {i: (0, i, "rooted") for i in range(n)}
    lost = (None, None, "cycle")
    assert got == {1000: lost, 1001: lost, 1002: lost, 1003: lost, 3000: lost, 2000: (2000, 0, "parent_missing"), 2001: (2000, 1, "parent_missing"), 4000: (4000, 0, "parent_missing")}
    assert lineage.lineage(spark.createDataFrame([], "id long, parent long")).collect() == []


def test_audit_faults():
    good = {"description": lineage.AUDIT, "blind_phase_completed_before_human_comparison": True, "reviewer_independence_checked": True, "required_review_count": 6, "completed_review_count": 6, "files": dict.fromkeys(lineage.AUDIT_FILES, {})}
    assert benchmark.audit_faults(good) == [] and benchmark.audit_faults(None) == ["audit_missing"]
    for key, value, fault in (("description", "x", "description"), ("reviewer_independence_checked", 1, "not_blind"), ("required_review_count", True, "reviews"), ("completed_review_count", 5, "reviews"), ("files", {}, "files")):
        assert benchmark.audit_faults(good | {key: value}) == [f"audit_{fault}"]


QUEUE = [("a", "pending", "", "A title"), ("b", "pending", "", "B"), ("c", "confirmed", "merge", "C"), ("d", "pending", "", "D")]


@pytest.fixture
def store(spark, tmp_path):
    return reviews.ReviewStore.create(spark.createDataFrame(QUEUE, "pair_id string, review_status string, action string, title string"), str(tmp_path / "store"))


def state(store, version=None):
    return {r["pair_id"]: r["review_status"] for r in store.table(version).collect()}


def test_a_crash_between_decisions_loses_none(spark, store, monkeypatch):
    answers = iter(["y", "maybe", "n"])

    def ask(pair):
        try:
            return next(answers)
        except StopIteration:
            raise KeyboardInterrupt from None

    with pytest.raises(KeyboardInterrupt):
        reviews.review(store, ask, lambda line: None, "r")
    again = reviews.ReviewStore(spark, str(store.folder))
    want = {"a": "confirmed", "b": "distinct", "c": "confirmed", "d": "pending"}
    assert state(again) == want and state(again, 1) == want | {"b": "pending"} and [p["pair_id"] for p in again.pending()] == ["d"]
    # A crash while an entry is written leaves the version before.
    monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError, match="crash"):
        again.decide("d", "y")
    assert state(again) == want and again.latest() == 2


def test_versions_conflict_and_are_compacted(store):
    seen = store.latest()
    store.decide("a", "y", version=seen)
    with pytest.raises(reviews.ConflictError):
        store.decide("a", "n", version=seen)
    store.decide("a", "n")
    store.decide("c", "n")
    before = state(store)
    assert before == {"a": "confirmed", "b": "pending", "c": "confirmed", "d": "pending"}
    version = store.compact()
    store.decide("a", "n")
    store.decide("b", "N")
    assert state(store, version) == before and state(store) == before | {"b": "distinct"} and state(store, 0)["a"] == "pending"
    assert reviews.review(store, lambda pair: "s", lambda line: None) == 0 and reviews.review(store, lambda pair: "q", lambda line: None) == 0
    with pytest.raises(ValueError):
        store.decide("b", "perhaps")


def test_review_command(spark, tmp_path, capsys, monkeypatch):
    spark.createDataFrame(QUEUE, "pair_id string, review_status string, action string, title string").write.parquet(str(tmp_path / "q"))
    said = iter(["y", "q"])
    monkeypatch.setattr("builtins.input", lambda text: next(said))
    args = ["review", "--store", str(tmp_path / "s")]
    assert cli.main([*args, "--queue", str(tmp_path / "q"), "--reviewer", "r"]) == 0
    assert cli.main(args) == 0
    assert capsys.readouterr().out.splitlines()[-2:] == ["confirmed 2", "pending 2"]
