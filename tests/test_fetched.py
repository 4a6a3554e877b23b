import pytest
from pyspark.sql import functions as F

from paperloom.functions import norm
from paperloom.operators import checks
from paperloom.plans import package, runs


def test_statistics_have_types_and_defaults(spark):
    given = [("a", 3, '{"page_count": "2", "elapsed_seconds": 1, "actual_result_count": 9}'), ("b", 4, None), ("c", 5, '{"status": null, "retry_count": 1}')]
    got = {r["q"]: r.asDict() for r in norm.query_stats(spark.createDataFrame(given, "q string, cleaned_result_count int, stats string")).collect()}
    zero = {"actual_result_count": 4, "page_count": 0, "request_count": 0, "retry_count": 0, "duplicate_records_skipped": 0, "status": "success", "stopped_reason": "", "elapsed_seconds": 0.0}
    assert got["b"] == {"q": "b", "cleaned_result_count": 4} | zero
    assert got["a"] == {"q": "a", "cleaned_result_count": 3} | zero | {"page_count": 2, "elapsed_seconds": 1.0, "actual_result_count": 9}
    assert got["c"] == {"q": "c", "cleaned_result_count": 5} | zero | {"retry_count": 1, "actual_result_count": 5}
    for bad in ('{"page_count": "many"}', "{"):
        with pytest.raises(Exception, match="(?i)cast|parse|malformed"):
            norm.query_stats(spark.createDataFrame([("a", 1, bad)], "q string, cleaned_result_count int, stats string")).collect()


def test_a_fetch_must_give_paper_records(spark, tmp_path):
    row = {c: (1 if c in ("pos", "publication_year", "cited_by_count") else "x") for c in runs.FETCHED}
    good = spark.createDataFrame([tuple(row.values())], ", ".join(f"{c} {kinds[0]}" for c, kinds in runs.FETCHED.items()))
    assert runs.check_fetched(good, "q") is good
    with pytest.raises(ValueError, match="query q: doi missing"):
        runs.check_fetched(good.drop("doi"), "q")
    with pytest.raises(ValueError, match="authors array<string>"):
        runs.check_fetched(good.withColumn("authors", F.array("authors")), "q")
    with pytest.raises(ValueError, match="no table but dict"):
        runs.check_fetched({"papers": []}, "q")
    settings = runs.Settings("k", (("q", "k"),), 2026, output_root=str(tmp_path))
    with pytest.raises(runs.RunError, match="no table but list"):
        runs.run_pipeline(spark, settings, lambda s, q: [])


def test_a_baseline_from_raw_records(spark):
    schema = "pos long, title string, authors string, publication_year string, doi string, abstract string, cited_by_count string, source_name string, openalex_id string, landing_page_url string, keyword string, retrieved_at string"
    rows = [(0, " Deep sea ", "A", "2020", "doi:10/A", "", "5", "", "W1", "", None, None), (1, "x", "", "?", "10/a", "", "", "", "W2", "", None, None), (2, "deep  SEA", "", "", "", "", None, "", "W3", "", None, None), (3, "Deep Sea", "", "", "", "", None, "", "W4", "", None, None)]
    got = runs.prepare_baseline(spark.createDataFrame(rows, schema), "deep sea", 2026, "now").orderBy("pos").collect()
    assert [(r["pos"], r["title"], r["publication_year"], r["keyword"]) for r in got] == [(0, "Deep sea", 2020, "deep sea"), (2, "deep  SEA", None, "deep sea")]
    assert got[0]["preliminary_score"] > got[1]["preliminary_score"] > 0


def test_inputs_are_those_that_a_package_pins(tmp_path):
    (tmp_path / "m.json").write_text('{"inputs": {"candidate_pool": {"path": "pool.csv"}}}')
    package.same_inputs(tmp_path / "m.json", candidate_pool=str(tmp_path / "x" / ".." / "pool.csv"), assignments=None)
    for given in ({"candidate_pool": str(tmp_path / "other.csv")}, {"assignments": str(tmp_path / "pool.csv")}):
        with pytest.raises(checks.ContractError):
            package.same_inputs(tmp_path / "m.json", **given)
