import json

import pytest
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.operators import checks
from paperloom.plans import package, runs
from paperloom.sources import files, rest
from paperloom.streaming import windows


def test_violations(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "1.2"), (" ", "x"), ("c", None), ("d", "NaN")], "id string, v string")
    assert sorted(tuple(r) for r in checks.duplicates(df, "id").collect()) == [("blank_id", "", ""), ("duplicate_id", "a", "2")]
    assert sorted(r["rule"] for r in checks.in_range(df, "v", 0, 1, "id").collect()) == ["not_a_number", "not_a_number", "out_of_range"]
    with pytest.raises(checks.ContractError):
        checks.require(checks.duplicates(df, "id"))
    checks.require(checks.duplicates(df.where("id = 'c'"), "id"))


def test_secrets(spark):
    texts = ["sk-" + "a" * 24, "token = \"" + "b" * 20 + "\"", "token = short", "AKIA" + "A" * 16, "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(checks.has_secret(F.col("t"))).collect()] == [True, True, False, True, False]


def test_rankings_keep_their_contract(spark, tmp_path):
    pool = spark.createDataFrame([("p1", "q"), ("p2", "q")], "pair_id string, research_query_id string")
    rows = lambda *r: spark.createDataFrame([(a, "q", "m", s, k) for a, s, k in r], "pair_id string, research_query_id string, method_id string, score string, rank string")
    rules = lambda df: {r["rule"] for r in package.ranking_violations(df, pool, "m", 2).collect()}
    assert rules(rows(("p1", "0.5", "1"), ("p2", "0.5", "2"))) == set()
    assert "rank_not_by_score" in rules(rows(("p1", "0.1", "1"), ("p2", "0.5", "2")))
    assert {"rank_not_canonical", "score_not_finite"} <= rules(rows(("p1", "inf", "01"), ("p2", "0.5", "2")))
    assert {"pair_missing", "pair_unknown"} <= rules(rows(("p1", "0.9", "1"), ("p3", "0.5", "2")))
    with pytest.raises(checks.ContractError):
        package.ranking_violations(pool.withColumn("label", F.lit(1)), pool, "m", 2)


def test_packages_notice_drift(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    pinned = package.freeze(tmp_path, ["a.csv"])
    assert package.drift(tmp_path, pinned) == []
    (tmp_path / "a.csv").write_text("y")
    assert package.drift(tmp_path, pinned) == ["changed a.csv"]
    (tmp_path / "a.csv").unlink()
    assert package.drift(tmp_path, pinned) == ["missing a.csv"]
    with pytest.raises(checks.ContractError):
        package.inside(tmp_path, "../x")


def paper(i, **more):
    return {"title": f"deep sea study {i}", "authors": [f"Ann Lee{i}", "Bo Wu"], "publication_year": 2020, "doi": f"10.1/{i}", "abstract": "deep water", "cited_by_count": i, "source_name": "s", "openalex_id": f"W{i}", "landing_page_url": "u"} | more


@pytest.fixture
def offline(tmp_path):
    first = [paper(1), paper(2), paper(3, title="deep sea survey of fish and stars"), paper(4, title="xx yy zz ww")]
    second = [paper(1, doi=""), paper(7, doi="https://doi.org/10.1/2", title="other words here now"), paper(8, title="deep sea survey of fish and star", doi=""), paper(9, title="unrelated thing altogether")]
    path = tmp_path / "offline.json"
    path.write_text(json.dumps({"queries": {"q1": {"papers": first}, "q2": {"papers": second}}}))
    return path


def test_pipeline_counts(spark, offline, tmp_path):
    settings = runs.Settings("deep sea", (("q1", "deep"), ("q2", "sea")), 2026, output_root=str(tmp_path / "out"))
    labels = spark.createDataFrame([("W1", "高度相关"), ("W4", "不相关")], "openalex_id string, label string")
    run = runs.run_pipeline(spark, settings, cli._offline(str(offline)), labels)
    c = run.config["counts"]
    assert (c["combined"], c["exact_duplicates"], c["kept"], c["ranked"]) == (8, 2, 6, 6) and c["suspected"] >= 1
    saved = json.loads((run.folder / "run_config.json").read_text())
    assert saved["status"] == "completed" and {m["method"] for m in saved["metrics"]} == {"baseline", "two_stage"}
    merged = spark.read.parquet(str(run.folder / "kept.parquet")).where("openalex_id = 'W1'").first()
    assert merged["source_query_ids"] == ["q1", "q2"]


def test_failed_runs_say_so_without_secrets(spark, tmp_path):
    def broken(spark, q):
        raise OSError("token=abc " + str(tmp_path))

    settings = runs.Settings("deep", (("q1", "deep"),), 2026, output_root=str(tmp_path / "out"))
    with pytest.raises(runs.RunError) as e:
        runs.run_pipeline(spark, settings, broken)
    saved = json.loads((e.value.folder / "run_config.json").read_text())
    assert saved["status"] == "failed" and "abc" not in saved["error"]
    for bad in ({"reference_year": 20}, {"evaluation_k": 0}, {"jaccard_least": 2}, {"queries": (("../x", "k"),)}):
        with pytest.raises(ValueError):
            runs.Settings(**({"ranking_keyword": "k", "queries": (("q", "k"),), "reference_year": 2026} | bad)).check()


def test_batches_halt_or_go_on(spark, offline, tmp_path):
    items = [{"item_id": "a", "ranking_keyword": "", "queries": [["q1", "d"]]}, {"item_id": "b", "ranking_keyword": "d", "queries": [["q1", "d"]], "enabled": False}, {"item_id": "c", "ranking_keyword": "d", "queries": [["q1", "d"]]}]
    go = lambda on: [r["status"] for r in runs.run_batch(spark, {"items": items, "continue_on_error": on}, cli._offline(str(offline)), 2026, str(tmp_path / f"b{on}"))]
    (tmp_path / "bFalse").mkdir()
    (tmp_path / "bTrue").mkdir()
    assert go(False) == ["failed", "not_run_after_failure", "not_run_after_failure"]
    assert go(True) == ["failed", "skipped", "success"]
    with pytest.raises(ValueError):
        runs.run_batch(spark, {"items": [{"item_id": "a"}, {"item_id": "a"}]}, None, 2026, str(tmp_path))


def pages(*answers):
    left = list(answers)
    return lambda url, timeout: left.pop(0)


def body(ids, cursor):
    return 200, {}, json.dumps({"meta": {"next_cursor": cursor}, "results": [{"id": i} for i in ids]}).encode()


def test_paging_and_stop_reasons():
    go = lambda get, n=20, **k: rest.fetch("u", "kw", n, get=get, sleep=lambda s: None, **k)
    r = go(pages(body("ab", "c2"), body("bc", None)))
    assert [w["id"] for w in r.works] == ["a", "b", "c"] and r.stop_reason == "cursor_exhausted" and r.duplicates == 1
    assert go(pages(body("abc", "c2")), 2).stop_reason == "max_results_reached"
    assert go(pages(body("a", "*"))).stop_reason == "cursor_stalled"
    assert go(pages(body("", "x"))).stop_reason == "results_exhausted"
    assert go(pages((404, {}, b""))).stop_reason == "request_failed"
    r = go(pages((503, {"Retry-After": "7"}, b""), (200, {}, b"no json"), body("a", None)))
    assert r.retries == 2 and r.stop_reason == "cursor_exhausted"
    assert go(pages(*[(500, {}, b"")] * 4)).requests == 4
    assert go(None, True).stop_reason == "invalid_parameters"
    assert go(None, need_key=True).stop_reason == "missing_api_key"
    assert rest.backoff(3, 1, 30, None) == 8 and rest.backoff(9, 1, 30, None) == 30 and rest.backoff(0, 1, 30, "5") == 5
    assert rest.year_filter(2000, 2001) == "from_publication_date:2000-01-01,to_publication_date:2001-12-31"


def test_works_are_projected(spark):
    work = {"id": "W1", "doi": "https://doi.org/10.1/A", "display_name": "T", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"deep": [0], "sea": [1]}, "authorships": [{"author": {"display_name": "Ann Lee"}}, {"author": {"display_name": None}}], "primary_location": {"landing_page_url": "u", "source": {"display_name": "S"}}}
    df = spark.createDataFrame([(0, json.dumps(work))], "pos long, j string").select("pos", F.from_json("j", files.WORK).alias("w")).select("pos", "w.*")
    row = files.clean(files.project_works(df, "kw"), "kw", "now").first()
    assert (row["title"], row["authors"], row["doi"], row["abstract"], row["source_name"], row["keyword"], row["retrieved_at"]) == ("T", "Ann Lee", "10.1/a", "deep sea", "S", "kw", "now")


def test_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('﻿id,q\n1,"[""a"",""b""]"\n2,[]\n', encoding="utf-8")
    df = files.read_strict_csv(spark, str(path), ["id"])
    assert [tuple(r) for r in files.decode_arrays(df, ["q"]).collect()] == [("1", ["a", "b"]), ("2", [])]
    path.write_text("id,q\n1,2,3\n")
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, str(path))
    path.write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        files.read_strict_csv(spark, str(path))
    out = spark.createDataFrame([(1, ["x"], None)], "a int, b array<string>, c string")
    assert files.write_csv_file(out, str(tmp_path / "o.csv"), ["a", "b", "c"]) == 1
    assert (tmp_path / "o.csv").read_text(encoding="utf-8-sig") == 'a,b,c\n1,"[""x""]",\n'
    for _ in range(2):
        assert files.write_sqlite(out.select("a", "c"), str(tmp_path / "o.db")) == 1


def test_command_line(spark, offline, tmp_path, capsys):
    (tmp_path / "q.json").write_text(json.dumps({"q1": "deep", "q2": "sea"}))
    assert cli.main(["run", "--queries", str(tmp_path / "q.json"), "--ranking-keyword", "deep sea", "--offline", str(offline), "--reference-year", "2026", "--output-root", str(tmp_path / "o")]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["kept"] == 6
    (tmp_path / "g.csv").write_text("id,label\n1,a\n1,z\n")
    assert cli.main(["gate", "--csv", str(tmp_path / "g.csv"), "--id", "id", "--label", "label", "--allowed", "a"]) == 1
    assert set(capsys.readouterr().out.split()) >= {"duplicate_id", "value_not_allowed"}


def test_streams(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:59:00", "a"), ("2024-01-01 01:01:00", "b")], "ts string, event_type string").select(F.to_timestamp("ts").alias("ts"), "event_type").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "e"))
    q = windows.counted(stream).writeStream.outputMode("complete").format("memory").queryName("counted").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["event_type"], r["n"]) for r in spark.sql("SELECT * FROM counted").collect()) == [("a", 2), ("b", 1)]


def test_rest_source_reads_each_query_to_its_end(spark):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread
    from urllib.parse import parse_qs, urlsplit

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            first = q["cursor"] == "*"
            ids = ["W1", "W2"] if first else ["W2", "W3"]
            works = [{"id": f"{q['search']}-{i}", "publication_year": 2020, "display_name": q.get("filter", "")} for i in ids]
            data = json.dumps({"meta": {"next_cursor": "c" if first else None}, "results": works}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    Thread(target=server.serve_forever, daemon=True).start()
    try:
        rest.register(spark)
        df = spark.read.format("scholarly_works").option("url", f"http://127.0.0.1:{server.server_port}/").option("queries", json.dumps({"a": "deep", "b": "sea"})).load().where("publication_year >= 2000")
        rows = [(r["query_id"], json.loads(r["work"])) for r in df.collect()]
    finally:
        server.shutdown()
    assert sorted(w["id"] for _, w in rows) == ["deep-W1", "deep-W2", "deep-W3", "sea-W1", "sea-W2", "sea-W3"]
    assert {w["display_name"] for _, w in rows} == {"from_publication_date:2000-01-01"}
