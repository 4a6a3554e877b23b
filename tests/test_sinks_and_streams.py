import csv
import json
import sqlite3
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from paperloom.sources import files, rest, sinks


def test_csv_parts_are_joined_in_order(spark, tmp_path):
    path = str(tmp_path / "o.csv")
    df = spark.range(1000).repartition(7).orderBy("id").select("id", F.concat(F.lit('a,"'), "id").alias("t"), F.array(F.col("id").cast("string")).alias("l"), F.when(F.col("id") % 2 == 0, "ü\nx").alias("n"))
    assert files.write_csv_file(df, path, ["id", "t", "l", "n"]) == 1000
    raw = open(path, "rb").read()
    assert raw.startswith(b"\xef\xbb\xbf") and raw.count(b"\xef\xbb\xbf") == 1
    rows = list(csv.reader(open(path, encoding="utf-8-sig", newline="")))
    assert rows[0] == ["id", "t", "l", "n"]
    assert rows[1:] == [[str(i), f'a,"{i}', f'["{i}"]', "" if i % 2 else "ü\nx"] for i in range(1000)]
    assert files.write_csv_file(df.limit(0), path, ["id"], bom=False) == 0
    assert open(path, "rb").read() == b"id\n" and [p.name for p in tmp_path.iterdir()] == ["o.csv"]


def failing(spark):
    return spark.range(400, numPartitions=4).select(F.when(F.col("id") == 399, F.raise_error(F.lit("no such row")).cast("long")).otherwise(F.col("id")).alias("id"))


def test_an_aborted_write_leaves_the_old_file(spark, tmp_path):
    table, db = tmp_path / "o.csv", tmp_path / "o.db"
    table.write_text("old")
    files.write_sqlite(spark.range(3), str(db))
    for write in (lambda: files.write_csv_file(failing(spark), str(table), ["id"]), lambda: files.write_sqlite(failing(spark), str(db))):
        with pytest.raises(Exception, match="no such row"):
            write()
    assert table.read_text() == "old" and sorted(p.name for p in tmp_path.iterdir()) == ["o.csv", "o.db"]
    assert sqlite3.connect(db).execute("SELECT count(*) FROM papers").fetchone() == (3,)


def test_sqlite_rows_are_replaced_and_other_tables_stay(spark, tmp_path):
    path = str(tmp_path / "o.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE other (x)")
        db.execute("INSERT INTO other VALUES (5)")
    df = spark.range(300).repartition(5).select("id", (F.col("id") / 4).alias("q"), F.concat(F.lit("t"), "id").alias("t"), F.lit(None).cast("string").alias("n"))
    for n in (300, 40):
        assert files.write_sqlite(df.where(F.col("id") < n), path) == n
        db = sqlite3.connect(path)
        assert sorted(db.execute("SELECT * FROM papers")) == [(i, i / 4, f"t{i}", None) for i in range(n)]
        assert db.execute("SELECT * FROM other").fetchall() == [(5,)]
    assert [r[:3] for r in db.execute("PRAGMA table_info(papers)")] == [(0, "id", "INTEGER"), (1, "q", "REAL"), (2, "t", "TEXT"), (3, "n", "TEXT")]


def test_only_accepted_parts_are_joined(tmp_path):
    """A second attempt of a task leaves a part that no message names."""
    from pyspark.sql import types as T

    writer = sinks.CsvWriter({"path": str(tmp_path / "o.csv"), "bom": "false"}, T.StructType([T.StructField("a", T.StringType())]))
    for name in ("1-first", "1-again", "0"):
        writer.write_part(writer.staging / name, [(name,)])
    writer.commit([sinks.Part(1, str(writer.staging / "1-again")), None, sinks.Part(0, str(writer.staging / "0"))])
    assert (tmp_path / "o.csv").read_text() == "a\n0\n1-again\n"


@pytest.fixture
def service():
    """Queries of some pages, with works that come again on a later page, and a switch that makes it fail."""
    state = {"asked": [], "fail_at": None}
    pages = {"deep": [[f"D{3 * p + i}" for i in range(3)] for p in range(4)] + [["D0", "D99"]], "sea": [["S0", "S1"], ["S1", "S2"]], "none": [[]]}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            at = 0 if q["cursor"] == "*" else int(q["cursor"].removeprefix("c"))
            state["asked"].append((q["search"], at, q["select"]))
            if state["fail_at"] == (q["search"], at) and q["select"] != "id":
                self.send_response(400)
                self.end_headers()
                return
            own = pages[q["search"]]
            works = [{"id": w, "publication_year": 2020, "display_name": w.lower()} if q["select"] != "id" else {"id": w} for w in own[at]]
            body = json.dumps({"meta": {"next_cursor": f"c{at + 1}" if at + 1 < len(own) else None}, "results": works}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/works", state, pages
    server.shutdown()


def test_a_restarted_stream_goes_on_and_has_no_row_twice(spark, tmp_path, service):
    url, state, pages = service
    queries = {"q1": "deep", "q2": "sea", "q3": "none"}

    def run():
        q = rest.works_stream(spark, url, queries, max_retries=0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    state["fail_at"] = ("deep", 2)
    with pytest.raises(Exception, match="request_failed"):
        run()
    before = {(r["query_id"], r["at"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert ("q1", 3) in before and ("q1", 6) not in before
    state["fail_at"], state["asked"] = None, []
    run()
    assert ("deep", 0, rest.FIELDS) not in state["asked"] and ("sea", 0, rest.FIELDS) not in state["asked"]
    rows = spark.read.schema("query_id string, at int, publication_year int, work string").parquet(str(tmp_path / "out")).collect()
    got = sorted((r["query_id"], json.loads(r["work"])["id"]) for r in rows)
    assert got == sorted({(q, w) for q, k in queries.items() for p in pages[k] for w in p}) and len(got) == 16
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 16


def test_a_stream_ends_at_its_most_rows(service):
    url, _, _ = service
    reader = rest.WorksStreamReader({"url": url, "queries": '{"q": "deep"}', "max_results": "5"})
    start, rows = reader.initialOffset(), []
    while (end := reader.latestOffset()) != start:
        for part in reader.partitions(start, end):
            rows += list(reader.read(part))
        start = end
    assert start["q"]["cursor"] is None and [r[1] for r in rows] == list(range(len(rows))) and len(rows) >= 5
