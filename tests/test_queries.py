"""Every query with SQL against that SQL, on the smallest tables."""

import hashlib
import math
import random
import shutil
from pathlib import Path

import duckdb
import pytest

from paperloom.plans import registry

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not SF.is_dir():
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())


def test_files_of_all_tables(spark, tmp_path):
    if not SF.is_dir():
        pytest.skip("no test tables")
    for n, to in (("nation", "nation.parquet"), ("region", "region.parquet"), ("labels", "labels.parquet/part-0.parquet"), ("pages", "pages.parquet/part-0.parquet")):
        (tmp_path / to).parent.mkdir(exist_ok=True)
        shutil.copy(SF / f"{n}.parquet", tmp_path / to)
    want = {str(p.relative_to(tmp_path)): p.read_bytes() for p in tmp_path.rglob("*.parquet") if p.is_file()}
    got = registry.queries()["file_sha256"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((f, len(b), hashlib.sha256(b).hexdigest()) for f, b in want.items())


def test_ragged_lines_of_orders(spark, db):
    got = [tuple(r) for r in registry.queries()["csv_ragged"](spark, str(SF)).collect()]
    want = db.execute("SELECT o_orderkey, concat_ws(',', o_orderstatus, o_custkey, 'extra') FROM orders WHERE o_orderkey % 5 = 0").fetchall()
    assert got and sorted(got) == sorted(want)


def test_a_large_file_is_hashed_by_many_tasks(spark, tmp_path, monkeypatch):
    """Files beyond what one row can hold, in splits and rounds, with ends of lines, marks and runs without any."""
    from paperloom.sources import digests

    rng = random.Random(3)
    noise = rng.randbytes(300_000)
    files = {"a": noise, "b": noise + b"\n", "d": b"\n", "e": b"\xef\xbb\xbf" + noise[:1000], "f": b"\xef\xbb\xbf\r\n\n", "g": b"x" * 200_000 + b"\n\r" + noise[:500], "h": b"no end"}
    for n, b in files.items():
        (tmp_path / f"{n}.parquet").write_bytes(b)
    monkeypatch.setattr(digests, "STEP", 1 << 16)
    held = {"spark.sql.sources.binaryFile.maxLength": "100000", "spark.sql.files.maxPartitionBytes": "20000"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = registry.queries()["file_sha256"](spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got)) == [(f"{n}.parquet", len(b), hashlib.sha256(b).hexdigest()) for n, b in sorted(files.items())]
