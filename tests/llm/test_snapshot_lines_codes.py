import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import codes, lines, registry, snapshot
from paperloom.llm.registry import later_snapshot

from .data import WORDS, documents, frame, text, with_clashes

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture
def shards(spark):
    """Small tables in many shards."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def nulls_first(*values):
    return tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in values)


def digest(t):
    return b"" if t is None else hashlib.sha256(t.encode()).digest()[: snapshot.DIGEST_BYTES]


def plain_diff(earlier, later):
    """The contract, row by row. Rows are (key, text, lang, source)."""
    by_key, out = defaultdict(lambda: ([], [])), []
    for side, rows in enumerate((earlier, later)):
        for r in rows:
            by_key[r[0]][side].append(r)
    by_text = defaultdict(lambda: ([], []))

    def differing(a, b):
        return ",".join(c for i, c in enumerate(("text", "lang", "source"), 1) if a[i] != b[i])

    for sides in by_key.values():
        for s in sides:
            s.sort(key=lambda r: (digest(r[1]), nulls_first(*r[2:])))
        n = min(map(len, sides))
        for a, b in zip(*sides):
            out.append((b[0], a[0], "update" if differing(a, b) else "same", differing(a, b), b[1]))
        for side, rows in enumerate(sides):
            for r in rows[n:]:
                by_text[r[1]][side].append(r)
    for sides in by_text.values():
        for s in sides:
            s.sort(key=lambda r: nulls_first(r[0], *r[2:]))
        n = min(map(len, sides))
        out += [(b[0], a[0], "rekey", differing(a, b), b[1]) for a, b in zip(*sides)]
        out += [(a[0], a[0], "delete", "", None) for a in sides[0][n:]] + [(b[0], None, "insert", "", b[1]) for b in sides[1][n:]]
    return Counter(out)


def found_diff(spark, earlier, later):
    a, b = (with_clashes(spark.createDataFrame(r, SCHEMA).repartition(4)) for r in (earlier, later))
    got = snapshot.snapshot_diff(a, b, carry={"said": F.col("text")})
    return Counter((r["key"], r["old_key"], r["op"], r["changed"], r["said"]) for r in got.collect())


def test_snapshots_of_the_contract(spark):
    docs = frame(spark)
    later = [tuple(r) for r in later_snapshot(docs).collect()]
    earlier = [r[:4] for r in documents()]
    got = found_diff(spark, earlier, later)
    assert got == plain_diff(earlier, later)
    assert {op for _, _, op, _, _ in got} == {"same", "update", "rekey", "insert", "delete"}


def test_giant_groups_of_copies_span_shards(spark, shards, monkeypatch):
    monkeypatch.setattr(snapshot, "FANOUT", 2)
    rng = random.Random(4)
    earlier = [(i, "giant" if i % 3 else f"small {i // 9}", "en", rng.choice(["a", "b", None])) for i in range(1500)]
    later = [(i if i % 5 == 0 else -1 - i, t, l, s) for i, t, l, s in earlier if i % 7] + [(10_000 + i, "giant", "en", None) for i in range(100)]
    got = found_diff(spark, earlier, later)
    assert got == plain_diff(earlier, later)
    assert sum(n for k, n in got.items() if k[2] == "rekey") > 800


def test_a_giant_tree_has_counted_nodes(spark, shards, monkeypatch):
    monkeypatch.setattr(snapshot, "FANOUT", 3)
    seen = {}
    real = snapshot._leaves
    monkeypatch.setattr(snapshot, "_leaves", lambda df: seen.setdefault("leaves", real(df)))
    rows = spark.range(2000).select((F.col("id") % 2 == 0).alias("later"), F.lit("g").alias("text"), F.col("id"))
    met = snapshot.match_in_order(rows, "text", ["id"]).select("e.id", F.col("l.id").alias("j")).collect()
    assert sorted((r["id"], r["j"]) for r in met) == [(2 * i + 1, 2 * i) for i in range(1000)]
    for later in (False, True):
        leaves = sorted((r for r in seen["leaves"].collect() if r["later"] == later), key=lambda r: r["shard"])
        assert len(leaves) >= 4 and [r["before"] for r in leaves] == [sum(x["n"] for x in leaves[:i]) for i in range(len(leaves))]


def test_repeated_and_null_keys(spark, shards):
    rng = random.Random(5)
    keys, texts = [None, 1, 2, 3, *[4] * 6], [None, "", "a", "b", "A"]
    make = lambda n: [(rng.choice(keys), rng.choice(texts), rng.choice(["x", None]), rng.choice(["y", "ß", None])) for _ in range(n)]
    earlier, later = make(120), make(150)
    later += [(-9, "b", None, None)] * 40 + [(7, None, "x", "y"), (8, None, "x", "y")]
    earlier += [(9, "b", None, None)] * 60 + [(5, None, "x", "y"), (6, "none such", "x", "y")]
    assert found_diff(spark, earlier, later) == plain_diff(earlier, later)


@pytest.mark.parametrize("sides", [([], []), ([(1, "a", "b", "c"), (None, None, None, None)], []), ([], [(1, "a", "b", "c"), (None, None, None, None)])])
def test_empty_snapshots(spark, sides):
    assert found_diff(spark, *sides) == plain_diff(*sides)


def plain_lines(rows, least_docs=5, least_chars=40):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").encode().lower()
    long = lambda line: len(line.strip(" \t\n\x0b\x0c\r")) >= least_chars
    docs, holder = Counter(), {}
    for d, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n") if long(x)}:
            docs[k] += 1
            holder[k] = max([holder.get(k), d], key=lambda v: (v is not None, v or 0))
    out = []
    for d, t, *_ in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (long(x) and docs[key(x)] >= least_docs and holder[key(x)] != d)]
        out.append((d, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_documents():
    rng = random.Random(6)
    common = ["The Same Line That Many Documents Have, number %d of all" % i for i in range(12)]
    short = ["x" * 39, "é" * 39, "É" * 40, "  " + "y" * 40 + "\x0b", " " + "z" * 39]
    rows = []
    for i in range(160):
        ls = [text(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(6))]
        ls += [(" " * rng.randrange(3)) + (c.upper() if rng.random() < 0.3 else c) + rng.choice(["", "\r", "\t"]) for c in rng.choices(common, k=rng.randrange(4))]
        ls += rng.choices(short, k=2)
        rng.shuffle(ls)
        rows.append((i, "\n".join(ls), "", "", 0))
    rows += [(None, common[0], "", "", 0)] * 2 + [(500, f"{common[1]}\n{common[1]}", "", "", 0)] * 3 + [(501, common[1], "", "", 0), (502, None, "", "", 0), (503, "", "", "", 0), (504, "\n\n", "", "", 0)]
    rows += [(None, "only rows without an id have this line, five of them", "", "", 0)] * 5
    return rows + [(600 + i, "\n".join([f"{common[2]}"] * 3000 + [f"{WORDS[i]} in a line that is met once in all the documents {i}"]), "", "", 0) for i in range(4)]


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, monkeypatch, batches, fanout):
    monkeypatch.setattr(lines, "FANOUT", fanout)
    rows = line_documents()
    got = lines.dedup_lines(with_clashes(frame(spark, rows)), batches=batches).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=str) == plain_lines(rows)


def test_lines_that_are_not_sent(spark, monkeypatch):
    for name in ("KEYS_SENT", "ROWS_SENT"):
        monkeypatch.setattr(lines, name, 0)
    rows = line_documents()
    got = lines.dedup_lines(frame(spark, rows), least_docs=3, least_chars=10).collect()
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got), key=str) == plain_lines(rows, 3, 10)
    assert lines.dedup_lines(frame(spark, [])).collect() == []


def test_settled_keys_add_nothing_and_levels_are_compacted(spark):
    runs = lines.LineRuns(spark, settled=3, fanout=2)
    batch = lambda pairs: spark.createDataFrame([(bytes([k]), h) for k, h in pairs], "key binary, holder long")
    runs.add(batch([(1, 9), (1, 8), (1, 7), (2, 9)]))
    assert [len(level) for level in runs.levels] == [1]
    runs.add(batch([(1, 6), (2, 5), (3, 5)]))
    assert [len(level) for level in runs.levels] == [0, 1]
    held = {bytes(r["key"])[0]: (r["n"], r["holder"]) for r in runs.levels[1][0].collect()}
    assert held == {1: (3, 9), 2: (2, 9), 3: (1, 5)}
    runs.add(batch([(2, 1), (4, 1)]))
    assert {bytes(r["key"])[0] for r in runs.levels[0][0].collect()} == {2, 4}
    plan = runs.spark._jvm.PythonSQLUtils.explainString(runs.levels[1][0].join(runs.levels[0][0].hint("merge"), "key", "left_anti")._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    assert {bytes(r["key"])[0]: r["holder"] for r in runs.frequent(3).collect()} == {1: 9, 2: 9}
    with pytest.raises(ValueError):
        runs.frequent(4)


def plain_codes(rows, parts, words, rounds, scale=1024):
    kept = [(i, l, [math.floor(scale * x) for x in v]) for i, v, l in rows if v and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v)]
    d = 8 // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:words]
    books = [[cut(v, p) for _, _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(x, c), i) for i, c in enumerate(books[p]))
    for _ in range(rounds):
        members = [defaultdict(list) for _ in range(parts)]
        for _, _, v in kept:
            for p in range(parts):
                members[p][near(cut(v, p), p)[1]].append(cut(v, p))
        books = [[[sum(xs) // len(m) for xs in zip(*m, strict=True)] if (m := members[p][i]) else c for i, c in enumerate(books[p])] for p in range(parts)]
    out = []
    for i, l, v in kept:
        found = [near(cut(v, p), p) for p in range(parts)]
        out.append((i, l, "".join(f"{c:02x}" for _, c in found), sum(e for e, _ in found)))
    return sorted(out, key=str), ",".join(str(x) for b in books for c in b for x in c)


def vector_rows(n=180):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(size=8).round(2)], int(i % 3) if i % 5 else None) for i in range(n)]
    rows += [(i, rows[3][1], 1) for i in range(200, 260)]
    bad = [None, [], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [None] + [1.0] * 7, [1.0] * 7, [1.0] * 4, [1.0] * 12]
    rows += [(300 + i, v, 2) for i, v in enumerate(bad)]
    return rows + [(400, [0.0] * 8, None), (401, [-0.0] * 8, 5), (None, rows[5][1], 5), (7, rows[9][1], 5), (7, rows[7][1], 5)]


@pytest.mark.parametrize("parts, words, rounds", [(4, 256, 4), (4, 6, 4), (2, 16, 5), (4, 5, 0)])
def test_codes(spark, parts, words, rounds):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).withColumns({c: F.lit(c) for c in ("id", "x", "codes", "kind", "entry", "n", "e", "error")})
    got = codes.compress(df, parts, words, rounds)
    want, books = plain_codes(rows, parts, words, rounds)
    assert sorted((tuple(r) for r in got.rows.collect()), key=str) == want
    assert codes.books_text(got.books) == books
    assert len(got.changed) == rounds and (not rounds or got.changed[0] == parts * len(want) and all(a > b for a, b in zip(got.changed, got.changed[1:])) or words == 256)


def test_codes_of_few_and_extreme_vectors(spark):
    schema = "vec_id long, embedding array<double>, label int"
    none = codes.compress(spark.createDataFrame([(1, None, 1)], schema))
    assert none.rows.collect() == [] and codes.books_text(none.books) == ""
    rows = [(1, [1e300, -1e300, 5.0, 0.0] * 2, 0), (2, [1e5, -1e5, 3.0, 1.0] * 2, 0), (3, [0.5] * 8, 0)]
    got = codes.compress(spark.createDataFrame(rows, schema), words=2)
    held = [(i, [max(-(2**27), min(2**27, 1024 * x)) / 1024 for x in v], l) for i, v, l in rows]
    want, books = plain_codes(held, 4, 2, 4)
    assert sorted((tuple(r) for r in got.rows.collect()), key=str) == want and codes.books_text(got.books) == books
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame(rows, schema), words=300)


def test_doubles_and_integers_assign_alike():
    rng = np.random.default_rng(1)
    x, books = rng.integers(-900, 900, (500, 2, 3)), rng.integers(-900, 900, (2, 40, 3))
    books[:, 7] = books[:, 3]
    small = codes.assign(x, books)
    large = codes.assign(x * 90_000, books * 90_000)
    assert (small[0] == large[0]).all() and (small[1] * 90_000**2 == large[1]).all() and not (small[0] == 7).any()


def test_only_parts_that_moved_contribute():
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 50, (40, 2, 3))
    old, new = rng.integers(0, 5, (40, 2)).astype(np.uint8), rng.integers(0, 5, (40, 2)).astype(np.uint8)
    a, b, moved = (codes.Contributions(2, 5, 3) for _ in range(3))
    a.move(x, None, old)
    b.move(x, None, new)
    moved.move(x, old, new)
    assert (a.sums + moved.sums == b.sums).all() and (a.counts + moved.counts == b.counts).all() and moved.changed == (old != new).sum()
    still = codes.Contributions(2, 5, 3)
    still.move(x, old, old)
    assert not still.counts.any() and not still.sums.any() and not still.changed


@pytest.mark.parametrize("name", ["op11_snapshot_diff", "op12_line_dedup", "op13_vector_codes"])
def test_queries_equal_their_sql(spark, name):
    sf = Path("/root/testdata/sf0.001")
    if not sf.is_dir():
        pytest.skip("no test tables")
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = registry.queries()[name](spark, str(sf))
    found = db.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, found.fetchall()))
