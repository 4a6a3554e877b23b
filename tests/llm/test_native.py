import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.llm import exact, mixing, sharding

from .data import assert_clashes_kept, documents, frame, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def check_groups(rows, got):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(LOWER)].append(d)
    want = sorted((d, max(ids), len(ids), d == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_groups(spark):
    rows = documents()
    check_groups(rows, exact.exact_groups(with_clashes(frame(spark)), capacity=4).collect())
    assert exact.exact_groups(frame(spark, [])).collect() == []


@pytest.mark.parametrize("hash_of", [lambda c: F.lit(5).cast("long"), lambda c: F.pmod(F.length(c), F.lit(3)).cast("long"), lambda c: F.shiftleft(F.length(c).cast("long"), 50)])
def test_collisions_are_told_apart_by_their_bytes(spark, hash_of):
    check_groups(documents(), exact.exact_groups(frame(spark), hash_of=hash_of).collect())


@pytest.mark.parametrize("share", [0.0001, 1000.0])
def test_hot_and_owned_hashes_decide_alike(spark, monkeypatch, share):
    """All hashes that repeat are hot, or none is."""
    monkeypatch.setattr(exact, "HOT_SHARE", share)
    check_groups(documents(), exact.exact_groups(frame(spark)).collect())


def test_buckets_split_beyond_the_directory(spark, monkeypatch):
    monkeypatch.setattr(exact, "MAX_DEPTH", 2)
    rows = [(i, f"text {i % 300}", "", "", 0) for i in range(400)]
    got = exact.exact_groups(frame(spark, rows), capacity=3).collect()
    check_groups(rows, got)
    held = defaultdict(set)
    for r in got:
        held[r["bucket"]].add(r["text_sha256"])
    assert len(held) > 64 and max(map(len, held.values())) < 16
    global_depth, slots, buckets = exact.number_buckets({0: 40, 1: 2, 2: 0, 3: 9}, 2, 8)
    assert global_depth == 2 and slots == [(0, 0, 3), (1, 8, 0), (2, 9, 0), (3, 10, 1)] and buckets == 12


def test_the_index_decides(spark, monkeypatch):
    """Without its directory no row finds its bucket, and so its group."""
    real = exact.number_buckets
    monkeypatch.setattr(exact, "number_buckets", lambda *a: (real(*a)[0], [(-1, 0, 0)], 1))
    assert exact.exact_groups(frame(spark)).collect() == []


def test_directory_doubles_where_it_must():
    counts = {0: 5, 1: 1, 2: 1, 3: 1, 12: 2, 15: 9}
    depth, directory = exact.grow_directory(counts, 4, 4)
    assert depth == 4 and len(directory) == 16
    held = defaultdict(int)
    for s in range(16):
        held[directory[s]] += counts.get(s, 0)
    assert all(n <= 4 or local == 4 for (_, local), n in held.items())
    assert [b for b, _ in directory] == sorted(b for b, _ in directory)
    assert exact.grow_directory({}, 4, 4) == (0, [(0, 0)])


def test_drop_copies_keeps_one_row_of_each(spark):
    rows = [(1, "A", "", "", 0), (2, "a", "", "", 0), (2, "a", "", "", 0), (2, "A", "", "", 0), (3, "b", "", "", 0), (3, "b", "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0), (6, "solo", "", "", 0)]
    got = sorted((r["doc_id"], r["text"]) for r in exact.drop_copies(frame(spark, rows)).collect())
    assert [d for d, _ in got] == [2, 3, 5, 6] and got[0][1] in ("a", "A")
    rows += [(None, "solo again", "", "", 0), (None, "b", "", "", 0), (None, "twice", "", "", 0), (None, "Twice", "", "", 0)]
    left = exact.drop_copies(with_clashes(frame(spark, rows))).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left if r["doc_id"] != 2) == [(0, "solo again"), (0, "twice"), (3, "b"), (5, ""), (6, "solo")] or len(left) == 6
    assert_clashes_kept(left)


def test_shards(spark):
    rows = documents() * 3
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = with_clashes(frame(spark, rows))
    got = sharding.shard_by_bytes(df, 5).collect()
    again = {r["doc_id"]: r["shard"] for r in sharding.shard_by_bytes(df.repartition(2), 5).collect()}
    texts = {d: (t or "").encode() for d, t, *_ in rows}
    slots, held = defaultdict(list), defaultdict(int)
    for r in got:
        t = texts[r["doc_id"]]
        assert r["size"] == len(t) + 16 and r["text_crc32"] == zlib.crc32(t) and again[r["doc_id"]] == r["shard"]
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert sorted(texts) == sorted(r["doc_id"] for r in got) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, largest = sum(held.values()) / 5, max(len(t) + 16 for t in texts.values())
    assert all(abs(b - share) <= share / 32 + largest for b in held.values())


def test_one_text_fills_many_shards(spark):
    rows = [(i, "same text", "", "", 0) for i in range(3000)] + [(None, None, None, None, None)] * 2
    got = sharding.shard_by_bytes(frame(spark, rows), 7).collect()
    held = defaultdict(int)
    for r in got:
        held[r["shard"]] += 1
    assert len(got) == 3002 and set(held) == set(range(7)) and max(held.values()) - min(held.values()) < 30
    assert sharding.shard_by_bytes(frame(spark, []), 7).collect() == []


def fill(sizes, weights, epochs):
    """Targets by handing on the excess again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    left = total
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= epochs * sizes[s]}
        if not over:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: float(epochs * sizes[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix(spark):
    rows = documents()
    rows = [(i, *r[1:]) for i, r in enumerate([*rows, *[(0, "tiny tiny", "en", "a small source", 9)]])]
    df = with_clashes(frame(spark, rows))
    got = mixing.mix(df).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows}
    by = defaultdict(int)
    for d, _, _, s, _ in rows:
        by[s] += size[d]
    target, taken, most = fill(by, (5, 2, 1), 3), defaultdict(int), defaultdict(int)
    for r in got:
        s = r["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and abs(r["target"] - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * r["copies"]
        taken[s] += r["taken"]
        most[s] = max(most[s], r["size"])
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in by)
    again = {r["doc_id"]: r["copies"] for r in mixing.mix(df.repartition(2)).collect()}
    assert again == {r["doc_id"]: r["copies"] for r in got}
    held = defaultdict(int)
    mixed = mixing.repeat_docs(df).collect()
    assert_clashes_kept(mixed)
    for r in mixed:
        held[r["doc_id"]] += 1
    assert {d: c for d, c in again.items() if c} == dict(held)
    assert mixing.mix(frame(spark, [])).collect() == []


def test_rows_of_one_id_or_none_are_spread_over_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BINS", 1)
    monkeypatch.setattr(mixing, "BIN_ROWS", 8)
    rows = [(None if i % 2 else 7, f"{'word ' * (i % 9)}t{i}", "en", "hot" if i % 10 else "small", 0) for i in range(1200)]
    df = frame(spark, rows)
    bins, _, planned, edge = mixing._planned(df, (5, 2, 1), 23, 3, "doc_id", "text", "source")
    most = planned.groupBy("skey", "bin").count().agg(F.max("count")).first()[0]
    assert bins == 256 and most < 30 and edge.count() < 60
    got = mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert len(got) == 2 and all(abs(r["taken"] - r["target"]) <= 5 for r in got)
    monkeypatch.undo()
    told = lambda: sorted((r["source"], r["size"], r["copies"]) for r in mixing.mix(df).collect())
    few = told()
    monkeypatch.setattr(mixing, "BINS", 300)
    assert told() == few


def test_mix_of_null_and_repeated_ids(spark):
    """Rows without an id, and rows that repeat one, stand in the mix as often as ``mix`` says."""
    rows = [(None if i % 3 else i % 40, f"{'word ' * (i % 17)}{i % 90}", "en", ["a", "b", "c", None][i % 7 % 4], 0) for i in range(900)]
    df = frame(spark, rows)
    got, want = mixing.mix(df).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("n")).where("n > 0").collect(), defaultdict(int)
    for r in mixing.repeat_docs(df).collect():
        want[(r["doc_id"], r["source"], len(r["text"].split()))] += 1
    assert {(r["doc_id"], r["source"], r["size"]): r["n"] for r in got} == dict(want)
