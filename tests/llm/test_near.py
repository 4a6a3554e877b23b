import random
import re

import numpy as np
import pandas as pd
import pytest

from paperloom.llm import ngram, vectors

from .data import assert_clashes_kept, documents, edited, frame, text, with_clashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(rows):
    out = {}
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[d] = {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} - {""}
    return out


def parts(ids, link):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(ids)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if link(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check(spark, rows):
    sets = sets_of(rows)
    like = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = parts(sets, like)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram.ngram_components(with_clashes(frame(spark, rows))).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_components(spark):
    check(spark, documents())


def test_words_that_share_a_hash_make_other_shingles(spark):
    from .test_tokens import alike_words

    a, b = alike_words()
    words = [f"w{i}" for i in range(30)]
    check(spark, [(i, " ".join([*words[:k], w, *words[k:]]), "", "", 0) for i, (w, k) in enumerate([(a, 15), (b, 15), (a, 28), (b, 28), (a, 2)])] + [(9, a, "", "", 0), (10, b, "", "", 0)])


def test_large_family_and_chains(spark, monkeypatch):
    monkeypatch.setattr(ngram, "GROUP", 8)
    rng = random.Random(8)
    base = text(rng, 120)
    rows = [edited(rng, base, rng.choice([1, 2, 3, 4, 5])) for _ in range(60)]
    step = base
    for _ in range(15):
        step = edited(rng, step, 2)
        rows.append(step)
    rows += [base] * 20 + [f"{base} {text(rng, 25)}" for _ in range(5)]
    rng.shuffle(rows)
    check(spark, [(i, t, "", "", 0) for i, t in enumerate(rows)])


def family(seed=8):
    """Near copies of one text, a chain of edits away from it, exact copies, and unlike texts that share a passage."""
    rng = random.Random(seed)
    base, step = text(rng, 120), None
    rows = [edited(rng, base, rng.choice([1, 2, 3, 4, 5])) for _ in range(40)]
    for _ in range(12):
        step = edited(rng, step or base, 2)
        rows.append(step)
    rows += [base] * 5 + [f"{base[:300]} {text(rng, 60)}" for _ in range(12)]
    rng.shuffle(rows)
    return [(i, t, "", "", 0) for i, t in enumerate(rows)]


def test_the_matrix_alone_finds_all_links(spark, monkeypatch):
    monkeypatch.setattr(ngram, "ROUNDS", 0)
    monkeypatch.setattr(ngram, "GROUP", 8)
    check(spark, family())


def test_without_the_matrix_links_are_lost(spark, monkeypatch):
    monkeypatch.setattr(ngram, "ROUNDS", 1)
    check(spark, family())
    monkeypatch.setattr(ngram, "matrix", lambda rare, members: rare.selectExpr("token", "0L AS block", "0L AS star", "0L AS who").limit(0))
    with pytest.raises(AssertionError):
        check(spark, family())


def test_a_group_is_opened_only_where_its_union_allows(monkeypatch):
    """What a union can't hold is never compared."""
    sets = {"a": range(0, 100), "b": range(50, 150), "c": range(0, 90)}
    rows = [(name, np.array(list(r), "<u8").tobytes(), asks) for name, r, asks in (("a", sets["a"], False), ("b", sets["b"], True), ("c", sets["c"], True))]
    block = pd.DataFrame({"grp": [ord(n) for n, _, _ in rows], "tokens": [t for _, t, _ in rows], "asks": [a for *_, a in rows]})
    assert ngram._open_groups(block).to_numpy().tolist() == [[ord("c"), ord("a")]]
    assert len(ngram._open_groups(block[block["grp"] != ord("c")])) == 0


def test_joined_set_is_exact_on_the_threshold(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(words[:14]), "", "", 0), (1, " ".join(words[:12]), "", "", 0), (2, " ".join(words[:11]), "", "", 0), (3, "a b", "", "", 0), (4, "A  b\n", "", "", 0), (5, "a b c", "", "", 0)]
    check(spark, rows)


def test_no_rows_and_repeated_ids(spark):
    assert ngram.ngram_components(frame(spark, [])).collect() == []
    rows = [(1, "a b c d e f", "", "", 0), (1, "a b c d e f", "", "", 0), (2, "a b c d e f", "", "", 0), (None, "a b c d e f", "", "", 0), (None, None, "", "", 0)]
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram.ngram_components(frame(spark, rows)).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (None, None), (None, None)]
    left = ngram.keep_one_of_each(with_clashes(frame(spark, rows))).collect()
    assert sorted(r["doc_id"] or 0 for r in left) == [0, 0, 1, 1]
    assert_clashes_kept(left)


def test_repeated_ids_with_different_texts(spark):
    """Every text of an id is compared, and its rows are one node."""
    rng = random.Random(9)
    a, b, c, d = (text(rng, 60) for _ in range(4))
    near = edited(rng, b, 1)
    assert a < b or (a := "a " + a) < b
    got = lambda rows: sorted((r["doc_id"], r["component_id"]) for r in ngram.ngram_components(frame(spark, [(i, t, "", "", 0) for i, t in rows])).collect())
    # 6 and 7 are near copies, 6 stands on one row only, and the class of 6 begins with the 5 that is also another text's.
    assert got([(5, a), (5, b), (6, b), (7, near), (8, d)]) == [(5, 5), (5, 5), (6, 5), (7, 5), (8, 8)]
    assert sorted(r["doc_id"] for r in ngram.keep_one_of_each(frame(spark, [(i, t, "", "", 0) for i, t in [(5, a), (5, b), (6, b), (7, near)]])).collect()) == [5, 5]
    # Many texts of many ids, against plain code; with links that meet in an id alone, and a blank row of such an id.
    texts = [text(rng, 40) for _ in range(12)]
    texts += [edited(rng, rng.choice(texts), rng.choice([1, 1, 4])) for _ in range(30)]
    rows = [(rng.randrange(40), t) for t in texts for _ in range(rng.choice([1, 2]))]
    rows += [(109, c), (109, ""), (109, near), (104, c), (102, b), (102, d), (111, d), (112, a), (103, a)]
    sets = list(sets_of(enumerate(t for _, t in rows)).values())
    like = lambda i, j: rows[i][0] == rows[j][0] or bool(sets[i] | sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    of_row = parts(range(len(rows)), like)
    least = {p: min(rows[i][0] for i in of_row if of_row[i] == p) for p in set(of_row.values())}
    assert got(rows) == sorted((rows[i][0], least[of_row[i]]) for i in of_row)


def points(n, d, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_vectors_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(2)
    x = points(600, 32, 1)
    near = [x[i] + s * rng.normal(size=32) / 32**0.5 for i in range(60) for s in (0.1, 0.2, 0.3, 0.33)]
    hot = [x[0] + 0.1 * rng.normal(size=32) / 32**0.5 for _ in range(120)]
    rows = [r.astype(np.float32).tolist() for r in [*x, *near, *hot, *[x[5]] * 7]]
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0, 2.0]]
    table = [(i, v, 1) for i, v in enumerate([*rows, *odd])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, copies int").repartition(4)
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    u = vectors.unit(np.array(rows))
    alike = u @ u.T >= 0.95
    degree = alike.sum(axis=1) - 1
    found = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert (found <= degree).all() and found.sum() >= 0.99 * degree.sum() and len(got) == len(table)
    assert {r["recall"] for r in got.values()} <= {1.0, got[0]["recall"]} and got[0]["recall"] >= vectors.TARGET_RECALL
    # With every cell visited nothing is lost, and the components are those of all pairs.
    monkeypatch.setattr(vectors, "LEAST_HELD", 10**9)
    exact = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    want = parts(range(len(rows)), lambda a, b: alike[a, b])
    assert [(exact[i]["n_links"], exact[i]["component_id"]) for i in range(len(rows))] == [(degree[i], want[i]) for i in range(len(rows))]
    for i in range(len(rows), len(table)):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert vectors.near_vectors(df.limit(0)).collect() == []
    assert [r["n_links"] for r in vectors.near_vectors(df.where("vec_id = 1")).collect()] == [0]


def test_vectors_of_rarer_lengths_link_too(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(3)
    rows = []
    # The most frequent length, one with an index of its own, two that are a cell each, and single numbers.
    for n, d in ((200, 8), (60, 6), (15, 5), (1, 3)):
        x = points(n, d, d)
        rows += [r.tolist() for r in [*x, *(x[: n // 3] + 0.05 * rng.normal(size=(n // 3, d))), *(2 * x[:2])]]
    rows += [[3.0], [-2.0], [3.0], rows[-1], rows[0]]
    order = rng.permutation(len(rows)).tolist()
    rows = [rows[i] for i in order]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    alike = lambda a, b: len(rows[a]) == len(rows[b]) and np.dot(rows[a], rows[b]) >= 0.95 * np.linalg.norm(rows[a]) * np.linalg.norm(rows[b])
    want = parts(range(len(rows)), alike)
    assert got == {i: (sum(alike(i, j) for j in range(len(rows)) if j != i), want[i], want[i] == i) for i in range(len(rows))}


def test_very_large_and_very_small_numbers_link(spark):
    """Squares of finite components may be none."""
    rows = [[1e200, 2e200, 0.0], [1.0, 2.0, 0.0], [1e-200, 2e-200, 0.0], [0.0, 0.0, 5e-324], [0.0, 0.0, 1e308]]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert [(r["n_links"], r["component_id"]) for r in vectors.near_vectors(df).orderBy("vec_id").collect()] == [(2, 0), (2, 0), (2, 0), (1, 3), (1, 3)]


def test_links_near_the_threshold_in_a_fine_grid(spark, monkeypatch):
    """100 codewords a half on a sample of two rows for each: visits fitted on the rows that trained them are too few."""
    monkeypatch.setattr(vectors, "CELL_ROWS", 0.4)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 200)
    x, noise = points(2000, 64, 4), points(2000, 64, 5)
    noise -= (noise * x).sum(axis=1)[:, None] * x
    y = 0.9501 * x + (1 - 0.9501**2) ** 0.5 * noise / np.linalg.norm(noise, axis=1)[:, None]
    rows = np.concatenate([x, y])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>").repartition(4)
    found = sum(r["n_links"] for r in vectors.near_vectors(df).collect())
    u = vectors.unit(rows)
    all_links = (u @ u.T >= 0.95).sum() - len(u)
    print("links", found, "of", all_links)
    assert all_links >= 4000 and 0.99 * all_links <= found <= all_links


def test_visits_reach_the_recall_on_rows_no_codebook_has_seen():
    index = vectors.MultiIndex.fit(points(4096, 64, 6), 512)
    n, recall = index.visits_for(points(2000, 64, 7), 0.95, 0.995)
    x, noise = points(2000, 64, 8), points(2000, 64, 9)
    noise -= (noise * x).sum(axis=1)[:, None] * x
    y = 0.95 * x + (1 - 0.95**2) ** 0.5 * noise / np.linalg.norm(noise, axis=1)[:, None]
    a, b = index.visits(x, n), index.visits(y, n)
    assert n > 64 and 0.995 <= recall <= 1 and ((a == b[:, :1]).any(axis=1) | (b == a[:, :1]).any(axis=1)).mean() >= 0.99


def test_codes_bound_the_cosine():
    rng = np.random.default_rng(11)
    spiky = rng.normal(size=(200, 300)) ** 7
    for x in (points(200, 64, 12), vectors.unit(spiky), vectors.unit(np.eye(40) + 1e-9)):
        codes, step, gap = vectors.coded(x)
        told = (codes.astype(float) @ codes.T.astype(float)) * step[:, None] * step
        assert (np.abs(told - x @ x.T) <= gap[:, None] + gap + gap[:, None] * gap + 1e-12).all()
    assert vectors.coded(points(50, 384, 13))[2].max() < 0.02


def test_traversal_visits_the_nearest_cells():
    x = points(500, 16, 3)
    index = vectors.MultiIndex.fit(x, 6)
    got = index.visits(x[:50], 12)
    for r, cells in zip(x[:50], got, strict=True):
        far = [((index.books[0][i] - r[:8]) ** 2).sum() + ((index.books[1][j] - r[8:]) ** 2).sum() for i in range(6) for j in range(6)]
        assert np.allclose(sorted(far)[:12], [far[c] for c in cells])
