import random
from collections import Counter
from difflib import SequenceMatcher
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paperloom.functions import alike, norm
from paperloom.operators import components, dedup
from paperloom.plans import registry, views

SCHEMA = "pos long, openalex_id string, doi string, title string, authors string, publication_year int"


def replay(rows, merge):
    """One after the other, as the rule reads."""
    seen, out, conflict = {}, {}, False
    for pos, oid, doi, title, *_ in rows:
        keys = [("i", oid)] * bool(oid) + [("d", doi)] * bool(doi)
        if not oid and not doi and title:
            keys = [("t", title)]
        hits = [seen[k] for k in keys if k in seen]
        conflict |= len(set(hits)) > 1
        out[pos] = hits[0] if hits else pos
        if merge or not hits:
            for k in keys:
                seen.setdefault(k, out[pos])
    return out, conflict


def batches(n, size, seed):
    rng = random.Random(seed)
    for b in range(n):
        yield [(b * 100 + i, rng.choice(["", "w1", "w2", "w3"]), rng.choice(["", "10.1/a", "10.1/b"]), rng.choice(["", "t one", "t two"]), "", None) for i in range(size)]


def apart(rows, b):
    return [(p, o and f"{o}-{b}", d and f"{d}-{b}", t and f"{t} {b}", a, y) for p, o, d, t, a, y in rows]


def test_exact_modes_match_a_replay(spark):
    groups = [apart(rows, b) for b, rows in enumerate(batches(60, 6, 1))]
    df = spark.createDataFrame([r for g in groups for r in g], SCHEMA)
    merged = {r["pos"]: r for r in dedup.exact_merge(df).collect()}
    default = {r["pos"]: r["kept_pos"] for r in dedup.exact_default(df).collect()}
    conflicts = 0
    for g in groups:
        want, conflict = replay(g, True)
        assert any(merged[r[0]]["conflict"] for r in g) == conflict
        conflicts += conflict
        if not conflict:
            assert {r[0]: merged[r[0]]["kept_pos"] for r in g} == want
        assert {r[0]: default[r[0]] for r in g} == replay(g, False)[0]
    assert 0 < conflicts < 60


@pytest.mark.parametrize("replayed", [0, 3, 100])
def test_components_beyond_a_pass_are_decided_in_rounds(spark, replayed):
    groups = [apart(rows, b) for b, rows in enumerate(batches(12, 7, 2))]
    df = spark.createDataFrame([r for g in groups for r in g], SCHEMA).repartition(5)
    got = {r["pos"]: (r["kept_pos"], r["reason"]) for r in dedup.exact_default(df, replayed).collect()}
    for g in groups:
        want = replay(g, False)[0]
        assert {r[0]: got[r[0]][0] for r in g} == want
        assert all((got[p][1] is None) == (want[p] == p) for p in want)


def chain(n):
    """Each record shares an identifier with the one before: by id and by DOI in turn."""
    return [(i, f"w{(i + 1) // 2}", f"10.1/{i // 2}", "", "", None) for i in range(n)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    real = components.cut
    monkeypatch.setattr(components, "cut", lambda df, label: written.append(label) or real(df, label))
    n = 10_000
    df = spark.createDataFrame(chain(n), SCHEMA)
    merged = dedup.exact_merge(df)
    assert merged.where("kept_pos <> 0").count() == 0 and merged.count() == n
    assert written.count("parents") < 20
    rounds = []
    monkeypatch.setattr(dedup, "_in_rounds", lambda links: rounds.append(1))
    got = {r["pos"]: r["kept_pos"] for r in dedup.exact_default(df).collect()}
    assert got == replay(chain(n), False)[0] and not rounds


def test_components_of_random_edges_and_a_hub(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000, 1001 + i) for i in range(500)] + [(7, 7), (400, 401), (401, 400), (400, 401)]
    root = {v: v for e in edges for v in e if e[0] != e[1]}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {v: find(v) for v in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_baseline_compares_titles_only_without_doi(spark):
    rows = [(1, "", "doi:10/a", "T", "", 1), (2, "", "10/A", "U", "", 1), (3, "", "", "T", "", 1), (4, "", "", " t ", "", 1), (5, "", "", "", "", 1), (6, "", "", "", "", 1)]
    got = {r["pos"]: (r["kept_pos"], r["duplicate_reason"]) for r in dedup.baseline(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (1, None), 2: (1, "same_doi"), 3: (3, None), 4: (3, "same_title_no_doi"), 5: (5, None), 6: (6, None)}


def brute(rows, jac_least, seq_least):
    out = set()
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            ta, tb = a[3], b[3]
            if (a[1] and a[1] == b[1]) or not ta or not tb or (a[2] and b[2] and a[2] != b[2]):
                continue
            if a[5] is not None and b[5] is not None and abs(a[5] - b[5]) > 2:
                continue
            share = lambda x, y: len(x & y) / len(x | y) if x | y else 0
            toks = [{w for w in t.split() if len(w) > 1} for t in (ta, tb)]
            names = [{n.split()[-1].lower() for n in r[4].split(";") if n.strip() and len(n.split()[-1]) > 1} for r in (a, b)]
            jac, auth = share(*toks), share(*names)
            if (auth >= 0.3 or jac >= 0.8) and (jac >= jac_least or SequenceMatcher(None, ta, tb).ratio() >= seq_least):
                out.add((a[0], b[0]))
    return out


def test_blocking_loses_no_pair(spark):
    rng = random.Random(4)
    words = "deep sea fish star spectra of the an learning model".split()
    rows = [
        (i, rng.choice(["", f"w{rng.randint(0, 9)}"]), rng.choice(["", "", "10/a", "10/b"]), " ".join(rng.choices(words, k=rng.randint(0, 6))), "; ".join(rng.choices(["A Lee", "B Wu", "C Ng", "D Xi"], k=rng.randint(0, 3))), rng.choice([None, 2000, 2001, 2003]))
        for i in range(90)
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for jac, seq in ((0.5, 0.65), (0.0, 0.2), (1.0, 0.9)):
        got = {(r["i"], r["j"]) for r in dedup.suspected(df, jac, seq).collect()}
        assert got == brute(rows, jac, seq)


def test_characters_in_common_bound_the_ratio(spark):
    rng = random.Random(3)
    pairs = [("".join(rng.choices("abc d", k=rng.randint(1, 30))), "".join(rng.choices("abcd 1", k=rng.randint(1, 30)))) for _ in range(200)] + [("x" * 300, "x" * 250), ("ab" * 150, "ba" * 150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    counts = lambda c: F.array(*[F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit(""))) for x in dedup.TITLE_CHARACTERS])
    for r in df.select("a", "b", dedup.characters_in_common(counts("a"), counts("b")).alias("n")).collect():
        assert r["n"] == sum((Counter(r["a"]) & Counter(r["b"])).values())
        assert 2.0 * r["n"] / (len(r["a"]) + len(r["b"])) >= SequenceMatcher(None, r["a"], r["b"]).ratio()


def test_suspected_pairs_of_the_tables_by_brute_force(spark):
    """All pairs of the works of a table, one after the other."""
    sf = "/root/testdata/sf0.01"
    if not Path(sf).is_dir():
        pytest.skip("no test tables")
    rows = [(r["pos"], r["oid"], r["doi"], r["title"], "; ".join(f"x {s}" for s in r["surnames"]), r["year"]) for r in dedup._fields(views.works(spark, sf)).orderBy("pos").collect()]
    want = brute(rows, 0.5, 0.65)
    got = [(r["i"], r["j"]) for r in registry.queries()["suspected_pairs"](spark, sf).collect()]
    assert len(want) > 20 and sorted(got) == sorted(want)


def test_a_frequent_surname_reaches_the_ratio_only_where_it_may(spark):
    """One surname on all records: what the Python ratio is asked for is what all other rules let through."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    rows = [(i, f"w{i}", "", " ".join(rng.choices(words, k=6)), "A Lee", 2000 + i % 20) for i in range(600)]
    rows += [(1000 + i, f"v{i}", "", rows[i][3][1:], "B Lee", rows[i][5]) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = dedup.candidate_pairs(df).select("l_pos", "r_pos").collect()
    assert {(i, 1000 + i) for i in range(30)} <= {tuple(r) for r in asked} and len({tuple(r) for r in asked}) == len(asked)
    assert len(asked) < 0.5 * sum(abs(a[5] - b[5]) <= 2 for k, a in enumerate(rows) for b in rows[k + 1 :])


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_copies_of_titles_meet_in_blocks(spark, monkeypatch):
    """Frequent titles, one like them, and titles without a word, with more records of each than a block has."""
    monkeypatch.setattr(dedup, "SPREAD", 3)
    titles = ["deep sea fish star spectra", "deep sea fish star spectra of", "sea fish star spectra", "a b", "a c d", "x"]
    rows = [(i, f"w{i % 7}" if i % 3 else "", ["", "10/a", "10/b"][i % 3 if i % 5 else 0], titles[i % len(titles) if i < 40 else 0], ["A Lee", "B Wu; C Ng", ""][i % 3], [None, 2000, 2001, 2003][i % 4]) for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for jac, seq in ((0.5, 0.65), (0.9, 0.8)):
        got = [(r["i"], r["j"]) for r in dedup.suspected(df, jac, seq).collect()]
        assert sorted(got) == sorted(brute(rows, jac, seq)) and len(got) > 100
    got = [(r["i"], r["j"]) for r in dedup.suspected(df, with_sequence=False).collect()]
    assert sorted(got) == sorted(brute(rows, 0.5, 1.1))


def test_a_long_title_moves_once_and_not_with_each_of_its_words(spark):
    words = lambda k: " ".join(f"w{k}x{j * 7919 % 99991}" for j in range(3000))
    rows = [(k, f"i{k}", "", words(k % 6), "A Lee", 2000) for k in range(12)]
    before = shuffled(spark)
    assert {(r["i"], r["j"]) for r in dedup.suspected(spark.createDataFrame(rows, SCHEMA), with_sequence=False).collect()} == {(k, k + 6) for k in range(6)}
    assert shuffled(spark) - before < 60 * sum(len(r[3]) for r in rows)


def test_titles_move_once_whatever_their_copies(spark):
    """Two long titles, nearly alike, with many records each: their text is not sent along with the records that meet."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(1500)]
    titles = [" ".join(words), " ".join(words[:-1])]
    rows = [(i, f"w{i}", "", titles[i % 2], "A Lee" if i % 7 else "B Wu", 2000) for i in range(160)]
    before = shuffled(spark)
    got = dedup.suspected(spark.createDataFrame(rows, SCHEMA), sequence_least=2.0).where("(j - i) % 2 = 1").select("i", "j", "title_similarity").collect()
    ratios = [SequenceMatcher(None, a, b).ratio() for a, b in (titles, titles[::-1])]
    jaccard = len(set(words[:-1])) / len(set(words))
    assert len(got) == 80 * 80 and all(r["title_similarity"] == jaccard for r in got)
    seen = dedup.suspected(spark.createDataFrame(rows, SCHEMA)).where("(j - i) % 2 = 1").select("i", "title_similarity").collect()
    assert len(seen) == 80 * 80 and all(r["title_similarity"] == max(jaccard, ratios[r["i"] % 2]) for r in seen)
    assert shuffled(spark) - before < 30 * sum(len(r[3]) for r in rows)


def test_ratios_of_many_pairs_are_difflibs():
    rng = random.Random(8)
    lengths, pairs = [0, 1, 5, 63, 64, 65, 130, 199, 200, 201, 450], []
    for _ in range(600):
        letters = rng.choice(["ab", "abcd e", dedup.TITLE_CHARACTERS, "a\u00e9\u6f22\U0001f600"])
        a = b = "".join(rng.choices(letters, k=rng.choice(lengths)))
        if rng.random() < 0.4:
            b = "".join(rng.choices(letters, k=rng.choice(lengths)))
        for _ in range(rng.randint(0, 1 + len(b) // 4)):
            i = rng.randint(0, len(b))
            b = b[:i] + rng.choice(["", rng.choice(letters)]) + b[i + rng.randint(0, 1) :]
        pairs.append((a, b, rng.choice([-0.5, 0.0, 0.2, 0.65, 0.8, 0.95, 1.0, 2.0])))
    got = alike.ratios(*[pd.Series(c) for c in zip(*pairs, strict=True)])
    assert sum(0 < r < 1 for r in got) > 100
    for (a, b, least), r in zip(pairs, got, strict=True):
        true = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
        assert r == (true if a == b or (least < 1 and true >= least) else 0.0)
    assert alike.ratios(*[pd.Series([], dtype=t) for t in ("str", "str", "float64")]).tolist() == []


def test_a_pair_of_titles_that_comes_again_is_matched_once(monkeypatch):
    a, b, asked = "deep sea fish " * 20, "deep sea fish " * 19 + "star", []
    true, matched = SequenceMatcher(None, a, b).ratio(), alike.matched
    monkeypatch.setattr(alike, "matched", lambda *x: asked.append(x) or matched(*x))
    got = alike.ratios(pd.Series([a, a, b] * 50), pd.Series([b, b, b] * 50), pd.Series([0.01, true + 1e-6, 0.5] * 50))
    assert true > 0.01 and got.tolist() == [true, 0.0, 1.0] * 50 and len(asked) == 1


def test_ratios_that_no_record_needs_are_not_asked_for(spark, monkeypatch):
    """Alike titles, of which only neighbours have records that may meet: before, each pair of titles was matched in both orders."""
    matched = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(left: pd.Series, right: pd.Series, least: pd.Series) -> pd.Series:
        matched.add(int((least < 1).sum()))
        return pd.Series(alike.ratios(left, right, least))

    monkeypatch.setattr(dedup, "sequence_similarity", counted)
    words = "deep sea fish star spectra of the learning model in cold dark water".split()
    rows = [(i, f"w{i}", "", " ".join([*words, f"m{i}"]), "A Lee", 2000 + 5 * (i // 2)) for i in range(20)]
    got = {(r["i"], r["j"]) for r in dedup.suspected(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(i, i + 1) for i in range(0, 20, 2)} and matched.value <= 40


def test_a_frequent_key_is_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(dedup, "SPREAD", 4)
    rows = dedup._dealt(spark.range(200).select(F.col("id").alias("pos"), F.lit(1).alias("k"), F.lit(200).alias("n")), "n")
    met = dedup._within(rows, "k", F.lit(True), 40).select(F.col("a.pos").alias("a"), F.col("b.pos").alias("b"), F.spark_partition_id().alias("p"))
    found = [(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in met.collect()]
    assert sorted(found) == [(a, b) for a in range(200) for b in range(a + 1, 200)]
    assert max(r["count"] for r in met.groupBy("p").count().collect()) < 0.1 * len(found)


def test_strict_keys_and_marks_of_names(spark):
    """One pass over a title leaves what a pass for marks and one for blanks left; names in common share a bit of their marks, and few others do."""
    rng = random.Random(15)
    texts = ["", " ", "\u2028", "<i>", *["".join(rng.choices("aB9 .,\t\n\x0b\u00a0\u00e9\u0130\u6f22\U0001f600<>[]arxiv:", k=rng.randint(1, 40))) for _ in range(300)]]
    old = F.lower("t")
    for pattern, to in ((r"<[^>]+>", ""), (r"\[arxiv[^\]]*\]", ""), (r"arxiv:\s*\d{4}\.\d{4,}(v\d+)?", ""), (r"[^a-z0-9\s]", " "), (r"\s+", " ")):
        old = F.regexp_replace(old, pattern, to)
    assert all(r["new"] == r["old"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(norm.strict_title_key(F.col("t")).alias("new"), F.trim(old).alias("old")).collect())
    names = spark.createDataFrame([([],), *[(rng.sample([f"n{k}" for k in range(200)], rng.randint(1, 3)),) for _ in range(80)]], "names array<string>")
    rows = [(set(r["names"]), r["mark"]) for r in names.select("names", dedup._mark(F.col("names")).alias("mark")).collect()]
    apart = [x & y == 0 for a, x in rows for b, y in rows if not a & b]
    assert all(x & y for a, x in rows for b, y in rows if a & b) and sum(apart) > 0.8 * len(apart)


def test_reviews_last_decision_counts(spark):
    queue = spark.createDataFrame([("a", "pending", ""), ("b", "confirmed", "merge"), ("c", "pending", "")], "pair_id string, review_status string, action string")
    said = spark.createDataFrame([("a", "y", 1), ("a", "N", 2), ("a", "s", 3), ("b", "n", 1)], "pair_id string, decision string, seq int")
    got = {r["pair_id"]: (r["review_status"], r["action"]) for r in dedup.apply_reviews(queue, said).collect()}
    assert got == {"a": ("distinct", "keep_separate"), "b": ("confirmed", "merge"), "c": ("pending", "")}


def test_provenance_in_the_order_seen(spark):
    df = spark.createDataFrame([("e", 2, ["b", "a"]), ("e", 1, ["c", "", "b"]), ("f", 3, [])], "entity string, pos long, q array<string>")
    assert {r["entity"]: r["q"] for r in dedup.merge_provenance(df, "entity", "q").collect()} == {"e": ["c", "b", "a"], "f": []}
