import math
import random
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from paperloom.operators import agreement, evaluate, sampling, score
from paperloom.operators.rank import ranked


def test_known_answer_of_metrics(spark):
    rows = [("q", 1, 2), ("q", 2, 0), ("q", 3, 1), ("q", 4, None), ("q", 5, 2)]
    m = {r["k"]: r for r in evaluate.metrics(spark.createDataFrame(rows, "g string, rank int, grade int"), ["g"], [3, 5]).collect()}
    assert abs(m[3]["precision"] - 0.666667) < 1e-4 and abs(m[5]["precision"] - 0.75) < 1e-4
    assert abs(m[3]["ndcg"] - 0.649015) < 1e-4 and abs(m[5]["ndcg"] - 0.888599) < 1e-4
    assert abs(m[5]["coverage"] - 0.8) < 1e-9 and m[5]["average_rank_high"] == 3.0


def test_gain_is_null_without_relevant_items(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, None)], "g string, rank int, grade int")
    got = {r["g"]: (r["precision"], r["ndcg"], r["judged"]) for r in evaluate.metrics(df, ["g"], [5]).collect()}
    assert got == {"a": (0.0, None, 1), "b": (None, None, 0)}


def test_illegal_labels_and_cuts(spark):
    df = spark.createDataFrame([("maybe",)], "l string")
    with pytest.raises(PySparkException):
        df.select(evaluate.grade(F.col("l"))).collect()
    for k in (0, -1, True, 2.0):
        with pytest.raises(ValueError):
            evaluate.check_k(k)


def test_macro_is_null_if_any_group_is(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 1.0)], "a double, b double")
    assert tuple(evaluate.macro(df, [], ["a", "b"]).first()) == (1.5, None)


def test_error_codes(spark):
    rows = [(1, 9, 2), (9, 1, 0), (8, 9, 2), (1, 2, 0), (3, 4, None)]
    df = spark.createDataFrame(rows, "o int, n int, g int")
    assert [r[0] for r in df.select(evaluate.error_types(F.col("o"), F.col("n"), F.col("g"))).collect()] == ["A;C", "B;D", "A;E", "B;E", ""]


def test_whole_ranks_equal_a_window(spark):
    df = spark.range(1000).select("id", (F.col("id") * 37 % 11).alias("v"))
    got = {r["id"]: r["rank"] for r in ranked(df, "rank", [F.desc("v"), F.asc("id")]).collect()}
    want = sorted(((-(i * 37 % 11), i) for i in range(1000)))
    assert got == {i: n + 1 for n, (_, i) in enumerate(want)}


def test_two_stage_keeps_all_and_orders(spark):
    rows = [(i, f"deep sea {i}" if i % 2 else "other", "A b", 2000 + i % 30, "", "text deep", i, "s", f"W{i}", "") for i in range(40)]
    df = spark.createDataFrame(rows, "pos long, title string, authors string, publication_year int, doi string, abstract string, cited_by_count long, source_name string, openalex_id string, landing_page_url string")
    out = score.two_stage(score.with_scores(df, "deep sea", 2026), "deep sea").collect()
    assert sorted(r["new_rank"] for r in out) == list(range(1, 41)) == sorted(r["old_rank"] for r in out)
    by = sorted(out, key=lambda r: r["new_rank"])
    assert all(a["stage2_score"] >= b["stage2_score"] for a, b in zip(by, by[1:], strict=False))
    assert all(r["rank_change"] == r["old_rank"] - r["new_rank"] for r in out)


def test_kappas(spark):
    rows = [("r", a, b) for a, b in ["00", "00", "11", "12", "22", "22", "?1"]] + [("s", "1", "1"), ("s", "1", "1"), ("t", "0", "0")]
    got = {r["rq"]: r for r in agreement.kappas(spark.createDataFrame(rows, "rq string, label_a string, label_b string"), ["rq"]).collect()}
    po, pe = 5 / 6, (2 * 2 + 2 * 1 + 2 * 3) / 36
    assert abs(got["r"]["kappa"] - (po - pe) / (1 - pe)) < 1e-12 and got["r"]["eligible"] == 6 and got["r"]["exact"] == 5
    assert got["s"]["kappa"] is None and got["s"]["kappa_status"] == "single_category"
    assert got["t"]["kappa_status"] == "insufficient_pairs"


def test_strata_are_disjoint(spark):
    rows = [("g", i, f"W{i}", "t", (i * 7) % 30 - i) for i in range(1, 31)] + [("small", 1, "W", "t", 0)]
    out = sampling.stratified(spark.createDataFrame(rows, "g string, new_rank int, openalex_id string, title string, rank_change int"), ["g"]).collect()
    assert len(out) == 20 == len({r["openalex_id"] for r in out}) and {r["g"] for r in out} == {"g"}


def test_second_annotators():
    names = list("abcdef")
    pairs = [(f"p{i}", names[i % 6]) for i in range(30)]
    got = sampling.assign_secondary(pairs, names, 5)
    assert all(got.count(n) == 5 for n in names) and all(g != p for g, (_, p) in zip(got, pairs, strict=True))
    with pytest.raises(ValueError):
        sampling.assign_secondary([("p", "a")], ["a"], 1)


def test_tokens_do_not_move_and_rare_ones_weigh_as_the_frequent(spark, monkeypatch):
    """Weights are the same however few frequencies are broadcast, and counting the tokens of a text exchanges texts alone."""
    from paperloom.functions import text

    rows = [(i, " ".join(f"w{j}" for j in range(i % 9 + 1)) + f" own{i} own{i}", "w1 w3") for i in range(40)] + [(99, "", None)]
    df = spark.createDataFrame(rows, "pos long, title string, abstract string").repartition(3)
    seen, cut = [], text.cut

    def spied(table, label):
        if label == "tf":
            seen.append(table._jdf.queryExecution().executedPlan().toString().count("hashpartitioning"))
        return cut(table, label)

    monkeypatch.setattr(text, "cut", spied)
    want = None
    for most in (10_000, 12, 0):
        monkeypatch.setattr(text, "BROADCAST_ROWS", most)
        got = {(r["pos"], r["token"]): (r["tf"], r["df"], r["n"], round(r["idf"], 9)) for r in text.term_weights(df, "title").collect()}
        sims = {r["pos"]: (round(r["s0"], 9), round(r["s1"], 9)) for r in text.query_similarities(df, ["title", "abstract"], "w1 own3 none").collect()}
        want = want or (got, sims)
        assert (got, sims) == want and len(sims) == 41 and got[3, "own3"][:3] == (2, 1, 41) and sims[3][0] > sims[4][0] > sims[0][0] == sims[99][0] == 0
    plan = spark.range(3).repartition("id")._jdf.queryExecution().executedPlan().toString()
    assert seen and set(seen) == {plan.count("hashpartitioning")}


def test_texts_are_scored_once_for_both_orders(spark, monkeypatch):
    """A range sort looks at its rows twice, so no order may have to work out scores from texts."""
    seen, rank = [], score.ranked

    def spied(df, *rest):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return rank(df, *rest)

    monkeypatch.setattr(score, "ranked", spied)
    rows = [(i, f"deep sea {i}", "star", "A", 2000, "d", i, "S", "u") for i in range(30)]
    df = spark.createDataFrame(rows, "pos long, title string, abstract string, authors string, publication_year int, doi string, cited_by_count int, source_name string, landing_page_url string")
    assert score.two_stage(score.with_scores(df, "deep star", 2026), "deep star").count() == 30
    assert len(seen) == 2 and not any("regexp" in plan for plan in seen)


def test_odd_texts_are_counted_as_by_plain_code(spark, monkeypatch):
    """Groups, rare tokens that are joined, a key on two rows, and texts in pieces."""
    from collections import Counter

    from paperloom.functions import text

    def plain(s):
        s = s or ""
        runs = re.findall("[一-鿿]+", s)
        return Counter(re.findall("[a-z0-9]+", s.lower()) + [p for r in runs for p in ([r] if len(r) == 1 else map("".join, zip(r, r[1:], strict=False)))])

    rng = random.Random(8)
    odd = ["İx Kelvin", "深海 deep 鱼, sea深海鱼", "", None, "DEEP-deep\x00sea", "é deep ß", "x" * 3000, " ,;", "\nsea\n"]
    rows = [(i, "a" if i % 3 else None, odd[i % len(odd)], " ".join(str(rng.getrandbits(40)) for _ in range(300)) + " deep" * (i % 4)) for i in range(90)]
    rows.append((4, "a", "deep sea", "again deep"))
    df = spark.createDataFrame(rows, "pos long, g string, title string, abstract string").repartition(3)
    monkeypatch.setattr(text, "BROADCAST_ROWS", 20)
    monkeypatch.setattr(text, "PIECE", 5000)
    held = text._held(text.counted_texts(df.where("pos <> 4"), ["title", "abstract"], "pos", ["g"]), ["g", "field"])
    assert held.rest is not None
    got = {(r["g"], r["pos"], r["field"], r["token"]): r["tf"] for r in text._each(text.counted_texts(df, ["title", "abstract"], "pos", ["g"]), ["g", "pos"]).where("token IS NOT NULL").collect()}
    want = Counter()
    for pos, g, *texts in rows:
        for i, s in enumerate(texts):
            want.update({(g, pos, i, t): n for t, n in plain(s).items()})
    assert got == want
    named = df.where("g IS NOT NULL")
    found = {r["pos"]: (r["s0"], r["s1"]) for r in text.query_similarities(named, ["title", "abstract"], "deep sea 深海", "pos", ["g"]).collect()}
    for i in range(2):
        bags = {}
        for r in rows:
            if r[1]:
                bags[r[0]] = bags.get(r[0], Counter()) + plain(r[2 + i])
        df_of = Counter(t for b in bags.values() for t in b)
        idf = {t: math.log((len(bags) + 1) / (n + 1)) + 1 for t, n in df_of.items()}
        q = {t: idf[t] * n for t, n in plain("deep sea 深海").items() if t in idf}
        for pos, b in bags.items():
            norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in b.items())) * math.sqrt(sum(v * v for v in q.values()))
            assert found[pos][i] == pytest.approx(sum(q.get(t, 0) * n * idf[t] for t, n in b.items()) / norm if norm else 0.0)


def test_terms_of_a_keyword_are_whole_words(spark):
    texts = ["deep", "Deep-SEA", "deepsea sea2 2sea", "seas deep sea deep", "a seaK", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for keyword in ("deep sea", "sea seas a", "a", "", "SEA deep sea"):
        literal, general = (score.relevance(k, F.col("t"), F.col("t")) for k in (keyword, F.lit(keyword)))
        assert all(r["x"] == r["y"] for r in df.select(literal.alias("x"), general.alias("y")).collect())


def test_texts_are_few_rows_for_spark_however_many_tokens(spark, monkeypatch):
    """Weighing reads a row for each piece of texts and field, and groups of one text each, more than there are tokens, are corpora too."""
    from paperloom.functions import text

    rows = [(i, f"g{i}" if i % 7 else "g0", f"deep w{i % 5} w{i % 5} sea" if i % 3 else "", f"sea {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, g string, title string, abstract string")
    written, cut = [], text.cut

    def spied(table, label):
        out = cut(table, label)
        written.extend([out.count()] if label == "tf" else [])
        return out

    monkeypatch.setattr(text, "cut", spied)
    found = {r["pos"]: (r["s0"], r["s1"]) for r in text.query_similarities(df, ["title", "abstract"], "deep sea", "pos", ["g"]).collect()}
    assert len(found) == 400 and written and all(n <= 2 * 8 for n in written)
    # Alone in its group, every token weighs the same.
    assert found[1][0] == pytest.approx(2 / (math.sqrt(6) * math.sqrt(2))) and found[3][0] == 0.0 and found[1][1] == pytest.approx(1 / math.sqrt(2))


def test_terms_are_found_among_the_counted_tokens(spark, monkeypatch):
    """Ranking papers goes over their texts once, by no expression, and gives what scores by expressions give."""
    rows = [(i, "a" if i % 3 else "b", ["deep sea", "The Deep", "", None, "seas İs \u212a 深海"][i % 5], f"deep {i}" if i % 4 else "sea k", "A" if i % 2 else "", 2000 + i % 30, "d", i, "S", "u") for i in range(60)]
    df = spark.createDataFrame(rows, "pos long, g string, title string, abstract string, authors string, publication_year int, doi string, cited_by_count int, source_name string, landing_page_url string")
    asked = {"a": "deep sea k is kk none", "b": "深海"}
    cases = [("deep sea is", None), (asked, ["g"])]
    want = [sorted(map(tuple, score.two_stage(score.with_scores(df, k, 2026, by), k, by).select("pos", "preliminary_score", "stage2_score", "old_rank", "new_rank").collect())) for k, by in cases]
    monkeypatch.setattr(score, "relevance", None)
    got = [sorted(map(tuple, score.two_stage_of(df, k, 2026, by).select("pos", "preliminary_score", "stage2_score", "old_rank", "new_rank").collect())) for k, by in cases]
    assert got == want and len({r[1] for r in got[0]}) > 10


def test_first_lines_are_read_without_cutting_texts(spark):
    from paperloom.plans import views

    plan = views.papers(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "substring_index" in plan and "split_part" not in plan and "split(text" not in plan
    texts = spark.createDataFrame([(t,) for t in ["a\nb", "\na", "a", "", None, "ä\n\n"]], "text string")
    assert all(r["x"] == r["y"] for r in texts.selectExpr(f"{views.PAPER_COLUMNS['title']} AS x", f"{views.FIRST_LINE['title']} AS y").collect())


def test_both_rankings_are_written_before_metrics_read_them(spark):
    """Metrics read a ranking several times, which may not join it to the grades each time."""
    from paperloom.plans import eval_queries

    plan = eval_queries.both_rankings(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "Join" not in plan and "Exchange" not in plan


def test_rows_that_share_a_position_keep_relevance_of_their_own(spark):
    rows = [(i % 9, "deep sea" if i < 9 else "none", "sea", "A", 2000, "d", 5, "S", "u") for i in range(10)]
    df = spark.createDataFrame(rows, "pos long, title string, abstract string, authors string, publication_year int, doi string, cited_by_count int, source_name string, landing_page_url string")
    want = sorted(r[0] for r in score.with_scores(df, "deep sea", 2026).select("preliminary_score").collect())
    assert sorted(r[0] for r in score.two_stage_of(df, "deep sea", 2026).select("preliminary_score").collect()) == want and len(set(want)) == 2
