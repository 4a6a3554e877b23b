from pyspark.sql import functions as F

from paperloom.functions import norm
from paperloom.functions.text import keyword_terms, mixed_tokens, query_similarity, term_weights


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_text_and_numbers(spark):
    assert one(spark, "　 a b \t", norm.clean_text) == "a b"
    assert one(spark, None, norm.clean_text) == ""
    for raw, want in ((" 12 ", 12), ("12.0", None), ("abc", None), (None, None)):
        assert one(spark, raw, norm.clean_int) == want
    assert one(spark, 12.7, norm.clean_int, "double") == 12
    assert [one(spark, v, norm.is_missing) for v in (None, "  ", "0")] == [True, True, False]


def test_doi_loses_one_prefix(spark):
    cases = {"https://doi.org/10.1/A": "10.1/a", "DOI:10.1/x": "10.1/x", "https://dx.doi.org/10.1/x": "https://dx.doi.org/10.1/x", "doi:doi:1": "doi:1", "": ""}
    assert {k: one(spark, k, norm.normalize_doi) for k in cases} == cases


def test_title_keys(spark):
    assert one(spark, " A  <b>Title</b> ", norm.title_key) == "a <b>title</b>"
    assert one(spark, "<b>Deep</b> Sea: [arXiv v1] arXiv: 2101.00001v2 x", norm.strict_title_key) == "deep sea x"
    assert one(spark, "光谱分析", norm.strict_title_key) == ""


def test_surnames_and_overlap(spark):
    assert one(spark, "Ann Lee; Bo Wu Jr.; ; X", norm.surnames) == ["lee", "jr"]
    row = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>").select(norm.overlap(F.col("a"), F.col("b")), norm.overlap(F.col("e"), F.col("e"))).first()
    assert row[0] == 1 / 3 and row[1] == 0


def test_redaction(spark):
    assert one(spark, "token = abc\nnext", norm.redact) == "token=<redacted> next"
    assert len(one(spark, "x" * 400, norm.redact)) == 300


def test_rebuilt_abstract_takes_the_last_of_a_position(spark):
    df = spark.createDataFrame([(1, {"a": [0, 2], "b": [1]}), (2, None), (3, {})], "pos int, i map<string,array<int>>")
    assert {r["pos"]: r["abstract"] for r in norm.rebuild_abstracts(df, "pos", "i").collect()} == {1: "a b a", 2: "", 3: ""}


def test_tokens(spark):
    assert one(spark, "Deep-sea x A1 deep", keyword_terms) == ["deep", "sea", "a1"]
    assert one(spark, "Ab 光谱分 x 析", mixed_tokens) == ["ab", "x", "光谱", "谱分", "析"]


def test_known_answer_of_term_weights(spark):
    docs = spark.createDataFrame([(1, "machine learning spectra"), (2, "machine vision"), (3, "deep sea fish")], "pos long, t string")
    idf = {r["token"]: r["idf"] for r in term_weights(docs, "t").select("token", "idf").distinct().collect()}
    assert abs(idf["machine"] - 1.287682) < 1e-6 and abs(idf["spectra"] - 1.693147) < 1e-6
    sim = {r["pos"]: r["similarity"] for r in query_similarity(docs, "t", "machine learning").collect()}
    assert abs(sim[1] - 0.782408) < 1e-4 and abs(sim[2] - 0.366447) < 1e-4 and sim[3] == 0


def test_groups_are_corpora_of_their_own(spark):
    docs = spark.createDataFrame([("a", 1, "x y"), ("a", 2, ""), ("b", 3, "x"), ("c", 4, "q")], "g string, pos long, t string")
    n = {(r["g"], r["token"]): (r["n"], r["df"]) for r in term_weights(docs, "t", by=["g"]).collect()}
    assert n["a", "x"] == (2, 1) and n["b", "x"] == (1, 1)
    sim = {r["pos"]: r["similarity"] for r in query_similarity(docs, "t", "x", by=["g"]).collect()}
    assert sim[2] == 0 and sim[4] == 0 and abs(sim[3] - 1) < 1e-12
