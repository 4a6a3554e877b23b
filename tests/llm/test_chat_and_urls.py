import random
import time

from pyspark.sql import functions as F

from paperloom.llm import chat, urls
from paperloom.llm.registry import URL_RULES

SCHEMA = "conv_id long, turn long, role string, text string"


def read_back(df):
    out = chat.format_chat(df).withColumn("turns", chat.parse_chat(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: r for r in out.collect()}


def test_any_text_comes_back(spark):
    rng = random.Random(3)
    bits = ["###", "#", "</turn>", "</tu", "\\", "\\h", "\\s", ": ", "\n", "é", "<", "turn>", "h", "", "Assistant"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: #b", "x</turn>"]), "".join(rng.choices(bits, k=rng.randint(0, 9)))) for c in range(60) for t in range(rng.randint(1, 7))]
    got = read_back(spark.createDataFrame(rows, SCHEMA).withColumn("formatted", F.lit(1)))
    for c in range(60):
        own = sorted((t, r, x) for k, t, r, x in rows if k == c)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in own]
        assert got[c]["loss"] == "".join(x for _, r, x in own if r == "assistant")


def test_edges(spark):
    rows = [(1, 1, "user", None), (1, None, "user", "first"), (1, 2, None, "x"), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (None, 1, "user", "n"), (3, 0, "assistant", "y" * 100_000)]
    got = read_back(spark.createDataFrame(rows, SCHEMA))
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "first"), ("user", ""), ("", "x")]
    assert got[2]["formatted"] == "###assistant: a</turn>a</turn>b</turn>\n" and got[2]["loss"] == "aab"
    assert got[None]["formatted"] == "###user: n</turn>\n" and got[None]["loss"] == ""
    assert len(got[3]["loss"]) == 100_000
    assert read_back(spark.createDataFrame([], SCHEMA)) == {}


def test_spans_in_characters_and_bytes(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant"]), "".join(rng.choices(["é", "漢", "a", "###", "😀", "\\"], k=rng.randint(0, 6)))) for c in range(20) for t in range(rng.randint(1, 60))]
    for r in chat.format_chat(spark.createDataFrame(rows, SCHEMA)).collect():
        said = [x for _, x in sorted((t, x) for c, t, role, x in rows if c == r["conv_id"] and role == "assistant")]
        assert len(r["loss_spans"]) == len(said)
        for s, x in zip(r["loss_spans"], said, strict=True):
            text = r["formatted"][s["start"] : s["start"] + s["length"]]
            assert text.encode() == r["formatted"].encode()[s["byte_start"] : s["byte_start"] + s["byte_length"]]
            assert text.replace("\\h", "###").replace("\\s", "\\") == x


def test_a_very_long_conversation_and_many_rows_without_an_id(spark):
    n = 100_000
    one = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é"), F.col("id").cast("string")).alias("text"))
    none = spark.range(n).select(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.format_string("%06d", F.col("id")).alias("text"))
    began = time.time()
    out = chat.format_chat(one.unionByName(none)).withColumns({"turns": F.size(chat.parse_chat(F.col("formatted"))), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r["conv_id"]: (r["turns"], r["loss"], r["loss_spans"][-1], r["formatted"]) for r in out.collect()}
    assert time.time() - began < 60
    assert got[1][:2] == (n, "".join(f"é{i}" for i in range(1, n, 2))) and got[None][:2] == (n, "".join(f"{i:06d}" for i in range(n)))
    for _, _, last, formatted in got.values():
        assert formatted[last["start"] : last["start"] + last["length"]] in (f"é{n - 1}", f"{n - 1:06d}")


def brute(rules, host, path):
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (r[1].count("."), len(r[2]), r[0] == "block"), default=None)
    return (best[1] + best[2], best[0]) if best else None


def test_trie_finds_the_longest_rule():
    rng = random.Random(5)
    labels, segments = ["a", "b", "com", "www"], ["", "x", "xy", "y"]
    host = lambda: ".".join(rng.choices(labels, k=rng.randint(1, 4)))
    path = lambda: "/".join(["", *rng.choices(segments, k=rng.randint(0, 4))])
    rules = [(rng.choice(["allow", "block"]), host(), path()) for _ in range(120)]
    trie = urls.UrlTrie(rules)
    for _ in range(3000):
        h, p = host(), path()
        assert trie.match(h, p) == brute(rules, h, p)


def test_urls(spark, monkeypatch):
    rows = ["http://WWW.example.com/en/1?x", "http://www.example.com", "https://m.example.com/en/", "http://a.net/es/#t", "http://a.net/esx", "ftp://net/fr/?", "no scheme.com/", None, "", "x://:y://a.com/", "http://a.com?q=/en/", "http://xcom/", "http://a.com/é\nb"]
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(rows)], "page_id long, url string, rule int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, URL_RULES).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("www.example.com", "", None, "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3][1:] == ("/es/", "net/es/", "block") and got[4][2] is None
    assert got[5] == ("net", "/fr/", "net/fr/", "block") and got[6][:3] == got[7][:3] == got[8][:3] == ("", "", None)
    assert got[10] == ("a.com", "", None, "allow") and got[11][2] is None and got[12] == ("a.com", "/é\nb", "com/", "allow")
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", 2)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df, URL_RULES).collect()} == got
    assert urls.judge_urls(df.limit(0), URL_RULES).collect() == []
