"""Small tables with nulls, empty and very long texts, ties, repeated rows and columns with clashing names."""

import random

from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Names that the operators use themselves.
CLASHING = ["h", "sha", "norm", "n", "rep", "size", "bin", "kept", "score", "shard", "slot", "bucket", "component_id", "copies", "host", "_u", "_row", "row", "id", "hash", "stays", "key", "draw", "own", "whole", "last", "ends", "k", "d", "t", "drawn", "copy", "gone", "picked", "_id", "_hash", "_plan", "_copies", "_picked", "text_hash"]


def text(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def documents(seed=1):
    """(doc_id, text, lang, source, n_chars)"""
    rng = random.Random(seed)
    rows = []
    for base in range(12):
        t = text(rng, rng.choice([4, 30, 80, 200]))
        rows.append(t)
        rows += [t.upper() if rng.random() < 0.5 else t for _ in range(rng.choice([0, 1, 5]))]
        if len(t.split()) > 20:
            rows += [edited(rng, t, rng.choice([1, 2, 4, 8])) for _ in range(6)]
    shared = text(rng, 60)
    rows += [f"{text(rng, 40)} {shared} {text(rng, 40)}" for _ in range(15)]
    rows += [None, "", "   ", "\n\t", "one", "one", "One two", "É é ß ſ K", "É É SS s k", text(rng, 30_000), "x" * 100_000, "a|b", "<|endoftext|> tail", "it's  a\n\n 'test' 12½"]
    sources = ["s0"] * 4 + ["s1", "s2", "ß", None]
    return [(i, t, "en", rng.choice(sources), len(t) if t else None) for i, t in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(5)


def with_clashes(df):
    """df with a column of each name, whose value tells the name and the row's id."""
    return df.withColumns({c: F.concat_ws("/", F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING if c not in df.columns})


def assert_clashes_kept(rows):
    """All the columns that with_clashes has added still hold what it put there."""
    for r in rows:
        assert all(r[c] == (c if r["doc_id"] is None else f"{c}/{r['doc_id']}") for c in CLASHING), r
