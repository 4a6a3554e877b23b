import hashlib
import json
import math
import random
import re
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paperloom.llm import exact, mixing, quality
from paperloom.llm.registry import vocabulary_path

from .data import assert_clashes_kept, documents, frame, with_clashes
from .test_native import fill
from .test_near import parts, sets_of

SF = Path("/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def tables(spark):
    if not SF.is_dir():
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_labels_never_seen_are_met(spark, tables):
    docs, labels = tables
    model = quality.fit(docs)
    judged = quality.score(docs, model).join(labels, "doc_id").select("kept", "quality").collect()
    right = sum(r["kept"] == (r["quality"] == 1) for r in judged)
    clean = [r["kept"] for r in judged if r["quality"] == 1]
    assert right / len(judged) >= 0.97 and sum(clean) / len(clean) >= 0.99


def plain_estimate(v, rounds=300):
    """Expectation maximisation document by document; the probability of good for each row of votes."""
    p = [0.0 if quality.BAD in row else 1.0 for row in v]
    told = [any(x != quality.ABSTAIN for x in row) for row in v]
    for _ in range(rounds):
        like = []
        mass = [sum((q if c else 1 - q) for q, t in zip(p, told) if t) for c in (0, 1)]
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        for c in (0, 1):
            table = []
            for k in range(len(v[0])):
                held = [0.5, 0.5, 0.5]
                for row, q, t in zip(v, p, told):
                    held[row[k]] += (q if c else 1 - q) if t else 0
                table.append([h / sum(held) for h in held])
            like.append([math.log(prior if c else 1 - prior) + sum(math.log(table[k][x]) for k, x in enumerate(row)) for row in v])
        p = [1 / (1 + math.exp(max(-50, min(50, a - b)))) for a, b in zip(*like)]
    return prior, [q if t else prior for q, t in zip(p, told)]


def drawn_votes(n, alarms, seed):
    rng = np.random.default_rng(seed)
    good = rng.random(n) < 0.8
    v = np.full((n, len(quality.LABELLERS)), quality.ABSTAIN)
    for k in range(len(quality.LABELLERS)):
        v[good, k] = np.where(rng.random(good.sum()) < alarms, quality.BAD, quality.GOOD)
        v[~good, k] = np.where(rng.random((~good).sum()) < 0.5, quality.BAD, quality.GOOD)
        v[rng.random(n) < 0.1, k] = quality.ABSTAIN
    return good, v


@pytest.mark.parametrize("alarms", [0.003, 0.02, 0.05])
def test_estimation_finds_both_accuracies(alarms):
    good, v = drawn_votes(20000, alarms, 1)
    found, n = np.unique(quality.pattern_of(v), return_counts=True)
    labels = quality.estimate(dict(zip(found.tolist(), n.tolist(), strict=True)))
    assert abs(labels.prior - 0.8) < 0.02 and np.abs(labels.accuracy[quality.BAD] - 0.5).max() < 0.05
    assert np.abs(labels.accuracy[quality.GOOD] - (1 - alarms)).max() < 0.01
    judged = np.array([labels.posterior[x] for x in quality.pattern_of(v).tolist()]) >= 0.5
    assert (judged == good).mean() > 0.97
    assert (quality.votes_of(quality.pattern_of(v[:50])) == v[:50]).all()


def test_estimation_equals_plain_code():
    _, v = drawn_votes(300, 0.05, 2)
    prior, want = plain_estimate(v.tolist())
    found, n = np.unique(quality.pattern_of(v), return_counts=True)
    labels = quality.estimate(dict(zip(found.tolist(), n.tolist(), strict=True)), rounds=300)
    assert abs(labels.prior - prior) < 1e-6
    assert np.abs(np.array([labels.posterior[x] for x in quality.pattern_of(v).tolist()]) - want).max() < 1e-5


def plain_look(text):
    """(shares, words as (bytes, shape, repeats)) of one text, character by character."""
    raw = text.encode()
    words = [w.encode() for w in re.findall("[\u3000-\u9fff]|[^\x20\x09-\x0D\u3000-\u9fff]+", text)]
    n = len(words)
    letters = [b for b in raw if chr(b).isascii() and chr(b).isalpha()]
    symbols = b"#$%&*@^~=+<>{}[]\\_`"
    visible = [b for b in raw if b not in b" \t\n\x0b\x0c\r"]

    def shape(b):
        c = chr(b)
        if b >= 0x80 or c.islower():
            return 1
        return 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:?" else 5 if b in symbols else 6 if c == "|" else 7 if c == "!" else 0

    share = lambda hits: sum(hits) / max(n, 1)
    shares = {
        "repeats": share(i > 0 and words[i] == words[i - 1] for i in range(n)),
        "repeats_far": share(i > 1 and words[i] == words[i - 2] for i in range(n)),
        "distinct": sum(len(set(words[i : i + quality.WINDOW])) for i in range(0, n, quality.WINDOW)) / max(n, 1),
        "upper": sum(chr(b).isupper() for b in letters) / max(len(letters), 1),
        "symbols": sum(b in symbols for b in raw) / max(n, 1),
        "symbol_ends": share(shape(w[-1]) == 5 for w in words),
        "bangs": share(w[-1:] == b"!" for w in words),
        "bars": share(w == b"|" for w in words),
        "marks": sum(0x20 < b < 0x7F and not chr(b).isalnum() for b in visible) / max(len(visible), 1),
        "wordless": share(not any(b >= 0x80 or chr(b).isalpha() for b in w) for w in words),
    }
    return shares, [(w, shape(w[0]) * 64 + shape(w[-1]) * 8 + min(len(w) // 3, 7), i > 0 and words[i - 1] == w) for i, w in enumerate(words)]


def test_what_is_seen_of_texts_equals_plain_code(tables, monkeypatch):
    texts = [t or "" for _, t, *_ in documents() if len(t or "") < 5000] + [r["text"] or "" for r in tables[0].limit(60).collect()]
    want = [plain_look(t) for t in texts]
    for piece in (1 << 22, 700):
        monkeypatch.setattr(quality, "PIECE_BYTES", piece)
        looks = quality.look(texts)
        for i, (shares, words) in enumerate(want):
            assert all(abs(looks.shares[k][i] - x) < 1e-9 for k, x in shares.items())
            a, b = looks.first[i], looks.first[i + 1]
            assert [(int(s), bool(r)) for s, r in zip(looks.shapes[a:b], looks.repeats[a:b], strict=True)] == [w[1:] for w in words]


def test_scripts_without_spaces_have_words_and_votes():
    rng = random.Random(8)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x5200)) if i % 12 else "\u3002" for i in range(30000))
    mixed = "Spark \u8fd0\u884c SQL\u67e5\u8be2 caf\u00e9 \u3053\u3093"
    looks = quality.look([chinese, "\u5783\u573e" * 4000, mixed, "\uc548\ub155 \uc138\uacc4"])
    assert looks.n.tolist() == [30000, 8000, 9, 2]
    votes = quality.votes(looks)
    assert (votes[0] != quality.ABSTAIN).any() and not (votes[0] == quality.BAD).any() and (votes[1] == quality.BAD).sum() >= 2


def test_the_sample_is_bounded_in_features(spark, monkeypatch):
    """Long documents make it smaller by whole documents, in the order of their hash."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400)), "", "", 0) for i in range(60)]
    held = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda row, slot, value, target, times: held.append((len(target), len(slot))) or real(row, slot, value, target, times))
    quality.fit(frame(spark, rows))
    monkeypatch.setattr(quality, "SAMPLE_FEATURES", 5000)
    quality.fit(frame(spark, rows))
    assert held[0][0] == 60 and held[0][1] > 20000 and 10 <= held[1][0] < 15 and 4000 < held[1][1] <= 5000


def test_copies_and_null_ids_do_not_enlarge_the_sample(spark, monkeypatch):
    """All rows of one id, or of none, would be drawn all or none by a hash of the id."""
    rng = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(None, " ".join(rng.choices(words, k=30)) + f" w{i}.", "", "", 0) for i in range(2000)]
    rows += [(7, "one and the same text " * 10, "", "", 0)] * 1000
    held = []
    real = quality.train
    monkeypatch.setattr(quality, "train", lambda row, slot, value, target, times: held.append((len(target), times.sum())) or real(row, slot, value, target, times))
    quality.fit(frame(spark, rows), sample_docs=300)
    assert 100 < held[0][0] < 400


def test_edges(spark):
    df = with_clashes(frame(spark))
    model = quality.fit(df)
    got = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    assert len(got) == len(documents())
    for d, t, *_ in documents():
        assert got[d]["n_words"] == len((t or "").split(" ")) or got[d]["n_words"] >= 0
        if not (t or "").strip():
            assert got[d]["score"] == 0 and not got[d]["kept"]
    kept = {r["doc_id"] for r in quality.keep_good(df, model).collect()}
    assert kept == {d for d, r in got.items() if r["kept"]}
    empty = frame(spark, [])
    assert quality.score(empty, quality.fit(empty)).collect() == []


def plain_hash(word):
    """A word's feature hash, byte by byte."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    h = sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(word)) & mask
    return plain_mix(h ^ len(word))


def plain_mix(h):
    mask = (1 << 64) - 1
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = ((h ^ h >> 33) * factor) & mask
    return h ^ h >> 33


def plain_quality(texts):
    """Whether each text is kept: votes, expectation maximisation and a logistic scorer, text by text and with a dense matrix."""
    looks = [plain_look(t) for t in texts]
    v = []
    for shares, words in looks:
        row = []
        for what, side, bad, good in quality.LABELLERS:
            x = shares[what]
            row.append(quality.BAD if (x > bad if side == ">" else x < bad) else quality.GOOD if (x <= good if side == ">" else x >= good) else quality.ABSTAIN)
        v.append(row if len(words) >= quality.LEAST_WORDS else [quality.ABSTAIN] * len(row))
    _, target = plain_estimate(v, 60)
    size = 1 << quality.HASH_BITS
    x = np.zeros((len(texts), size + 1))
    for i, (_, words) in enumerate(looks):
        for word, shape, again in words:
            for h in (plain_hash(word), plain_mix(shape + (1 << 40)), plain_mix(shape // 8 % 8 * 2 + again + (1 << 41))):
                x[i, h % size] += 1
        x[i] = np.sqrt(x[i] / max(len(words), 1))
    x[:, -1] = 1
    w, mean, square = (np.zeros(size + 1) for _ in range(3))
    for step in range(1, 151):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target) / len(texts) + 1e-4 * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return [bool(words) and z >= 0 for (_, words), z in zip(looks, x @ w, strict=True)]


def plain_mixing(rows):
    """How often each row (doc_id, text, source) stands in the mix."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    by = {}
    for i, (_, _, s) in enumerate(rows):
        by.setdefault(s, []).append(i)
    targets = fill({s: sum(size[i] for i in at) for s, at in by.items()}, (5, 2, 1), 3)
    copies = [0] * len(rows)
    for s, at in by.items():
        held = sum(size[i] for i in at)
        whole = int(targets[s] // held) if held else 0
        more = targets[s] - whole * held
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        draw = {i: int(md5(f"23:{rows[i][0]}" + ("" if rows[i][1] is None else ":" + md5(rows[i][1])))[:10], 16) / 2**40 for i in at}
        bins = {}
        for i in at:
            bins.setdefault(int(draw[i] * mixing.BINS), []).append(i)
            copies[i] = whole
        for b in sorted(bins):
            words = sum(size[i] for i in bins[b])
            through = 0
            for i in sorted(bins[b], key=lambda i: (draw[i], rows[i][0])):
                through += size[i]
                if whole < 3 and (words <= more or through - size[i] / 2 <= more):
                    copies[i] += 1
            if words > more:
                break
            more -= words
    return copies


def test_run_equals_plain_code(spark):
    """Every stage once more in plain code, over all documents."""
    small = SF.parent / "sf0.001"
    if not small.is_dir():
        pytest.skip("no test tables")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "source").collect()]
    kept = plain_quality([t or "" for _, t, _ in rows])
    rows = [r for r, k in zip(rows, kept, strict=True) if k]
    last = {}
    for d, t, _ in rows:
        last[exact_key(t)] = max(d, last.get(exact_key(t), d))
    rows = [r for r in rows if last[exact_key(r[1])] == r[0]]
    sets = sets_of(rows)
    like = lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    component = parts(sets, like)
    rows = [r for r in rows if component[r[0]] == r[0]]
    library = Tokenizer.from_file(vocabulary_path())
    want = sorted((d, library.encode(t or "", add_special_tokens=False).ids) for (d, t, _), n in zip(rows, plain_mixing(rows), strict=True) for _ in range(n))
    got = corpus_pipeline.run(spark, str(small)).collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want and 0 < len(rows) < len(kept)


def test_pipeline_stages_keep_columns_and_clashing_names(spark):
    rows = [(i, t, "en", s, 0) for i, (t, s) in enumerate([("the quick brown fox jumps over a lazy dog again and again until it is tired of all this " * 2 + f"end{i}.", "ab"[i % 2]) for i in range(8)])] + [(None, None, None, None, None), (3, "", "", "", 0)]
    docs = with_clashes(frame(spark, rows))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut(stage(spark, docs, ""), "stage")
        assert out.columns == docs.columns
        docs = out
    assert_clashes_kept(docs.collect())
    empty = with_clashes(frame(spark, []))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = corpus_pipeline.cut(stage(spark, empty, ""), "stage")
        assert empty.collect() == []


def exact_key(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert json.dumps(sorted(__spark_entry__.oracle_sql())) and exact.MAX_DEPTH <= 16
