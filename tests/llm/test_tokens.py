import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from paperloom.llm import bpe, pretoken, sstable
from paperloom.llm.registry import vocabulary_path

from .data import documents, frame, with_clashes


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(vocabulary_path())


def odd_texts():
    rng = random.Random(2)
    alphabet = "ab'stremvdlAZ09 \n\t\r ’.,!é中あ١²½\u0085\u001c᠎​　😀е́"
    out = ["".join(rng.choices(alphabet, k=rng.randint(0, 50))) for _ in range(3000)]
    out += ["x" + chr(c) + " " + chr(c) + chr(c) for c in range(0, 0x20000, 3) if not 0xD800 <= c < 0xE000]
    return out + ["", "a" * 5000, "ab" * 3000 + " x", "<|endoftext|>", "x<|endoftext|><|endoftext|> y<|endoftext", "'s", "it's 'S don't'll 'rest", "é" * 300, "!" * 200]


def test_ids_equal_the_library(library, vocabulary):
    texts = odd_texts() + [t or "" for _, t, *_ in documents()]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    words = [w for t in texts[:2000] for w in t.split()] + [" " + w for w in texts[0].split()] + ["'s", " the"]
    seen = bpe.Transducer.map(bpe.Transducer.compile((w.encode() for w in words), vocabulary).to_bytes())
    for encoder in (bpe.Encoder(vocabulary), bpe.Encoder(vocabulary, seen), bpe.Encoder(vocabulary, bpe.Transducer.map(bpe.Transducer.compile([], vocabulary).to_bytes()))):
        got = encoder.encode_batch(texts)
        assert [g.tolist() for g in got] == want
    assert all(vocabulary.decode(g) == library.decode(w, skip_special_tokens=False) for g, w in zip(got[-60:], want[-60:], strict=True))


def test_automaton_is_minimal_and_counts_words(vocabulary):
    words = sorted({w.encode() for w in ("tap taps top tops tip a ab abc stop stops " + " ".join(f"w{i}ing" for i in range(50))).split()})
    t = bpe.Transducer.compile(words, vocabulary)
    buf = np.frombuffer(b"".join(words), np.uint8)
    n = np.array([len(w) for w in words])
    assert t.find(buf, np.cumsum(n) - n, n).tolist() == list(range(len(words)))
    assert t.find(buf, np.array([0, 1]), np.array([0, 1])).tolist()[0] == -1
    rights = {}
    for w in {w[:i] for w in words for i in range(len(w) + 1)}:
        rights.setdefault(frozenset(x[len(w) :] for x in words if x.startswith(w)), w)
    assert len(t.final) == len(rights)


def test_words_tile_the_texts():
    texts = odd_texts()[:500]
    w = pretoken.split_words(texts)
    for i, t in enumerate(texts):
        assert b"".join(w.buf[a:b].tobytes() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]], strict=True)) == t.encode()


def test_operators(spark, library):
    rows = documents()
    df, path = with_clashes(frame(spark)), vocabulary_path()
    want = {d: library.encode(t or "", add_special_tokens=False).ids for d, t, *_ in rows}
    encoded = bpe.encode(df, path, words=200)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == want
    assert {r["doc_id"]: r["text"] for r in bpe.decode(encoded, path).collect()} == {d: t or "" for d, t, *_ in rows}
    for r in bpe.round_trip(df, path).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert bpe.round_trip(frame(spark, []), path).collect() == []
    counts = {bytes(r["word"]): r["n"] for r in bpe.count_words(df).collect()}
    assert len(bpe.frequent_words(df, 20)) <= 20 and counts[b" alpha"] > 1


def test_sorted_tables(spark, library):
    rows = [*documents(), (-5, "negative", "", "", 0), (3, "again", "", "", 0)]
    df, path = with_clashes(frame(spark, rows)), vocabulary_path()
    files = sstable.write_tokens(df, path, files=3, block_bytes=500)
    got = sorted((tuple(r) for r in sstable.read_tokens(spark, files).collect()), key=lambda r: r[1])
    ordered = sorted(((d, t or "") for d, t, *_ in rows))
    assert [r[0] for r in got] == [d for d, _ in ordered]
    whole = lambda t: [*library.encode(t, add_special_tokens=False).ids, 0]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((d, len(whole(t)), zlib.crc32(np.array(whole(t), "<u4").tobytes())) for d, t in ordered)
    assert [r[1] for r in got] == [sum(r[2] for r in got[:i]) for i in range(len(got))]
    for d in (-5, 0, 50, len(rows) - 3):
        assert [x.tolist() for x in sstable.lookup(files, d)] == [whole(t) for k, t in ordered if k == d]
    assert len(sstable.lookup(files, 3)) == 2 and sstable.lookup(files, 10**12) == [] and sstable.lookup(files, -9) == []
    reader = sstable.Reader(files[0]["path"])
    assert reader.meta["docs"] == files[0]["docs"] and len(reader.index) > 1
    assert sstable.read_tokens(spark, sstable.write_tokens(frame(spark, []), path)).collect() == []
    # One id with very many rows fills several files, and all are found.
    hot = sstable.write_tokens(frame(spark, [(7, f"text {i}", "", "", 0) for i in range(200)] + [(8, "last", "", "", 0)]), path, files=4)
    assert len(hot) > 2 and sorted(len(x) for x in sstable.lookup(hot, 7)) == sorted(len(whole(f"text {i}")) for i in range(200)) and len(sstable.lookup(hot, 8)) == 1
    read = sorted((r["start"], r["n_tokens"]) for r in sstable.read_tokens(spark, hot).collect())
    assert [s for s, _ in read] == [sum(n for _, n in read[:i]) for i in range(len(read))]
    nulls = sstable.write_tokens(frame(spark, [(None, "x", "", "", 0), (None, None, "", "", 0), (1, "y", "", "", 0)]), path)
    assert [r["doc_id"] for r in sstable.read_tokens(spark, nulls).orderBy("start").collect()] == [None, None, 1]


def alike_words():
    """Two words of 1,024 letters that a polynomial modulo 2**64 does not tell apart: a Thue-Morse word and its complement."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_that_share_a_hash_are_told_apart(library, vocabulary):
    a, b = alike_words()
    buf = np.frombuffer((a + b + a + "xyz").encode(), np.uint8)
    starts, ends = np.array([0, 1024, 2048, 3072]), np.array([1024, 2048, 3072, 3075])
    hashes = pretoken.span_hashes(buf, starts, ends)
    assert hashes[0] == hashes[1]
    first, inverse = pretoken.distinct_spans(buf, starts, ends)
    assert inverse[0] == inverse[2] != inverse[1] and len(first) == 3
    texts = [a, b, f"{a} {b} {a}", b + " tail"]
    got = bpe.Encoder(vocabulary).encode_batch(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [vocabulary.decode(g) for g in got] == texts


def test_counts_of_words_that_share_a_hash(spark):
    a, b = alike_words()
    counts = {bytes(r["word"]): r["n"] for r in bpe.count_words(frame(spark, [(0, f"{a}\n{b}\n{a}", "", "", 0)]).coalesce(1)).collect()}
    assert counts[a.encode()] == 2 and counts[b.encode()] == 1


def test_segments_have_the_words_of_the_text(library, vocabulary, monkeypatch):
    rng = random.Random(4)
    text = "".join(rng.choices("ab'sre09 \n\t　.,é中", k=20_000)) + "x" * 3000 + "  \n end"
    pieces = list(pretoken.segments(text, 300))
    assert "".join(pieces) == text and len(pieces) > 50
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 300)
    monkeypatch.setattr(bpe, "segments", lambda t: pretoken.segments(t, 300))
    texts = [text, "short", text[::-1] + "<|endoftext|>" * 40, ""]
    assert [g.tolist() for g in bpe.Encoder(vocabulary).encode_batch(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_lexicon_of_one_full_bin(spark):
    """Words that all occur equally often don't leave the lexicon empty."""
    df = frame(spark, [(i, " ".join(f"w{k}z" for k in range(900)), "", "", 0) for i in range(3)])
    assert 200 <= len(bpe.frequent_words(df, 300)) <= 300


def test_a_very_long_text_in_bounded_memory(vocabulary):
    """50 MB of text; the peak is that of a child process."""
    import subprocess
    import sys

    code = (
        "import resource\n"
        "from paperloom.llm import bpe, ngram, quality\n"
        "from paperloom.llm.registry import vocabulary_path\n"
        "v = bpe.Vocabulary(vocabulary_path())\n"
        "t = ' '.join(f'word{i % 70001} and more, of é it' for i in range(1_800_000))\n"
        "assert len(t.encode()) > 50_000_000\n"
        "ids = bpe.Encoder(v).encode_batch([t])[0]\n"
        "assert v.decode(ids) == t\n"
        "assert len(ngram.shingle_sets([t])[0]) > 300_000\n"
        "looks = quality.look([t])\n"
        "assert looks.n[0] == 6 * 1_800_000 and len(quality.features(looks)[0]) > 1000\n"
        "print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)\n"
    )
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=600, check=False)
    assert done.returncode == 0, done.stderr
    print("peak MB", done.stdout)
    assert int(done.stdout) < 1800
