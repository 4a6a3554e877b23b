"""Quality classifier from weak labels.

1. LABELLERS look at each whole text and vote good, bad or nothing; they overlap and none is right alone.
2. The votes of all documents are counted by pattern, of which there are at most 3 to the number of labellers. Expectation
   maximisation over these counts estimates each labeller's accuracy on either class, and every pattern's posterior.
3. The posteriors of a bounded sample of documents (SAMPLE_DOCS, SAMPLE_FEATURES) are the labels of a linear scorer on hashed
   features of words.
4. The scorer judges every document; its weights, 2**HASH_BITS of them, are all that is broadcast.

A word ends at a blank; of scripts without spaces (U+3000 to U+9FFF) every character is a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _texts, small_batches
from .pretoken import mix64, span_hashes
from .shared import cut

#: Documents on which the scorer is trained, at most about so many.
SAMPLE_DOCS = 6000
#: Features of all these documents together, at most; a document has 2**HASH_BITS at most.
SAMPLE_FEATURES = 1 << 22
HASH_BITS = 14
BAD, GOOD, ABSTAIN = 0, 1, 2
_BYTES = np.arange(256)
_BLANK = np.isin(_BYTES, [0x20, *range(0x09, 0x0E)])
#: First bytes of U+3000 to U+9FFF, which take three each.
_WIDE = (_BYTES >= 0xE3) & (_BYTES <= 0xE9)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
_SYMBOL = np.isin(_BYTES, [ord(c) for c in "#$%&*@^~=+<>{}[]\\_`"])
_MARK = ((_BYTES > 0x20) & (_BYTES < 0x7F)) & ~_LETTER & ~((_BYTES >= 0x30) & (_BYTES <= 0x39))
#: 0 other, 1 lower letter or above ASCII, 2 upper letter, 3 digit, 4 sentence mark, 5 symbol, 6 bar, 7 exclamation mark
_SHAPE = np.select(
    [_UPPER, _LETTER | (_BYTES >= 0x80), (_BYTES >= 0x30) & (_BYTES <= 0x39), np.isin(_BYTES, [ord(c) for c in ".,;:?"]), _SYMBOL, _BYTES == ord("|"), _BYTES == ord("!")], [2, 1, 3, 4, 5, 6, 7], 0
)


class Looks(NamedTuple):
    """Per text: words, and shares of what the labellers look at; per word: hash, shape and whether it repeats the one before."""

    first: np.ndarray
    n: np.ndarray
    shares: dict[str, np.ndarray]
    words: np.ndarray
    shapes: np.ndarray
    repeats: np.ndarray


def _seen(raw: list[bytes]) -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """(where each text's words begin, sums of characters of each text, what is seen of each word)."""
    buf = np.frombuffer(b"\n" + b"\n".join([*raw, b""]), np.uint8)
    text_at = 1 + np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))])
    blank = _BLANK[buf]
    wide = _WIDE[buf]
    begins, stops = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    begins[1:] = ~blank[1:] & (blank[:-1] | wide[1:])
    begins[3:] |= ~blank[3:] & wide[:-3]
    stops[1:] = ~blank[:-1] & (blank[1:] | begins[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    per_text = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[buf], dtype=np.int32)])[text_at]).astype(float)
    chars = {"letters": per_text(_LETTER), "chars": per_text(~_BLANK), "upper": per_text(_UPPER), "symbols": per_text(_SYMBOL), "marks": per_text(_MARK)}
    first_shape, last_shape = _SHAPE[buf[starts]], _SHAPE[buf[ends - 1]]
    lettered = np.concatenate([[0], np.cumsum((_LETTER | (_BYTES >= 0x80))[buf], dtype=np.int32)])
    words = {
        "words": span_hashes(buf, starts, ends),
        "shapes": (first_shape * 64 + last_shape * 8 + np.minimum((ends - starts) // 3, 7)).astype(np.int16),
        "symbol_ends": last_shape == 5,
        "bangs": last_shape == 7,
        "bars": (first_shape == 6) & (ends - starts == 1),
        "wordless": lettered[ends] == lettered[starts],
    }
    return np.searchsorted(starts, text_at), chars, words


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Pieces of about PIECE_BYTES that end where a word ends."""
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        while end < len(raw) and not _BLANK[raw[end]] and not _WIDE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def look(texts: list[str]) -> Looks:
    """What labellers and scorer see of whole texts; a text above PIECE_BYTES is looked at in pieces that divide no word."""
    raw = [t.encode() for t in texts]
    if any(len(r) > PIECE_BYTES for r in raw):
        parts = [_seen([p]) for r in raw for p in (_pieces(r) if len(r) > PIECE_BYTES else [r])]
        owner = np.repeat(np.arange(len(raw)), [max(1, sum(1 for _ in _pieces(r))) if len(r) > PIECE_BYTES else 1 for r in raw])
        counts = np.bincount(owner, [p[0][1] for p in parts], len(raw)).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(counts)])
        chars = {k: np.bincount(owner, [p[1][k][0] for p in parts], len(raw)) for k in parts[0][1]}
        seen = {k: np.concatenate([p[2][k] for p in parts]) for k in parts[0][2]}
    else:
        first, chars, seen = _seen(raw)
    n, words = np.diff(first), seen["words"]
    repeats, far = np.zeros(len(words), bool), np.zeros(len(words), bool)
    repeats[1:] = words[1:] == words[:-1]
    repeats[first[:-1][n > 0]] = False
    far[2:] = words[2:] == words[:-2]
    # Words are counted as distinct within windows of a text, or the share would fall with the length of any text.
    place = np.arange(len(words)) - np.repeat(first[:-1], n)
    far[place < 2] = False
    window = np.repeat(np.cumsum(n // WINDOW + 1) - n // WINDOW - 1, n) + place // WINDOW
    new = np.ones(len(words), bool)
    order = np.lexsort((words, window))
    new[1:] = (words[order][1:] != words[order][:-1]) | (window[order][1:] != window[order][:-1])
    distinct = np.zeros(len(words), bool)
    distinct[order] = new
    per_word = lambda values: np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[first]) / np.maximum(n, 1)
    shares = {
        "repeats": per_word(repeats),
        "repeats_far": per_word(far),
        "distinct": per_word(distinct),
        "upper": chars["upper"] / np.maximum(chars["letters"], 1),
        "symbols": chars["symbols"] / np.maximum(n, 1),
        "symbol_ends": per_word(seen["symbol_ends"]),
        "bangs": per_word(seen["bangs"]),
        "bars": per_word(seen["bars"]),
        "marks": chars["marks"] / np.maximum(chars["chars"], 1),
        "wordless": per_word(seen["wordless"]),
    }
    return Looks(first, n, shares, words, seen["shapes"], repeats)


#: (what is looked at, bad above or below, good on the other side of); between the two, and on texts of a few words, no vote.
LABELLERS = (
    ("repeats", ">", 0.25, 0.05),
    ("repeats_far", ">", 0.25, 0.05),
    ("distinct", "<", 0.15, 0.40),
    ("upper", ">", 0.60, 0.30),
    ("symbols", ">", 0.40, 0.08),
    ("symbol_ends", ">", 0.25, 0.03),
    ("bangs", ">", 0.30, 0.03),
    ("bars", ">", 0.15, 0.02),
    ("marks", ">", 0.08, 0.06),
    ("wordless", ">", 0.15, 0.05),
)
LEAST_WORDS = 20
#: Words within which a word counts as distinct once.
WINDOW = 500
#: Bytes of a text that are looked at together.
PIECE_BYTES = 1 << 22


def votes(looks: Looks) -> np.ndarray:
    """A row of votes for each text."""
    out = np.full((len(looks.n), len(LABELLERS)), ABSTAIN, np.int64)
    for k, (what, side, bad, good) in enumerate(LABELLERS):
        x = looks.shares[what] * (1 if side == ">" else -1)
        bad, good = (bad, good) if side == ">" else (-bad, -good)
        out[x <= good, k] = GOOD
        out[x > bad, k] = BAD
    out[looks.n < LEAST_WORDS] = ABSTAIN
    return out


def features(looks: Looks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, value): hashed words, word shapes, and shapes with repetition; values are roots of shares of the words."""
    owner = np.repeat(np.arange(len(looks.n)), looks.n)
    shape = looks.shapes.astype(np.uint64)
    mask = np.uint64((1 << HASH_BITS) - 1)
    places, counts = [], []
    for kind in (looks.words, mix64(shape + np.uint64(1 << 40)), mix64(shape // np.uint64(8) % np.uint64(8) * np.uint64(2) + looks.repeats.astype(np.uint64) + np.uint64(1 << 41))):
        p, c = np.unique(owner << HASH_BITS | (kind & mask).astype(np.int64), return_counts=True)
        places.append(p)
        counts.append(c)
    place, at = np.unique(np.concatenate(places), return_inverse=True)
    count = np.bincount(at, np.concatenate(counts), len(place))
    text = place >> HASH_BITS
    return text, place & ((1 << HASH_BITS) - 1), np.sqrt(count / np.maximum(looks.n[text], 1))


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def votes_of(pattern: np.ndarray) -> np.ndarray:
    return pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


class Labels(NamedTuple):
    prior: float
    #: accuracy[c, k]: how often labeller k is right when it votes on a document of class c.
    accuracy: np.ndarray
    posterior: dict[int, float]


def estimate(counts: dict[int, int], rounds: int = 100) -> Labels:
    """Expectation maximisation over the counts of vote patterns; starts from the documents without a bad vote.

    How often each labeller votes bad, good or nothing is estimated for either class, with half a vote each as a prior.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], float)
    v = votes_of(patterns)
    p = (v != BAD).all(axis=1).astype(float)
    voteless = (v == ABSTAIN).all(axis=1)
    table = np.zeros((2, v.shape[1], 3))
    prior = 0.5
    for _ in range(rounds):
        both = np.stack([1 - p, p]) * np.where(voteless, 0, weight)
        prior = float((both[1].sum() + 1) / (both.sum() + 2))
        for value in (BAD, GOOD, ABSTAIN):
            table[:, :, value] = both @ (v == value) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        like = np.log([1 - prior, prior])[:, None] + np.log(np.take_along_axis(table[:, None], v[None, :, :, None], axis=3)[..., 0]).sum(axis=2)
        new = 1 / (1 + np.exp(np.clip(like[0] - like[1], -50, 50)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    said = table[:, :, :2].sum(axis=2)
    accuracy = np.stack([table[BAD, :, BAD] / said[BAD], table[GOOD, :, GOOD] / said[GOOD]])
    return Labels(prior, accuracy, dict(zip(patterns.tolist(), np.where(voteless, prior, p).tolist(), strict=True)))


def train(row: np.ndarray, slot: np.ndarray, value: np.ndarray, target: np.ndarray, times: np.ndarray, rounds: int = 150, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic scorer, the bias last, by full gradients with a moving scale; each text counts ``times``."""
    size = (1 << HASH_BITS) + 1
    w, mean, square = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, rounds + 1):
        z = np.bincount(row, value * w[slot], len(target)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * times / max(times.sum(), 1)
        g = np.append(np.bincount(slot, value * error[row], size - 1), error.sum()) + decay * w
        mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w


class Model(NamedTuple):
    labels: Labels
    weights: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Labels from the votes of all documents, and the scorer from a sample that a hash of id and text draws.

    Of rows that repeat id and text the sample holds one, with their number; so many copies don't make it larger. Where its
    documents are so long that they have more than SAMPLE_FEATURES features, it ends, in the order of the hash, before that. Null texts vote
    as empty ones do, on nothing. An empty table gives a model that knows nothing. Other columns are ignored.
    """
    n = docs.count()
    share = min(1.0, sample_docs / max(n, 1))
    key = F.xxhash64(F.col(id_col), F.col(text_col), F.lit(7))
    drawn = F.when(F.pmod(key, F.lit(2**30)) < share * 2**30, key)
    rows = docs.select(drawn.alias("drawn"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            looks = look(_texts(b.column(1)))
            patterns, wanted = pattern_of(votes(looks)), np.asarray(b.column(0).is_valid())
            slots: list = [None] * b.num_rows
            values: list = [None] * b.num_rows
            if wanted.any():
                text, slot, value = features(looks)
                at = np.searchsorted(text, np.arange(b.num_rows + 1))
                for i in np.flatnonzero(wanted):
                    slots[i], values[i] = slot[at[i] : at[i + 1]], value[at[i] : at[i + 1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(patterns), pa.array(slots, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], names=["drawn", "pattern", "slots", "shares"])

    voted = cut(rows.mapInArrow(run, "drawn long, pattern long, slots array<long>, shares array<double>"), "votes")
    labels = estimate({r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()})
    one = voted.where("drawn IS NOT NULL").groupBy("drawn").agg(F.min(F.struct("pattern", "slots", "shares")).alias("seen"), F.count("*").alias("n"))
    one = cut(one.select("drawn", "seen.*", "n"), "sample")
    held = one.select("drawn", F.size("slots").alias("features")).toArrow().sort_by("drawn")
    fits = int((np.cumsum(held.column("features").to_numpy()) <= SAMPLE_FEATURES).sum())
    sample = (one.where(F.col("drawn") <= held.column("drawn")[fits - 1].as_py()) if fits else one.limit(0)).toArrow().sort_by("drawn")
    column = lambda name: sample.column(name).combine_chunks()
    lengths = column("slots").value_lengths().to_numpy()
    target = np.array([labels.posterior[p] for p in column("pattern").to_pylist()])
    return Model(labels, train(np.repeat(np.arange(len(target)), lengths), column("slots").flatten().to_numpy(), column("shares").flatten().to_numpy(), target, column("n").to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, score, weak_score, kept for every row.

    score is the scorer's probability of good, weak_score the labellers' posterior; a document is kept from 0.5 up. Texts without
    a word, null and empty ones among them, have score 0. Repeated rows are judged alike; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.weights, model.labels.posterior, model.labels.prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior, prior = sent.value
        for b in small_batches(batches, 512):
            looks = look(_texts(b.column(1)))
            text, slot, value = features(looks)
            z = np.bincount(text, value * weights[slot], b.num_rows) + weights[-1]
            p = np.where(looks.n > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)
            weak = [posterior.get(x, prior) for x in pattern_of(votes(looks)).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(looks.n), pa.array(p), pa.array(weak, pa.float64()), pa.array(p >= 0.5)], names=["doc_id", "n_words", "score", "weak_score", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, score double, weak_score double, kept boolean")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that the scorer keeps, with all their columns, whatever their names.

    Null, empty and blank texts go; repeated rows are judged alike, null ids as any other; an empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for b in small_batches(batches, 512):
            looks = look(_texts(b.column(at)))
            text, slot, value = features(looks)
            z = np.bincount(text, value * weights[slot], b.num_rows) + weights[-1]
            yield b.filter(pa.array((looks.n > 0) & (z >= 0)))

    return docs.mapInArrow(run, docs.schema)
