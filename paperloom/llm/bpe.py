"""Byte-level BPE: a minimal acyclic transducer of frequent words, memory-mapped, and exact merges for all other words.

The words of all documents are counted, and the most frequent LEXICON_WORDS are compiled into an automaton that shares prefixes
and suffixes; the numbers on its edges add up to a word's rank in the sorted lexicon, under which its ids stand. The driver
sends the automaton, whose size that parameter bounds, to the executors, where each worker maps it from a local file. A batch's
distinct words walk the automaton together, one byte at a time; those that it does not accept are merged, also together.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import heapq
import json
import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretoken import CHUNK_CHARS, distinct_spans, gather_spans, segments, split_words
from .shared import cut

LEXICON_WORDS = 50_000
#: Slices of the words with like counts of which only a part enters the lexicon.
SLICES = 1024
#: Bytes of a word of the lexicon, at most.
LEXICON_WORD = 64
#: Words up to so many bytes are merged together; longer ones are merged one by one.
TABLE_BYTES = (4, 8, 12, 16, 24, 32, 64, 96, 128, 192, 256)
#: Ids that are decoded at once.
DECODE_IDS = 1 << 18
#: The automaton is refused beyond this size, as it goes to every executor.
MAX_LEXICON_BYTES = 64 << 20
NONE, PAD = np.int32(2**31 - 1), 0xFFFF


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges") or spec.get("normalizer"):
            raise ValueError("a plain byte-level BPE vocabulary is needed")
        ids, chars = model["vocab"], byte_chars()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = re.compile("(" + ("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)") + ")")
        to_byte = {c: b for b, c in enumerate(chars)}
        n = max([*ids.values(), *self.special.values()]) + 1
        if n > PAD:
            raise ValueError("more ids than two bytes hold")
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([ids[c] for c in chars], np.uint16)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, made = (np.array([ids[x] for x in side], np.uint32) for side in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs]))
        key = left << np.uint32(16) | right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank, self.made = key[order], order.astype(np.int32), made.astype(np.uint16)
        lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_at, self.flat_len = np.cumsum(lengths) - lengths, lengths

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, NONE where there is none."""
        key = a.astype(np.uint32) << np.uint32(16) | b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NONE)

    def merge_word(self, word: bytes) -> list[int]:
        """The ids of one word, by a heap of its pairs."""
        ids = [int(x) for x in self.byte_ids[np.frombuffer(word, np.uint8)]]
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self.ranks(np.array(ids[:-1], np.uint32), np.array(ids[1:], np.uint32))) if r != NONE]
        heapq.heapify(heap)
        pair = {int(k): int(r) for k, r in zip(self.pair_key, self.pair_rank, strict=True)} if n > 64 and not hasattr(self, "_pair") else getattr(self, "_pair", None)
        if pair is not None:
            self._pair = pair

        def push(i: int) -> None:
            j = after[i]
            if j >= 0:
                r = pair.get(ids[i] << 16 | ids[j]) if pair else next((int(x) for x in self.ranks(np.array([ids[i]]), np.array([ids[j]])) if x != NONE), None)
                if r is not None:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.made[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return [x for x in ids if x >= 0]

    def merge_words(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word). Words of like length are rows of a table; each round merges every row's best pair."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for width in TABLE_BYTES:
            rows = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(rows):
                self._merge_table(buf, starts[rows], lengths[rows], width, rows, found)
        for i in np.flatnonzero(lengths > low):
            ids = self.merge_word(buf[starts[i] : starts[i] + lengths[i]].tobytes())
            found.append((np.array([i]), np.array([len(ids)]), np.array(ids, np.uint16)))
        counts = np.zeros(len(starts), np.int64)
        if not found:
            return np.zeros(0, np.uint16), counts
        which = np.concatenate([f[0] for f in found])
        n = np.concatenate([f[1] for f in found])
        flat = np.concatenate([f[2] for f in found])
        counts[which] = n
        at = np.zeros(len(starts), np.int64)
        at[which] = np.cumsum(n) - n
        return gather_spans(flat, at, counts), counts

    def _merge_table(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, rows: np.ndarray, found: list) -> None:
        column = np.arange(width)
        there = column < lengths[:, None]
        ids = np.where(there, self.byte_ids[buf[np.minimum(starts[:, None] + column, len(buf) - 1)]], PAD).astype(np.uint16)
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            rank = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), NONE)
            done = rank == NONE
            if done.any():
                over = ids[done]
                real = over != PAD
                found.append((rows[done], real.sum(axis=1), over[real]))
                if done.all():
                    return
                go = ~done
                ids, ranks, rows, best, rank = ids[go], ranks[go], rows[go], best[go], rank[go]
            n, w = ids.shape
            row = np.arange(n)
            ids[row, best] = self.made[rank]
            keep = np.ones((n, w), bool)
            keep[row, best + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[row, best] = False
            ranks = ranks[keep].reshape(n, w - 2)
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.ranks(ids[left, best[left] - 1], ids[left, best[left]])
            right = np.flatnonzero(best < w - 2)
            ranks[right, best[right]] = self.ranks(ids[right, best[right]], ids[right, best[right] + 1])

    def decode(self, ids: np.ndarray) -> str:
        pieces = (ids[i : i + DECODE_IDS] for i in range(0, len(ids), DECODE_IDS))
        return b"".join(gather_spans(self.flat, self.flat_at[p], self.flat_len[p]).tobytes() for p in pieces).decode("utf-8", "replace")


class Transducer:
    """A minimal acyclic automaton whose edge numbers add up to a word's rank, and the ids of every rank."""

    FIELDS = (("edges", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.bool_), ("ids_at", np.int64), ("ids", np.uint16))

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @classmethod
    def compile(cls, words: Iterable[bytes], vocabulary: Vocabulary) -> Transducer:
        words = sorted(set(words) - {b""})
        # A state is [edges {byte: state}, final, number]; states below the last word's path are shared when they are equal.
        root: list = [{}, False, 0]
        register: dict[tuple, list] = {}
        path: list[tuple[list, int, list]] = []
        order: list[list] = []

        def settle(down_to: int) -> None:
            while len(path) > down_to:
                parent, byte, child = path.pop()
                key = (child[1], tuple((b, s[2]) for b, s in child[0].items()))
                known = register.get(key)
                if known is None:
                    child[2] = len(order) + 1
                    order.append(child)
                    register[key] = child
                else:
                    parent[0][byte] = known

        last = b""
        for word in words:
            shared = len(os.path.commonprefix((word, last)))
            settle(shared)
            node = path[-1][2] if path else root
            for byte in word[shared:]:
                child: list = [{}, False, -1]
                node[0][byte] = child
                path.append((node, byte, child))
                node = child
            node[1] = True
            last = word
        settle(0)
        states = [root, *order]
        below = [0] * len(states)
        for s in [*order, root]:
            below[s[2]] = s[1] + sum(below[t[2]] for t in s[0].values())
        edges, targets, outputs = [], [], []
        for s in states:
            passed = int(s[1])
            for byte, t in s[0].items():
                edges.append(s[2] << 8 | byte)
                targets.append(t[2])
                outputs.append(passed)
                passed += below[t[2]]
        buf = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        ids, counts = vocabulary.merge_words(buf, np.cumsum(lengths) - lengths, lengths)
        at = np.zeros(len(words) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        return cls({"edges": np.array(edges, np.int64), "targets": np.array(targets, np.int32), "outputs": np.array(outputs, np.int32), "final": np.array([s[1] for s in states]), "ids_at": at, "ids": ids})

    def to_bytes(self) -> bytes:
        parts, sizes = [], []
        for name, kind in self.FIELDS:
            raw = np.ascontiguousarray(getattr(self, name), kind).tobytes()
            sizes.append(len(raw))
            parts.append(raw + b"\0" * (-len(raw) % 8))
        return np.array(sizes, np.int64).tobytes() + b"".join(parts)

    @classmethod
    def map(cls, data: bytes) -> Transducer:
        """Mapped from a file in this machine's temporary folder, which goes with the mapping."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(mapped, np.int64, len(cls.FIELDS))
        at, arrays = 8 * len(cls.FIELDS), {}
        for (name, kind), size in zip(cls.FIELDS, sizes, strict=True):
            arrays[name] = np.frombuffer(mapped, kind, int(size) // np.dtype(kind).itemsize, at)
            at += int(size) + int(-size % 8)
        return cls(arrays)

    def find(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The rank of each word, -1 where the automaton does not accept it."""
        found = np.full(len(starts), -1, np.int64)
        if not len(self.edges):
            return found
        live, state, total, step = np.arange(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), 0
        while len(live):
            ended = lengths[live] == step
            if ended.any():
                ok = ended & self.final[state]
                found[live[ok]] = total[ok]
                live, state, total = live[~ended], state[~ended], total[~ended]
            key = state << 8 | buf[starts[live] + step]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            at = at[hit]
            live, state, total, step = live[hit], self.targets[at].astype(np.int64), total[hit] + self.outputs[at], step + 1
        return found


class Encoder:
    """Texts to ids, exactly as the tokenizers library does with the same file."""

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer | None = None):
        self.vocabulary, self.transducer = vocabulary, transducer

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; texts go together up to CHUNK_CHARS characters, and longer ones in segments."""
        out: list[np.ndarray] = []
        chunk: list[str] = []
        size = 0
        for text in texts:
            if chunk and size + len(text) > CHUNK_CHARS:
                out += self._chunk(chunk)
                chunk, size = [], 0
            chunk.append(text)
            size += len(text)
        return out + (self._chunk(chunk) if chunk else [])

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        special = self.vocabulary.special
        if not any(s in t for t in texts for s in special):
            return self._plain(texts)
        pieces: list[str | int] = []
        ends = []
        for text in texts:
            pieces += self._pieces(text)
            ends.append(len(pieces))
        ids = iter(self._plain([p for p in pieces if isinstance(p, str)]))
        arrays = [next(ids) if isinstance(p, str) else np.array([p], np.uint16) for p in pieces]
        return [np.concatenate(arrays[a:b]) if b > a else np.zeros(0, np.uint16) for a, b in zip([0, *ends], ends, strict=False)]

    def _pieces(self, text: str) -> list[str | int]:
        special = self.vocabulary.special
        return [special.get(p, p) for p in self.vocabulary.special_split.split(text) if p]

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if len(texts) == 1 and len(texts[0]) > CHUNK_CHARS:
            pieces = list(segments(texts[0]))
            if len(pieces) > 1:
                return [np.concatenate([self._plain([p])[0] for p in pieces])]
        elif max(map(len, texts), default=0) > CHUNK_CHARS:
            return [self._plain([t])[0] for t in texts]
        words = split_words(texts)
        first, inverse = distinct_spans(words.buf, words.starts, words.ends)
        starts, lengths = words.starts[first], (words.ends - words.starts)[first]
        counts, at, flat = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.zeros(0, np.uint16)
        unseen = np.arange(len(first))
        if self.transducer is not None:
            t = self.transducer
            rank = t.find(words.buf, starts, lengths)
            seen, unseen = np.flatnonzero(rank >= 0), np.flatnonzero(rank < 0)
            counts[seen], at[seen] = t.ids_at[rank[seen] + 1] - t.ids_at[rank[seen]], t.ids_at[rank[seen]]
            flat = t.ids
        ids, n = self.vocabulary.merge_words(words.buf, starts[unseen], lengths[unseen])
        counts[unseen], at[unseen] = n, len(flat) + np.cumsum(n) - n
        per_word = counts[inverse]
        all_ids = gather_spans(np.concatenate([flat, ids]), at[inverse], per_word)
        ends = np.zeros(len(per_word) + 1, np.int64)
        np.cumsum(per_word, out=ends[1:])
        edges = ends[words.first]
        return [all_ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def release() -> None:
    """Give memory that arrays have left behind back to the machine; a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most so many rows, and of so many bytes in their largest column unless a single row has more."""
    try:
        for b in batches:
            sizes = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns if pa.types.is_binary(c.type) or pa.types.is_string(c.type)]
            through = np.cumsum(np.max(sizes, axis=0)) if sizes else np.zeros(b.num_rows, np.int64)
            at = 0
            while at < b.num_rows:
                before = through[at - 1] if at else 0
                end = min(at + rows, b.num_rows, max(at + 1, int(np.searchsorted(through, before + most, side="right"))))
                yield b.slice(at, end - at)
                at = end
    finally:
        release()


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary), n: all pre-tokens of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            texts = _texts(b.column(0))
            for piece in segments(texts[0]) if len(texts) == 1 else [texts]:
                w = split_words([piece] if isinstance(piece, str) else piece)
                if not len(w.starts):
                    continue
                first, inverse = distinct_spans(w.buf, w.starts, w.ends)
                n, lengths = np.bincount(inverse), (w.ends - w.starts)[first]
                offsets = np.zeros(len(first) + 1, np.int32)
                np.cumsum(lengths, out=offsets[1:])
                data = gather_spans(w.buf, w.starts[first], lengths)
                words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
                yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int, text_col: str = "text") -> list[bytes]:
    """At most ``most`` words, the most frequent in front.

    Words are counted in bins of equal ratio of their counts, of which there are at most a few hundred, and bins are taken from the
    top while they fit. Of the first one that does not, slices by the words' hash are taken while they fit. So no task hands the
    driver more than its part of the words that are taken. Words that occur once are not taken.
    """
    counts = count_words(docs, text_col).where((F.col("n") > 1) & (F.length("word") <= LEXICON_WORD))
    counts = cut(counts.select("word", F.floor(F.log2("n") * 8).cast("int").alias("bin"), F.pmod(F.xxhash64("word"), F.lit(SLICES)).cast("int").alias("slice")), "words")
    taken, lowest, partly = 0, None, None
    for r in counts.groupBy("bin").agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():
        if taken + r["words"] > most:
            partly = r["bin"]
            break
        taken, lowest = taken + r["words"], r["bin"]
    wanted = F.lit(False) if lowest is None else F.col("bin") >= lowest
    if partly is not None:
        upto = 0
        for r in counts.where(F.col("bin") == partly).groupBy("slice").agg(F.count("*").alias("words")).orderBy("slice").collect():
            if taken + r["words"] > most:
                break
            taken, upto = taken + r["words"], r["slice"] + 1
        wanted = wanted | ((F.col("bin") == partly) & (F.col("slice") < upto))
    return [bytes(r[0]) for r in counts.where(wanted).select("word").collect()]


def compile_lexicon(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, text_col: str = "text") -> bytes:
    """The automaton of the most frequent words of all texts; words is the bound on what reaches the driver."""
    data = Transducer.compile(frequent_words(docs, words, text_col), Vocabulary(vocabulary_path)).to_bytes()
    if len(data) > MAX_LEXICON_BYTES:
        raise ValueError(f"{len(data)} bytes of lexicon: lower the number of words")
    return data


_open: dict[tuple, Encoder] = {}


def worker_encoder(vocabulary_path: str, lexicon: bytes | None = None) -> Encoder:
    """This worker's encoder; the lexicon is mapped once."""
    key = (vocabulary_path, hashlib.sha256(lexicon or b"").digest())
    if key not in _open:
        _open.clear()
        _open[key] = Encoder(Vocabulary(vocabulary_path), Transducer.map(lexicon) if lexicon else None)
    return _open[key]


def encode(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for every row of docs.

    Null and empty texts have no ids. Special tokens inside a text get their own id, as in the library. Long texts and words are
    encoded whole. Repeated rows give repeated rows; an empty table gives an empty one; other columns are ignored.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(compile_lexicon(docs, vocabulary_path, words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary_path, lexicon.value)
        for b in small_batches(batches):
            ids = encoder.encode_batch(_texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, text for every row of (doc_id, ids); null ids decode to the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_encoder(vocabulary_path).vocabulary
        for b in batches:
            texts = [vocabulary.decode(np.asarray(i or [], np.int64)) for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary_path: str, words: int = LEXICON_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, where the ids never leave the worker.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers, decoded_sha256 over the decoded text in UTF-8. Nulls,
    repeats and other columns as in ``encode``.
    """
    lexicon = docs.sparkSession.sparkContext.broadcast(compile_lexicon(docs, vocabulary_path, words, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary_path, lexicon.value)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for b in small_batches(batches):
            ids = encoder.encode_batch(_texts(b.column(1)))
            digests = [sha(x.astype("<u4").tobytes()) for x in ids]
            decoded = [sha(encoder.vocabulary.decode(x).encode()) for x in ids]
            columns = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(digests), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
