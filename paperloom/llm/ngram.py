"""Exact similarity self-join on word n-grams with a token-group matrix.

Documents are compared by their sets of hashed 5-word shingles; two link when 100 x intersection >= 80 x union.

1. Classes. Each text gives the size of its set, a 128-bit sum over it, and a prefix: its least shingles in the order of the
   hash. Equal sets form a class, counted before they move; only a class's first document goes on.
2. Filter. Linked sets of sizes n and m share at least min(slack(n), slack(m)) shingles of their prefixes, and m >= 0.8 n. The
   prefixes are dealt over ranges of shingles, which tell how many of a document's shingles occur elsewhere; a document with too
   few links with nothing. Passages that many documents share don't suffice, so hardly any pair is ever formed for them.
3. Groups of similar sets. ROUNDS times, sets are hashed to their least shingle under another order, and those that no link has
   reached yet are compared with the most central of the sets that agree, the one whose shingles occur most elsewhere. A set and
   what links with it are a star; copies of a text by the thousand cost a few comparisons each. A star is a group, cut into groups
   of at most GROUP sets; sets in no star are grouped with those that have the same least shingle.
4. Matrix. Shingles are counted by the stars that hold them, and a set's shingles are ordered by that count: one of its first
   n - 0.8 n + 1 is among the first ones of any set that it links with. The matrix has an entry for each of these shingles and each
   group that holds it. Groups of different stars meet where they share an entry, each with those of its sets that have it.
5. Opening. Where two groups meet, the union of the one's shingles bounds the overlap of each set of the other with anything in it:
   only the sets whose overlap with the union reaches 0.8 n open the group, and are compared with what it holds, exactly. Of the
   links only the pairs of stars that they join are kept.
6. Components of those links. Steps 2, 4 and 5 lose nothing, whatever the stars missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import _texts, release, small_batches
from .components import components
from .pretoken import distinct_spans, mix64
from .shared import cut, discard, free_names, pick

WORDS, PERCENT = 5, 80
ROUNDS = 4
#: Sets of a group, at most: as many as the bits of a number tell apart.
GROUP = 63
#: Shingles of one partition in which they are counted.
RANGE_TOKENS = 2_000_000
TOKEN_BYTES = 6
#: Bytes of a text whose words are looked at together.
CHUNK_BYTES = 1 << 22
DIGEST_KEY = b"word shingles"
_BLANKS = (0x20, *range(0x09, 0x0E))
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SPACE = np.zeros(256, bool)
_SPACE[list(_BLANKS)] = True
#: Masks for the first bytes of eight.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def least_overlap(n: int | np.ndarray):
    """Shingles that a set of n shares with any set it links with."""
    return (PERCENT * n + 99) // 100


def slack(n: int | np.ndarray):
    return np.maximum(1, n * 15 // 100)


def prefix_length(n: int | np.ndarray):
    return np.minimum(n, n - least_overlap(n) + slack(n))


def _lanes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers of every word, which together tell it apart: its bytes and length up to eight bytes, and halves of a
    128-bit digest beyond, which is taken once for each kind of word."""
    lengths = ends - starts
    left, right = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    short = lengths <= 8
    n = lengths[short]
    held = np.lib.stride_tricks.sliding_window_view(np.concatenate([buf, np.zeros(8, np.uint8)]), 8)[starts[short]].view("<u8").ravel() & _FIRST_BYTES[n]
    left[short], right[short] = mix64(held ^ _FACTORS[3]), mix64(held * _FACTORS[4] + n.astype(np.uint64))
    long = np.flatnonzero(~short)
    if len(long):
        first, inverse = distinct_spans(buf, starts[long], ends[long])
        at = long[first]
        digests = b"".join(hashlib.blake2b(buf[a:b].tobytes(), digest_size=16, key=DIGEST_KEY).digest() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True))
        halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        left[long], right[long] = halves[inverse, 0], halves[inverse, 1]
    return left, right


def _mixed(left: np.ndarray, right: np.ndarray, span: int, shingles: int) -> np.ndarray:
    """A 64-bit number for each of so many runs of ``span`` words, from their digests in order."""
    acc = np.full(shingles, span, np.uint64)
    for k in range(span):
        acc = (acc ^ (left[k : k + shingles] * _FACTORS[k])) * _FACTORS[(k + 1) % WORDS]
        acc = (acc ^ (acc >> np.uint64(29))) + right[k : k + shingles] * _FACTORS[(k + 2) % WORDS]
    return mix64(acc)


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the words of bytes that end with white space."""
    buf = np.frombuffer(raw.translate(_LOWER), np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([[0], edge])
    return buf, edge[::2], edge[1::2]


def _long_set(raw: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of one long text; words are looked at in pieces that end with a word."""
    left, right, at = [], [], 0
    while at < len(raw):
        cut_at = min((p for p in (raw.find(bytes([c]), at + CHUNK_BYTES) for c in _BLANKS) if p >= 0), default=len(raw))
        for side, found in zip((left, right), _lanes(*_words(raw[at:cut_at] + b"\n")), strict=True):
            side.append(found)
        at = cut_at
    l, r = np.concatenate(left), np.concatenate(right)
    span = min(WORDS, len(l))
    return np.unique(_mixed(l, r, span, len(l) - span + 1)) if span else np.zeros(0, np.uint64)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words go in by their bytes, long ones by a 128-bit keyed digest. Two different shingles share one of the 64-bit hashes by chance only, so
    an overlap of sets of n and m is wrong with a probability of some n x m / 2**64.
    """
    raw = [t.encode() for t in texts]
    if any(len(r) > CHUNK_BYTES for r in raw):
        return [_long_set(r) for r in raw] if len(raw) == 1 else [shingle_sets([t])[0] for t in texts]
    buf, starts, ends = _words(b"\n".join([*raw, b""]))
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in texts]
    text_at = np.concatenate([[0], np.cumsum(np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw)))])
    first = np.searchsorted(starts, text_at).tolist()
    left, right = _lanes(buf, starts, ends)
    full = _mixed(left, right, WORDS, len(left) - WORDS + 1) if len(left) >= WORDS else None
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= WORDS:
            out.append(np.unique(full[a : b - WORDS + 1]))
        else:
            out.append(_mixed(left[a:b], right[a:b], b - a, 1) if b > a else np.zeros(0, np.uint64))
    return out


def _binary(flat: np.ndarray, lengths: np.ndarray, width: int) -> pa.Array:
    """An array of binary values from the bytes of unsigned 64-bit numbers, cut to ``width`` bytes each."""
    data = np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * width, out=offsets[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each value holds) of such an array."""
    values = column.to_pylist()
    lengths = np.fromiter((len(v) // width for v in values), np.int64, len(values))
    raw = np.frombuffer(b"".join(values), np.uint8).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    return wide.view("<u8").ravel(), lengths


def profiles(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, s1, s2, the prefix and a hash of id and text of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            sets = shingle_sets(_texts(b.column(1)))
            n = np.array([len(s) for s in sets], np.int64)
            s1 = [int(mix64(s ^ _FACTORS[0]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            s2 = [int(mix64(s ^ _FACTORS[1]).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            lengths = prefix_length(n)
            flat = np.concatenate([s[:k] for s, k in zip(sets, lengths, strict=True)]) if len(sets) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _binary(flat, lengths, TOKEN_BYTES), b.column(2)], names=["doc_id", "n", "s1", "s2", "prefix", "row_key"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.withColumn("row_key", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, n long, s1 long, s2 long, prefix binary, row_key long")


def _deal(table: DataFrame, tokens: str, width: int, parts: int, keep: list[str]) -> DataFrame:
    """Rows (part, *keep, tokens): each row's tokens dealt over ``parts`` by their value, and gathered by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 2048):
            flat, lengths = _numbers(b.column(len(keep)), width)
            row, part = np.repeat(np.arange(b.num_rows), lengths), (flat % np.uint64(parts)).astype(np.int64)
            place = row * parts + part
            order = np.argsort(place, kind="stable")
            where, counts = np.unique(place, return_counts=True)
            of_row = pa.array(where // parts)
            yield pa.RecordBatch.from_arrays([pa.array((where % parts).astype(np.int32)), *(b.column(i).take(of_row) for i in range(len(keep))), _binary(flat[order], counts, width)], names=["part", *keep, "tokens"])

    schema = "part int, " + ", ".join(f"{k} long" for k in keep) + ", tokens binary"
    return table.select(*keep, tokens).mapInArrow(run, schema).repartitionById(parts, F.col("part"))


def _gather(batches: Iterator[pa.RecordBatch], columns: int, width: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(the columns after part, all tokens, the row of each) of a whole partition."""
    kept: list[list[np.ndarray]] = [[] for _ in range(columns)]
    flats, counts = [], []
    for b in batches:
        flat, lengths = _numbers(b.column(columns + 1), width)
        flats.append(flat)
        counts.append(lengths)
        for i in range(columns):
            kept[i].append(b.column(i + 1).to_numpy(zero_copy_only=False))
    if not flats:
        return [np.zeros(0, np.int64)] * columns, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.concatenate(counts)
    return [np.concatenate(k) for k in kept], np.concatenate(flats), np.repeat(np.arange(len(lengths)), lengths)


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the run, length of the run) for each of the ordered values."""
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    run = np.cumsum(new) - 1
    return run, np.diff(np.append(np.flatnonzero(new), len(ordered)))[run]


def survivors(classes: DataFrame, parts: int) -> DataFrame:
    """(rep, central) of each class whose prefix is shared enough to link with anything; central grows with the sharing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rep, n), tokens, row = _gather(batches, 2, TOKEN_BYTES)
        if len(tokens):
            order = np.argsort(tokens)
            _, length = _runs(tokens[order])
            more = np.where(length > 1, length, 0)
            held_by = np.bincount(row[order], weights=more, minlength=len(rep)).astype(np.int64)
            shared = np.bincount(row[order[length > 1]], minlength=len(rep))
            hit = shared > 0
            del tokens, row, order, length, more
            release()
            yield pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(n[hit]), pa.array(shared[hit].astype(np.int64)), pa.array(held_by[hit])], names=["rep", "n", "shared", "held_by"])

    counted = _deal(classes, "prefix", TOKEN_BYTES, parts, ["rep", "n"]).mapInArrow(run, "rep long, n long, shared long, held_by long")
    smallest = F.floor((F.col("n") * PERCENT + 99) / 100)
    summed = counted.groupBy("rep", "n").agg(F.sum("shared").alias("shared"), F.sum("held_by").alias("held_by"))
    return summed.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(smallest * 15 / 100))).select("rep", F.floor(F.col("held_by") * 1000 / F.col("n")).alias("central"))


def pick_by(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """df joined with a table of ids on its first column, which is called otherwise than df's."""
    first, *more = ids.columns
    out = pick(df, F.col(key) == F.col("picked"), ids.withColumnRenamed(first, "picked"), how)
    return out.select(*df.columns, *more) if how == "inner" else out


def full_sets(docs: DataFrame) -> DataFrame:
    """rep, central, n, the set, and its least shingle under each of ROUNDS other orders, of rows (doc_id, text, central)."""
    names = [f"k{r}" for r in range(max(ROUNDS, 1))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 512):
            sets = shingle_sets(_texts(b.column(1)))
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
            keys = [pa.array([int(mix64(s ^ mix64(np.array([r + 1], np.uint64))).min().view(np.int64)) if len(s) else 0 for s in sets], pa.int64()) for r in range(len(names))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), *keys, _binary(flat, n, 8)], names=["rep", "central", "n", *names, "tokens"])

    return docs.mapInArrow(run, "rep long, central long, n long, " + ", ".join(f"{k} long" for k in names) + ", tokens binary")


def linked(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, a_tokens, b, b_tokens) whose sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            hit = pa.array(np.flatnonzero(ok))
            yield pa.RecordBatch.from_arrays([b.column(0).take(hit), b.column(2).take(hit)], names=["a", "b"])

    sizes = (F.octet_length("a_tokens") * 100 >= F.octet_length("b_tokens") * PERCENT) & (F.octet_length("b_tokens") * 100 >= F.octet_length("a_tokens") * PERCENT)
    return pairs.where(sizes).select("a", "a_tokens", "b", "b_tokens").mapInArrow(run, "a long, b long")


def stars(sets: DataFrame) -> DataFrame:
    """(rep, grp) for the sets that a verified link has joined to others; the others are stars of their own."""
    active, found = sets, sets.sparkSession.createDataFrame([], "a long, b long")
    for r in range(ROUNDS):
        key = f"k{r}"
        small = sets.select("rep", "central", key)
        centres = small.groupBy(key).agg(F.max_by("rep", F.struct(F.col("central"), -F.col("rep"))).alias("b"), F.count("*").alias("c")).where("c > 1")
        centres = cut(centres.select(F.col(key).alias("lk"), "b"), "centres")
        led = pick_by(sets, "rep", centres.select("b").distinct()).select(F.col(key).alias("lk"), F.col("rep").alias("b"), F.col("tokens").alias("b_tokens"))
        led = cut(led, "led")
        pairs = active.select(key, F.col("rep").alias("a"), F.col("tokens").alias("a_tokens")).join(led, (F.col(key) == F.col("lk")) & (F.col("a") != F.col("b")))
        links = cut(linked(pairs), "links")
        discard(centres, led)
        found = found.unionByName(links)
        active = pick_by(active, "rep", links.select("a").distinct(), "left_anti")
    return components(found).select(F.col("node").alias("rep"), F.col("component").alias("grp"))


def rare_shingles(members: DataFrame, parts: int) -> DataFrame:
    """(rep, token): of every set that may link with a set of another star, those of its first shingles that another star holds."""

    def count_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (rep, n, grp), tokens, row = _gather(batches, 3, 8)
        if not len(tokens):
            return
        order = np.lexsort((grp[row], tokens))
        t, g = tokens[order], grp[row][order]
        run, _ = _runs(t)
        new_star = np.concatenate([[True], (t[1:] != t[:-1]) | (g[1:] != g[:-1])])
        held_by = np.bincount(run, weights=new_star).astype(np.uint64)[run]
        shared = held_by > 1
        order, held_by = order[shared], held_by[shared]
        by_row = np.argsort(row[order], kind="stable")
        order, held_by = order[by_row], held_by[by_row]
        which, counts = np.unique(row[order], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(rep[which]), pa.array(n[which]), _binary(tokens[order], counts, 8), _binary(held_by, counts, 8)], names=["rep", "n", "tokens", "held_by"])

    shared = _deal(members, "tokens", 8, parts, ["rep", "n", "grp"]).mapInArrow(count_stars, "rep long, n long, tokens binary, held_by binary")
    shared = shared.groupBy("rep", "n").agg(F.collect_list(F.struct("tokens", "held_by")).alias("pieces"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, 256):
            reps, found = [], []
            for rep, n, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                tokens = np.concatenate([np.frombuffer(p["tokens"], "<u8") for p in pieces])
                held_by = np.concatenate([np.frombuffer(p["held_by"], "<u8") for p in pieces])
                left = int(n - least_overlap(n) + 1 - (n - len(tokens)))
                if left > 0:
                    first = tokens[np.lexsort((tokens, held_by))[:left]]
                    reps.append(np.full(len(first), rep, np.int64))
                    found.append(first.view(np.int64))
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (reps, found)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "token"])

    return shared.mapInArrow(rare, "rep long, token long")


def _open_groups(block: pd.DataFrame) -> pd.DataFrame:
    """The pairs of stars that links join between the sets of two groups, or of one."""
    none = pd.DataFrame({"a": [], "b": []}, dtype="int64")
    q, g = block[block["asks"]], block[~block["asks"]]
    if not len(q):
        q = g
    if not len(g):
        return none
    q_sets, g_sets = ([np.frombuffer(t, "<u8") for t in side["tokens"]] for side in (q, g))
    union = np.unique(np.concatenate(g_sets))
    at = [np.minimum(np.searchsorted(union, s), len(union) - 1) for s in q_sets]
    held = [u[union[u] == s] for u, s in zip(at, q_sets, strict=True)]
    q_n = np.array([len(s) for s in q_sets])
    opened = np.flatnonzero(np.array([len(h) for h in held]) >= least_overlap(q_n))
    if not len(opened):
        return none
    g_n = np.array([len(s) for s in g_sets])
    asked = np.zeros(len(union), bool)
    for i in opened:
        asked[held[i]] = True
    column = np.cumsum(asked) - 1
    g_at = [np.searchsorted(union, s) for s in g_sets]
    g_at = [column[u[asked[u]]] for u in g_at]
    both = np.zeros((len(opened), len(g_sets)), np.float32)
    width = 1 << 15
    for low in range(0, int(asked.sum()), width):
        left, right = np.zeros((len(opened), width), np.float32), np.zeros((len(g_sets), width), np.float32)
        for row, i in enumerate(opened):
            c = column[held[i]] - low
            left[row, c[(c >= 0) & (c < width)]] = 1
        for row, c in enumerate(g_at):
            c = c - low
            right[row, c[(c >= 0) & (c < width)]] = 1
        both += left @ right.T
    both = both.astype(np.int64)
    q_grp, g_grp = q["grp"].to_numpy()[opened], g["grp"].to_numpy()
    ok = (100 * both >= PERCENT * (q_n[opened][:, None] + g_n[None, :] - both)) & (q_grp[:, None] != g_grp[None, :])
    x, y = np.nonzero(ok)
    if not len(x):
        return none
    pairs = np.unique(np.stack([np.maximum(q_grp[x], g_grp[y]), np.minimum(q_grp[x], g_grp[y])]), axis=1)
    return pd.DataFrame({"a": pairs[0], "b": pairs[1]})


def grouped(members: DataFrame) -> DataFrame:
    """members (rep, grp, starred, k0, tokens) with the number of their group, their place in it (0 to 62), and the star if the group
    is a slice of one, in place of starred and k0. Other groups are sets without a star whose least shingles fall together."""
    alone = members.where("NOT starred").count()
    own = F.pmod(F.xxhash64("k0"), F.lit(max(1, 2 * alone // GROUP)))
    keyed = members.select("rep", F.when(F.col("starred"), F.col("grp")).otherwise(own).alias("key"), "starred")
    held = keyed.groupBy(F.col("key").alias("k"), F.col("starred").alias("s")).agg(F.ceil(F.count("*") * 2 / GROUP).alias("slices"))
    sliced = keyed.join(cut(held, "slices"), (F.col("key") == F.col("k")) & (F.col("starred") == F.col("s")))
    sliced = sliced.withColumn("slice", F.pmod(F.xxhash64("rep"), F.col("slices")))
    # Slices hold half a group on average; where chance puts more than GROUP in one, it is several groups.
    at = F.row_number().over(Window.partitionBy("key", "starred", "slice").orderBy("rep")) - 1
    numbered = sliced.withColumn("at", at).select(F.col("rep").alias("r"), F.xxhash64("key", "starred", "slice", F.floor(F.col("at") / GROUP)).alias("block"), F.pmod(F.col("at"), F.lit(GROUP)).alias("place"))
    return members.join(numbered, F.col("rep") == F.col("r")).select("rep", "grp", "tokens", "block", "place", F.when(F.col("starred"), F.col("grp")).alias("star"))


def matrix(rare: DataFrame, members: DataFrame) -> DataFrame:
    """(token, block, star, who): the groups that hold each of the first shingles of their sets, and which of their sets do, as bits."""
    of_set = members.select(F.col("rep").alias("r"), "block", "star", F.expr("shiftleft(1L, place)").alias("bit"))
    return rare.join(of_set, F.col("rep") == F.col("r")).groupBy("token", "block", "star").agg(F.expr("bit_or(bit)").alias("who"))


def meetings(entries: DataFrame) -> DataFrame:
    """(x, y, x_who, y_who), x <= y: the groups that share an entry of the matrix and are not of one star, and with which sets.

    Groups meet, not sets: however many sets of a group have a shingle, it is one row, and their bits are merged on the way.
    """
    held = entries.select(F.col("token").alias("t"), F.col("block").alias("y"), F.col("star").alias("other"), F.col("who").alias("y_who"))
    apart = F.col("star").isNull() | F.col("other").isNull() | (F.col("star") != F.col("other"))
    met = entries.join(held, (F.col("token") == F.col("t")) & (F.col("block") <= F.col("y")) & apart)
    return met.groupBy(F.col("block").alias("x"), "y").agg(F.expr("bit_or(who)").alias("x_who"), F.expr("bit_or(y_who)").alias("y_who"))


def outside_links(sets: DataFrame, groups: DataFrame, parts: int) -> DataFrame:
    """(a, b): stars, and sets without one, that links join."""
    members = sets.select("rep", "n", "k0", "tokens").join(groups.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left")
    members = cut(members.select("rep", "n", F.coalesce("grp", "rep").alias("grp"), F.col("grp").isNotNull().alias("starred"), "k0", "tokens"), "members")
    discard(sets)
    rare = cut(rare_shingles(members, parts), "rare")
    asking = cut(grouped(pick_by(members, "rep", rare.select("rep").distinct())), "groups")
    discard(members)
    entries = cut(matrix(rare, asking), "matrix")
    met = cut(meetings(entries), "meetings")
    has = lambda who: F.expr(f"({who} & shiftleft(1L, place)) <> 0")
    # Of two groups that meet the one with the smaller number asks; within a group all sets ask one another.
    asks = met.where("x <> y").join(asking, (F.col("x") == F.col("block")) & has("x_who")).select("x", "y", "grp", "tokens", F.lit(True).alias("asks"))
    holds = met.join(asking, (F.col("y") == F.col("block")) & has("y_who")).select("x", "y", "grp", "tokens", F.lit(False).alias("asks"))
    links = cut(asks.unionByName(holds).groupBy("x", "y").applyInPandas(_open_groups, "a long, b long"), "links")
    discard(rare, asking, entries, met)
    return links


def joined_by_ids(named: DataFrame, classes: DataFrame, several: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, component) when the classes of one id are joined too, and (known, of_id), the component of each of these ids.

    A component is named by its smallest doc_id, since the numbers of classes may be none.
    """
    rows = named.where("n > 0").join(several.select(F.col("doc_id").alias("s")), F.col("doc_id") == F.col("s"), "left_semi").select("doc_id", F.col("n").alias("rn"), F.col("s1").alias("r1"), F.col("s2").alias("r2")).distinct()
    of_class = rows.join(classes, (F.col("n") == F.col("rn")) & (F.col("s1") == F.col("r1")) & (F.col("s2") == F.col("r2")))
    members = cut(of_class.select("doc_id", "rep"), "members-of-ids")
    # The id speaks as the node of one of its classes: the number of an id may be a class's own.
    meeting = members.groupBy("doc_id").agg(F.min("rep").alias("b"))
    edges = members.join(meeting.withColumnRenamed("doc_id", "m"), F.col("doc_id") == F.col("m")).select(F.col("rep").alias("a"), "b")
    whole = cut(components(edges.unionByName(found.select(F.col("rep").alias("a"), F.col("component").alias("b")))), "joined")
    firsts = classes.select("rep", "first").join(whole, F.col("rep") == F.col("node"), "left").select("rep", "first", F.coalesce("component", "rep").alias("at"))
    firsts = cut(firsts, "firsts")
    least = firsts.groupBy("at").agg(F.min("first").alias("component")).withColumnRenamed("at", "l")
    told = cut(firsts.join(least, F.col("at") == F.col("l")).select("rep", "component"), "of-classes")
    of_id = members.join(told.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r")).groupBy(F.col("doc_id").alias("known")).agg(F.min("component").alias("of_id"))
    return told, of_id


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Words are what stands between ASCII white space, with A-Z lower-cased; texts with fewer than five words have their whole
    sequence as one shingle, null, empty and blank texts have none and link with nothing. component_id is the smallest doc_id that
    links reach. Rows that repeat a doc_id are one node, which has the links of all its texts; n_shingles is that of the row's own.
    Rows with a null doc_id link with nothing. An empty table gives an empty table, other columns are ignored.
    """
    spark = docs.sparkSession
    parts_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    profile = cut(profiles(docs, id_col, text_col), "profiles")
    named = profile.where("doc_id IS NOT NULL")
    key = ["n", "s1", "s2"]
    classes = named.where("n > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "row_key")).alias("row"), F.count("*").alias("size"), F.first("prefix").alias("prefix"))
    classes = cut(classes.select(F.col("row.doc_id").alias("rep"), F.col("row.doc_id").alias("first"), F.col("row.row_key").alias("row_key"), *key, "size", "prefix"), "classes")
    # Ids that stand on rows with different sets.
    several = named.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("least"), F.max(F.struct(*key)).alias("most")).where("least <> most")
    several = cut(several.select("doc_id"), "several")
    repeated = bool(several.take(1))
    if repeated:
        # A class that such an id is the first of takes a number of its own.
        shared = several.select(F.col("doc_id").alias("s"))
        classes = classes.join(shared, F.col("first") == F.col("s"), "left").withColumn("rep", F.when(F.col("s").isNull(), F.col("first")).otherwise(F.xxhash64("first", *key))).drop("s")
        classes = cut(classes, "numbered")
    parts = lambda total: max(min(parts_least, 12), -(-total // RANGE_TOKENS))
    tokens = classes.agg(F.coalesce(F.sum(F.octet_length("prefix")), F.lit(0))).first()[0] // TOKEN_BYTES
    left = survivors(classes, parts(tokens))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if repeated:
        own = left.join(classes.select(F.col("rep").alias("r"), "first", "row_key"), F.col("rep") == F.col("r")).select("row_key", "first", "rep", "central")
        picked = pick_by(rows.withColumn("key", F.xxhash64("doc_id", "text")), "key", own, "inner").where("doc_id = first").withColumn("doc_id", F.col("rep"))
    else:
        picked = pick_by(rows, "doc_id", left, "inner")
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("central").alias("central"))
    sets = cut(full_sets(picked), "sets")
    groups = cut(stars(sets), "stars")
    tokens = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = cut(components(outside_links(sets, groups, parts(tokens))), "components")
    of_group = groups.join(joined, F.col("grp") == F.col("node"), "left").select("rep", F.coalesce("component", "grp").alias("component"))
    alone = joined.join(groups.withColumnRenamed("rep", "r"), F.col("node") == F.col("r"), "left_anti").select(F.col("node").alias("rep"), "component")
    found = cut(of_group.unionByName(alone), "found")
    if repeated:
        found, of_id = joined_by_ids(named, classes, several, found)
    told = classes.drop("prefix").join(found.withColumnRenamed("rep", "r"), F.col("rep") == F.col("r"), "left").where("size > 1 OR component IS NOT NULL")
    told = cut(told.select(F.col("n").alias("cn"), F.col("s1").alias("c1"), F.col("s2").alias("c2"), F.coalesce("component", "first").alias("component")), "told")
    rows = profile.select("doc_id", *key)
    same = (F.col("n") == F.col("cn")) & (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & F.col("doc_id").isNotNull()
    out = rows.join(told, same, "left")
    if repeated:
        # An id's rows without shingles go where its other rows go.
        out = out.join(of_id, F.col("doc_id") == F.col("known"), "left").withColumn("component", F.coalesce("component", "of_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component has a smaller doc_id; rows that link with nothing stay, as do null ids."""
    (gone,) = free_names(docs.columns, "gone")
    found = ngram_components(docs, id_col, text_col).where("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    return pick(docs, F.col(id_col) == F.col(gone), found, "left_anti")
