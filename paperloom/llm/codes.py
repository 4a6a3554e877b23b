"""Vector code compression: codebooks of vector parts by Lloyd's rounds whose sums are maintained by differences.

Vectors become integers, so sums and distances are exact and don't depend on the order in which tasks add them up. Each round is one
pass over the state, a table of (vector, its codes): a task assigns its parts anew, writes the state with the new codes, and for the
parts whose code has changed adds the part to the sum of its new entry and takes it from the sum of the old one. It hands on one
row for each entry that it has touched, and only those rows are shuffled. The sums over the whole table run on from round to
round; they and the codebooks are parts x words rows, whatever the table's size. Entries are the floors of sum / count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import small_batches
from .shared import cut, discard, shared_path

PARTS, WORDS, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are held to this, and to what keeps distances in 64 bits where parts are long.
LARGEST = 1 << 27
#: Parts that a task assigns at once.
ROWS = 4096


class Codes(NamedTuple):
    #: id, label, code (two hex digits a part), error
    rows: DataFrame
    #: parts x words x components
    books: np.ndarray
    #: Parts whose code changed, in each round.
    changed: list[int]


def largest_component(length: int) -> int:
    return int(min(LARGEST, (2**60 / max(1, length)) ** 0.5))


def integer_vectors(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, label, x) of the vectors that can be cut into parts: all components finite, and of the most frequent length that parts divide."""
    e = F.col(vector_col).cast("array<double>")
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), e.alias("e"))
    sound = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("e") > 0) & (F.size("e") % parts == 0)
    good = rows.where(F.coalesce(sound, F.lit(False)))
    lengths = good.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    length = lengths[0]["d"] if lengths else parts
    most = largest_component(length)
    within = lambda v: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(F.greatest(F.lit(-2.0**62), F.least(F.lit(2.0**62), v * scale))))).cast("int")
    return good.where(F.size("e") == length).select("id", "label", F.transform("e", within).alias("x"))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """rows x parts x components"""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), parts, -1)


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), rows x parts each: the nearest entry, ties to the lower index; exact in integers."""
    n, parts, d = x.shape
    codes, errors = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    # Whole numbers in doubles are exact up to 2**53, and so are their products, in any order of adding.
    kind = np.float64 if 4 * d * most * most < 2**53 else np.int64
    for p in range(parts):
        a, b = x[:, p].astype(kind), books[p].astype(kind)
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
        codes[:, p] = near = far.argmin(axis=1)
        errors[:, p] = far[np.arange(n), near].astype(np.int64)
    return codes, errors


class Contributions:
    """Plus and minus of a task: counts and sums by entry (part x words + code)."""

    def __init__(self, parts: int, words: int, d: int):
        self.words, self.counts, self.sums, self.changed = words, np.zeros(parts * words, np.int64), np.zeros((parts * words, d), np.int64), 0

    def _add(self, x: np.ndarray, entries: np.ndarray, sign: int) -> None:
        # Sums of runs of rows sorted by entry.
        order = np.argsort(entries, kind="stable")
        found, starts = np.unique(entries[order], return_index=True)
        if len(found):
            self.counts[found] += sign * np.diff([*starts, len(entries)])
            self.sums[found] += sign * np.add.reduceat(x[order], starts, axis=0)

    def move(self, x: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> None:
        for p in range(x.shape[1]):
            moved = np.ones(len(x), bool) if old is None else old[:, p] != new[:, p]
            self.changed += int(moved.sum())
            part = x[moved, p]
            self._add(part, p * self.words + new[moved, p].astype(np.int64), 1)
            if old is not None:
                self._add(part, p * self.words + old[moved, p].astype(np.int64), -1)


def _round(state: DataFrame, books: np.ndarray, path: str) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """(state with new codes, differences of counts, of sums, parts changed). state: id, label, x, codes (binary, null at first)."""
    parts, words, d = books.shape
    kinds = dict(state.dtypes)
    arrow = {c: to_arrow_type(state.schema[c].dataType) for c in ("id", "label")}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Contributions(parts, words, d)
        none = lambda n, t: pa.nulls(n, t)
        longs = pa.list_(pa.int64())
        names = ["kind", "id", "label", "x", "codes", "entry", "n", "sums"]
        for b in small_batches(batches, ROWS):
            x, old = _matrix(b.column(2), parts), b.column(3)
            new, _ = assign(x, books)
            found.move(x, None if old.null_count else np.frombuffer(b"".join(old.to_pylist()), np.uint8).reshape(-1, parts), new)
            n = b.num_rows
            codes = pa.array([r.tobytes() for r in new], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), b.column(0), b.column(1), b.column(2), codes, none(n, pa.int32()), none(n, pa.int64()), none(n, longs)], names=names)
        touched = np.flatnonzero((found.counts != 0) | (found.sums != 0).any(axis=1))
        # The last row tells how many parts have changed.
        n, sums = len(touched) + 1, [*found.sums[touched].tolist(), None]
        entry, counts = pa.array([*touched.tolist(), -1], pa.int32()), pa.array([*found.counts[touched].tolist(), found.changed], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), none(n, arrow["id"]), none(n, arrow["label"]), none(n, pa.list_(pa.int32())), none(n, pa.binary()), entry, counts, pa.array(sums, longs)], names=names)

    schema = f"kind int, id {kinds['id']}, label {kinds['label']}, x array<int>, codes binary, entry int, n long, sums array<long>"
    state.mapInArrow(step, schema).write.partitionBy("kind").parquet(path)
    written = state.sparkSession.read.schema(schema).parquet(path)
    sums = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(d)]
    counts, total, changed = np.zeros(parts * words, np.int64), np.zeros((parts * words, d), np.int64), 0
    for r in written.where("kind = 1").groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect():
        if r["entry"] < 0:
            changed = r["n"]
        else:
            counts[r["entry"]], total[r["entry"]] = r["n"], r[2:]
    new_state = written.where("kind = 0").select("id", "label", "x", "codes")
    new_state.written_to = path
    return new_state, counts, total, changed


def compress(vectors: DataFrame, parts: int = PARTS, words: int = WORDS, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> Codes:
    """Codes of all sound vectors, and the codebooks.

    A component x becomes floor(scale * x). Vectors that are null or empty, hold a null or a non-finite component, or are not of the
    most frequent length that ``parts`` divides (of equally frequent ones the shortest) are dropped. A part's codebook starts as that part
    of the vectors with the smallest ids, as many as ``words`` (at most 256), or all if there are fewer; a null id comes last,
    rows that repeat an id come in the order of their vectors and each start an entry. Each round assigns and then averages; entries
    that no part has stay as they are. Ties go to the lower index. An empty table gives no rows and empty codebooks.
    Integers beyond LARGEST (finite x beyond 131,072 for a scale of 1,024) are held to it. Other columns are ignored, whatever their names.
    """
    if not 0 < words <= 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    start = cut(integer_vectors(vectors, parts, scale, id_col, vector_col, label_col).withColumn("codes", F.lit(None).cast("binary")), "vectors")
    first = start.orderBy(F.col("id").asc_nulls_last(), "x").limit(words).select("x").collect()
    kinds = dict(start.dtypes)
    if not first:
        return Codes(spark.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code string, error long"), np.zeros((parts, 0, 0), np.int64), [])
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    flat = (parts * books.shape[1], books.shape[2])
    counts, sums, state, changes = np.zeros(flat[0], np.int64), np.zeros(flat, np.int64), start, []
    for _ in range(rounds):
        was = state
        state, more, shift, changed = _round(state, books, shared_path(spark, "codes"))
        discard(was)
        counts, sums = counts + more, sums + shift
        changes.append(changed)
        used = counts > 0
        entries = books.reshape(flat).copy()
        entries[used] = sums[used] // counts[used, None]
        books = entries.reshape(books.shape)

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, ROWS):
            codes, errors = assign(_matrix(b.column(2), parts), books)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(errors.sum(axis=1))], names=["id", "label", "code", "error"])

    out = state.select("id", "label", "x").mapInArrow(final, f"id {kinds['id']}, label {kinds['label']}, code string, error long")
    return Codes(out, books, changes)


def books_text(books: np.ndarray) -> str:
    """All components by part, entry and place, as decimal numbers joined by commas."""
    return ",".join(map(str, books.ravel().tolist()))
