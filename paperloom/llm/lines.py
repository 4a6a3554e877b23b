"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (line key, documents, holder), sorted by key and cut into buckets by key; runs of a level are as large as one
another, and FANOUT of them are compacted to one of the next level, where counts of a key add up. A batch of documents anti-joins the
runs, bucket by bucket and without moving them: keys that some run knows in enough documents are settled and add nothing; the others,
counted before they move, are the batch's own run. Batches come in the order of precedence, so the first run that has a key holds the
document in which its lines stay.

The lines of all documents are hashed once, a row for each distinct key of a document with its places. Decisions are places of lines
in a document, which meet the texts by (id, hash of the text).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import small_batches
from .shared import cut, discard, shared_path

LEAST_DOCS, LEAST_CHARS = 5, 40
#: Runs of a level that are compacted to one.
FANOUT = 2
#: Batches that a whole table is cut into.
BATCHES = 4
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: Keys that are broadcast at most, and rows and places of documents' decisions; more are joined by both sides' keys.
KEYS_SENT, ROWS_SENT, PLACES_SENT = 500_000, 500_000, 4_000_000


class LineRuns:
    """Levels of sorted runs; ``add`` takes batches in the order of precedence."""

    def __init__(self, spark: SparkSession, settled: int = LEAST_DOCS, fanout: int | None = None):
        self.spark, self.settled, self.fanout = spark, settled, fanout or FANOUT
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def _write(self, entries: DataFrame) -> DataFrame:
        """A run: one sorted file for each bucket, which joins by key without an exchange."""
        name, path = f"line_run_{uuid.uuid4().hex}", shared_path(self.spark, "run")
        sorted_ = entries.repartition(self.buckets, "key").sortWithinPartitions("key")
        sorted_.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(name)
        run = self.spark.table(name)
        run.name, run.written_to = name, path
        return run

    def _drop(self, run: DataFrame) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run.name}")
        discard(run)

    def runs(self) -> list[DataFrame]:
        """The runs, oldest first: those of a higher level are older, and so are those that came first in a level."""
        return [run for level in reversed(self.levels) for run in level]

    def add(self, keys: DataFrame) -> None:
        """A batch's (key, holder), one row for each document that has the key: what isn't settled yet becomes a run."""
        own = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("holder").alias("holder"))
        for run in self.runs():
            known = run.where(F.col("n") >= self.settled).select(F.col("key").alias("known"))
            own = own.join(known.hint("merge"), F.col("key") == F.col("known"), "left_anti")
        self._put(0, self._write(own))

    def _put(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(reduce(self._merged, full)))
            for r in full:
                self._drop(r)

    @staticmethod
    def _merged(older: DataFrame, newer: DataFrame) -> DataFrame:
        """Two runs as one: counts add up, and the older run's holder stays. Both are in buckets, so neither moves to be joined; the
        merged run is dealt out to buckets again as it is written."""
        a, b = (df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("key", "n", "holder")]) for df, p in ((older, "a"), (newer, "b")))
        both = a.join(b.hint("merge"), F.col("a_key") == F.col("b_key"), "full_outer")
        n = F.coalesce("a_n", F.lit(0)) + F.coalesce("b_n", F.lit(0))
        return both.select(F.coalesce("a_key", "b_key").alias("key"), n.alias("n"), F.when(F.col("a_n").isNotNull(), F.col("a_holder")).otherwise(F.col("b_holder")).alias("holder"))

    def frequent(self, least: int) -> DataFrame:
        """(key, holder) of the keys found in so many documents at least, up to the number at which keys are settled."""
        if least > self.settled:
            raise ValueError("keys are counted up to the number at which they are settled")
        runs = self.runs()
        found = cut(reduce(self._merged, runs).where(F.col("n") >= least).select("key", "holder"), "frequent")
        for r in runs:
            self._drop(r)
        self.levels = []
        return found


def hashed_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, text_hash, batch, key, places) for docs (doc_id, text_hash, batch, text): one row for each distinct key of a document."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            row, keys, places = [], [], []
            for i, t in enumerate(b.column(3)):
                found: dict[bytes, list[int]] = {}
                for at, line in enumerate((t.as_py() or "").split("\n")):
                    if len(line) >= least_chars and len(stripped := line.strip(SPACE)) >= least_chars:
                        # Of bytes, lower() changes A-Z only.
                        found.setdefault(blake2b(stripped.encode().lower(), digest_size=16).digest(), []).append(at)
                row += [i] * len(found)
                keys += found.keys()
                places += found.values()
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(3)), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "batch", "key", "places"])

    return docs.select("doc_id", "text_hash", "batch", "text").mapInArrow(hashed, "doc_id long, text_hash long, batch int, key binary, places array<int>")


def _batch_of(ids: DataFrame, batches: int) -> Column:
    """The number of a doc_id's batch: 0 has the largest ids; null ids come last."""
    shares = [i / batches for i in range(1, batches)]
    bounds = ids.agg(F.percentile_approx("doc_id", F.array(*[F.lit(s) for s in shares]), 10_000).alias("b")).first()["b"] if shares else None
    batch = F.lit(batches - 1)
    for i, bound in enumerate(sorted(set(bounds or []))):
        batch = F.when(F.col("doc_id") > bound, batches - 2 - i).otherwise(batch)
    return batch


def dedup_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text (the lines that stay, joined by line feeds), n_lines (before), n_dropped.

    Lines end at line feeds only. A line's key is the line without white space (space and 09 to 0D) at both ends and with A-Z
    lower-cased. Keys of least_chars code points found in least_docs rows of docs lose all their lines, except in the rows with the
    largest id that has it. A null or empty text is one empty line, and a text whose lines all go is empty. Rows that repeat an
    id count as documents of their own and keep or lose lines alike; null ids come before all others, and hold lines that no
    other row has. An empty table gives an empty one. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    path = shared_path(docs.sparkSession, "lines")
    lines = hashed_lines(rows.withColumn("batch", _batch_of(rows.select("doc_id"), batches)), least_chars)
    lines.write.partitionBy("batch").parquet(path)
    lines = docs.sparkSession.read.schema(lines.schema).parquet(path)
    lines.written_to = path
    runs = LineRuns(docs.sparkSession, least_docs)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).select("key", F.col("doc_id").alias("holder")))
    frequent = runs.frequent(least_docs).withColumnRenamed("key", "k")
    sent = F.broadcast(frequent) if frequent.count() <= KEYS_SENT else frequent
    lost = lines.join(sent, (F.col("key") == F.col("k")) & ~F.col("doc_id").eqNullSafe(F.col("holder")))
    gone = lost.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.flatten(F.collect_set("places")).alias("gone"))
    gone = cut(gone, "gone")
    discard(lines)
    n, places = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("gone")), F.lit(0))).first()
    gone = F.broadcast(gone) if n <= ROWS_SENT and places <= PLACES_SENT else gone
    told = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left").select("doc_id", "text", "gone")

    def without(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(parts):
            kept, n_lines, n_dropped = [], [], []
            for t, places in zip(b.column(1), b.column(2), strict=True):
                text, dropped = t.as_py() or "", set(places.as_py() or ())
                n_lines.append(text.count("\n") + 1)
                n_dropped.append(len(dropped))
                kept.append("\n".join(x for at, x in enumerate(text.split("\n")) if at not in dropped) if dropped else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])

    return told.mapInArrow(without, "doc_id long, text string, n_lines long, n_dropped long")
