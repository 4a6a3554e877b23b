"""SHA-256 of files of any size: a digest is a chain over all bytes, so tasks hand its state on."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.store import cut, shared_path

#: Bytes of a file that one task hashes, besides a split, before it hands the state on.
STEP = 128 << 20
#: The reader of lines leaves these out at the start of a file.
MARK = b"\xef\xbb\xbf"
_PIECE = "path string, start long, ordinal long, size long, data binary"


class Sha256:
    """hashlib's SHA-256, whose state can be read and set (hashlib's own can't): the plain structure of the libcrypto that it uses."""

    def __init__(self, state: bytes = b"") -> None:
        import _hashlib

        self.lib, self.state = ctypes.CDLL(_hashlib.__file__), ctypes.create_string_buffer(state, 256)
        if not state:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, data, ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(hashlib.sha256().digest_size)
        self.lib.SHA256_Final(out, self.state)
        return out.raw.hex()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (path, start, value) of splits as pieces, each line with its end."""
    at, ordinal = None, 0
    for b in batches:
        file, start = b.column("path").dictionary_encode().indices.to_numpy(), b.column("start").to_numpy()
        cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
        for i, j in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            if i == j:
                continue
            split = b.column("path")[i].as_py(), int(start[i])
            at, ordinal = split, ordinal + 1 if split == at else 0
            ended = pc.binary_join_element_wise(b.column("value").slice(i, j - i), pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
            data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ended)], pa.int32()), ended), pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([ordinal], pa.int64()), pc.binary_length(data).cast(pa.int64()), data], names=["path", "start", "ordinal", "size", "data"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, state, sha256) of sorted rows: of each path one that opens it (state, is it the end, has the end one byte too many), then pieces."""
    path, h, held, end, more = None, None, b"", False, False

    def close() -> pa.RecordBatch:
        h.update(held[: len(held) - 1] if end and more else held)
        state = h.state.raw
        return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([state], pa.binary()), pa.array([h.hexdigest() if end else None], pa.string())], names=["path", "state", "sha256"])

    for b in batches:
        for i in range(b.num_rows):
            data = b.column("data")[i].as_py()
            if b.column("ordinal")[i].as_py() < 0:
                if path is not None:
                    yield close()
                path, h, held, end, more = b.column("path")[i].as_py(), Sha256(data), b"", b.column("end")[i].as_py(), b.column("more")[i].as_py()
            else:
                h.update(held)
                held = data
    if path is not None:
        yield close()


def file_digests(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path, length, sha256) of the files under a folder, but of empty ones, which Spark's readers leave out. A task
    reads STEP bytes of a file and a split at most, and not all of it.

    Splits are read in parallel, as lines of bytes, and written as pieces. Then a round a STEP goes over them, in which a task for
    each file takes its pieces in order and hands the state of the digest on; the rounds follow the largest file.
    """
    found = lambda kind: spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    path = F.col("_metadata.file_path").alias("path")
    files = found("binaryFile").load(folder).select(path, F.col("path").alias("shown"), "length")
    lines = found("text").option("lineSep", "\n").load(folder).select(path, F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))
    turn: Column = F.floor(F.col("start") / STEP).cast("int").alias("turn")
    to = shared_path(spark, "pieces")
    # Bytes of packed files are not worth packing, and small row groups are less to hold.
    lines.mapInArrow(_joined, _PIECE).select("*", turn).write.partitionBy("turn").option("compression", "none").option("parquet.block.size", 16 << 20).parquet(to)
    pieces = spark.read.schema(f"{_PIECE}, turn int").parquet(to)
    read = pieces.groupBy("path").agg(F.sum("size").alias("bytes"), F.max("turn").alias("last"))
    # Every line got an end, which the last one of a file need not have had.
    over = F.coalesce("bytes", F.lit(0)) - F.col("length")
    files = cut(files.join(read, "path", "left").select("path", "shown", "length", F.coalesce("last", F.lit(0)).alias("last"), over.isin(1, -len(MARK) + 1).alias("more"), (over <= -len(MARK) + 1).alias("mark")), "files")
    rounds = (files.agg(F.max("last")).first()[0] or 0) + 1
    state, done = files.select("path", F.lit(b"").alias("state")), []
    for k in range(rounds):
        opened = files.where(F.col("last") >= k).join(state, "path").select("path", F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("ordinal"), F.col("state").alias("data"), (F.col("last") == k).alias("end"), "more")
        rows = opened.unionByName(pieces.where(F.col("turn") == k).drop("turn", "size"), allowMissingColumns=True)
        if k == 0:
            rows = rows.unionByName(files.where("mark").select("path", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("ordinal"), F.lit(MARK).alias("data")), allowMissingColumns=True)
        hashed = cut(rows.repartition("path").sortWithinPartitions("path", "start", "ordinal").mapInArrow(_hashed, "path string, state binary, sha256 string"), "digests")
        state = hashed.where("sha256 IS NULL").select("path", "state")
        done.append(hashed.written_to)
    digests = spark.read.schema("path string, state binary, sha256 string").parquet(*done).where("sha256 IS NOT NULL")
    return files.join(digests, "path").select(F.col("shown").alias("path"), "length", "sha256")
