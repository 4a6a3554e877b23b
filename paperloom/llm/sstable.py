"""Token ids in sorted-string-table files.

A file holds documents in the order of their ids:

    block*  index  bloom  meta  footer

A block is a compressed run of entries (shared, suffix length, count, suffix, ids): the key, 9 bytes that sort as the doc_id does
with null first, leaves out the bytes it shares with the key before it. The index has each block's first key, place, size and
documents; the Bloom filter has the keys; the footer has the places of index, filter and meta, their checksum and the magic.
A lookup asks the filter, searches the index by bisection and reads one block, or the run of blocks that one key fills.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _texts, small_batches, worker_encoder
from .shared import shared_path

MAGIC = b"PLSST01\n"
BLOCK_BYTES = 256 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
ENTRY = struct.Struct("<BBI")
INDEX = struct.Struct("<9sQIQQ")
FOOTER = struct.Struct("<QQQQI8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _bits(key: bytes, n: int) -> list[int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
    return [(a + i * b) % n for i in range(BLOOM_HASHES)]


class Writer:
    """Takes documents in the order of their ids and writes one file, which appears under its name when it is whole."""

    def __init__(self, path: str, width: int = 2, block_bytes: int = BLOCK_BYTES):
        self.block_bytes = block_bytes
        self.fs, self.path = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.kind, self.zip = np.dtype(f"<u{width}"), zstandard.ZstdCompressor(level=1)
        self.at, self.index, self.docs, self.tokens = 0, [], 0, 0
        #: The keys one after the other, nine bytes each, for the filter.
        self.keys = bytearray()
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.size, self.first, self.last, self.block_docs, self.block_tokens = [], 0, b"", b"", 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        if self.keys and key < self.keys[-9:]:
            raise ValueError("documents must come in the order of their ids")
        shared = next((i for i in range(len(self.last)) if self.last[i] != key[i]), len(self.last))
        raw = ids.astype(self.kind).tobytes()
        self.block += [ENTRY.pack(shared, 9 - shared, len(ids)), key[shared:], raw]
        self.size += ENTRY.size + 9 - shared + len(raw)
        self.first, self.last = self.first or key, key
        if self.keys[-9:] != key:
            self.keys += key
        self.docs, self.tokens = self.docs + 1, self.tokens + len(ids)
        self.block_docs, self.block_tokens = self.block_docs + 1, self.block_tokens + len(ids)
        if self.size >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self) -> None:
        if self.block:
            at = self.at
            n = self._put(self.zip.compress(b"".join(self.block)))
            self.index.append(INDEX.pack(self.first, at, n, self.block_docs, self.block_tokens))
            self._fresh()

    def close(self) -> dict:
        self._flush()
        bits = max(64, len(self.keys) // 9 * BLOOM_BITS)
        bloom = bytearray((bits + 7) // 8)
        for i in range(0, len(self.keys), 9):
            for b in _bits(bytes(self.keys[i : i + 9]), bits):
                bloom[b >> 3] |= 1 << (b & 7)
        meta = {"docs": self.docs, "tokens": self.tokens, "width": self.kind.itemsize, "bloom_bits": bits, "first": self.keys[:9].hex(), "last": self.keys[-9:].hex()}
        parts = [b"".join(self.index), bytes(bloom), json.dumps(meta).encode()]
        places = [self.at]
        for p in parts:
            self._put(p)
            places.append(self.at)
        self._put(FOOTER.pack(*places, zlib.crc32(b"".join(parts)), MAGIC))
        self.out.close()
        self.fs.move(f"{self.path}.part", self.path)
        return meta


class Reader:
    def __init__(self, path: str):
        fs, p = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(p)
        size = self.file.size()
        index, bloom, meta, end, crc, magic = FOOTER.unpack(self._get(size - FOOTER.size, FOOTER.size))
        tail = self._get(index, end - index)
        if magic != MAGIC or zlib.crc32(tail) != crc:
            raise ValueError(f"{path} is damaged")
        self.index = [INDEX.unpack_from(tail, i) for i in range(0, bloom - index, INDEX.size)]
        self.bloom, self.meta = tail[bloom - index : meta - index], json.loads(tail[meta - index :])
        self.kind, self.unzip = np.dtype(f"<u{self.meta['width']}"), zstandard.ZstdDecompressor()

    def _get(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, _, _ = self.index[i]
        data = self.unzip.decompress(self._get(at, n))
        p, key = 0, b""
        while p < len(data):
            shared, suffix, count = ENTRY.unpack_from(data, p)
            p += ENTRY.size
            key = key[:shared] + data[p : p + suffix]
            p += suffix
            yield key, np.frombuffer(data, self.kind, count, p)
            p += count * self.kind.itemsize

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, ids in self.block(i):
                yield id_of(key), ids

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with that identifier."""
        key = key_of(doc_id)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(key, self.meta["bloom_bits"])):
            return []
        out = []
        # Documents with the key may begin in the block before the first one whose first key is the key.
        for i in range(max(0, bisect_left(self.index, key, key=lambda e: e[0]) - 1), len(self.index)):
            if self.index[i][0] > key:
                break
            out += [ids for k, ids in self.block(i) if k == key]
        return out


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int = 0, folder: str | None = None, files: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[dict]:
    """Encode every row of docs, append end_id, write the files, and return what they hold, in order.

    The ids are those of the tokenizers library with the same file; its own encoder takes some 1,400 CPU seconds a GB of input, so
    the words are merged in tables here (see bpe), and the tests hold the ids against the library's.

    Documents are range-partitioned by id, so a task writes the file of its range. A file counts once its task has reported it: a
    task that runs again writes another name, and what the lost one wrote is never read. Ids sort ascending, null first; rows with
    the same id sort by the hash of their text, then by the text, so that an id with very many rows can fill several files. Null and empty texts are the end id alone. An empty table writes no file. Other columns are ignored.
    """
    folder = folder or shared_path(docs.sparkSession, "tokens")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    ranged = rows.repartitionByRange(*([files] if files else []), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer = worker_encoder(vocabulary_path), None
        path = f"{folder}/{uuid.uuid4().hex}.sst"
        for b in small_batches(batches):
            for doc_id, tie, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), encoder.encode_batch(_texts(b.column(1))), strict=True):
                if writer is None:
                    writer, first_tie = Writer(path, block_bytes=block_bytes), tie
                writer.add(doc_id, np.append(ids, np.uint16(end_id)))
        if writer:
            meta = writer.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "docs": meta["docs"], "tokens": meta["tokens"], "first": meta["first"], "tie": first_tie}])

    found = [r.asDict() for r in ranged.mapInArrow(run, "path string, docs long, tokens long, first string, tie long").collect()]
    found.sort(key=lambda f: (f["first"], f["tie"]))
    start = 0
    for f in found:
        f["start"] = start
        start += f["tokens"]
    return found


def read_tokens(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids in all documents before it), n_tokens, ids_crc32 (of the ids as unsigned 32-bit) from the files.

    One row for each document that was written, repeated and null ids too; no files, no rows.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(f["path"], f["start"]) for f in manifest], "path string, start long").repartitionByRange(len(manifest), "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                reader = Reader(path)
                for i in range(len(reader.index)):
                    doc_ids, starts, lengths, crcs = [], [], [], []
                    for key, ids in reader.block(i):
                        doc_ids.append(id_of(key))
                        starts.append(start)
                        lengths.append(len(ids))
                        crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts, lengths, crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, schema)


def lookup(manifest: list[dict], doc_id: int) -> list[np.ndarray]:
    """The ids of a document: bisection over the files, then over one file's blocks."""
    key = key_of(doc_id).hex()
    at = max(0, bisect_left([f["first"] for f in manifest], key) - 1)
    out = []
    for f in manifest[at:]:
        if f["first"] > key:
            break
        out += Reader(f["path"]).lookup(doc_id)
    return out
