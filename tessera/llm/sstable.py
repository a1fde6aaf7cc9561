"""Token ids in sorted-string-table shards.

A shard holds documents in ascending order of identifier:

    block*      entries (shared key bytes, other key bytes, value length: varints; key rest; value), zstd, crc32
    index       sparse: first key, offset, length and entry count of each block
    bloom       double hashing over all keys
    footer      fixed size: places and sizes of index and bloom, document and id counts, magic

Keys are order-preserving: one byte (0 null, 1 value) and the identifier as big-endian offset binary. A value is the ids
as little-endian unsigned 32-bit integers. A lookup reads the footer, asks the Bloom filter, finds the block by binary
search in the index, and scans that block.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyspark.sql.functions as F
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window

from tessera.llm.batches import slices, texts
from tessera.llm.encoder import SLICE_BYTES, encoder
from tessera.scratch import materialise, shared_dir

MAGIC = b"TSSTABL1"
BLOCK_BYTES = 64 << 10
BITS_PER_KEY, PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQ8s")
#: Text bytes that one shard is planned for.
SHARD_BYTES = 32 << 20
#: Shards whose ids are summed up together, and rows that are read back at once.
GROUP, READ_ROWS = 1024, 8192


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id + (1 << 63)) & 0xFFFFFFFFFFFFFFFF)


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 128:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key, 0)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Appends (key, value) in ascending key order to a binary stream."""

    def __init__(self, out):
        self.out, self.at, self.docs, self.ids = out, 0, 0, 0
        self.block, self.size, self.entries, self.first, self.last = [], 0, 0, b"", b""
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += (_varint(shared), _varint(len(key) - shared), _varint(len(value)), key[shared:], value)
        self.size += len(value) + len(key) - shared + 3
        self.entries, self.last, self.docs, self.ids = self.entries + 1, key, self.docs + 1, self.ids + len(value) // 4
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.entries:
            data = self.pack.compress(b"".join(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.index.append((self.first, self.at, len(data), self.entries))
            self._put(data)
            self.block, self.size, self.entries = [], 0, 0

    def close(self) -> None:
        self._flush()
        index_at = self.at
        for first, at, length, entries in self.index:
            self._put(_varint(len(first)) + first + _varint(at) + _varint(length) + _varint(entries))
        bloom_at, bits = self.at, max(64, len(self.keys) * BITS_PER_KEY)
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._put(bytes(bloom))
        self._put(_FOOTER.pack(index_at, bloom_at - index_at, bloom_at, bits, len(self.index), self.docs, self.ids, MAGIC))


class Reader:
    """Reads a shard from a seekable binary file: `get` looks one identifier up, iteration gives all in order."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        index_at, index_size, bloom_at, self.bits, blocks, self.docs, self.ids, magic = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        data, at, self.index = self._at(index_at, index_size), 0, []
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            first, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            entries, at = _read_varint(data, at)
            self.index.append((first, offset, length, entries))
        self.bloom = self._at(bloom_at, (self.bits + 7) // 8)
        self.firsts = [x[0] for x in self.index]

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return bytes(self.file.read(size))

    def _entries(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length, entries = self.index[n]
        data = self._at(offset, length)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.index)):
            yield from self._entries(n)

    def get(self, doc_id: int | None) -> bytes | None:
        """The value of the first document with this identifier, or None."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return None
        n = max(0, bisect_right(self.firsts, key) - 1)
        while n > 0 and self.firsts[n] == key:  # repeats of an identifier may span blocks
            n -= 1
        for m in range(n, len(self.index)):
            if self.firsts[m] > key:
                return None
            for k, value in self._entries(m):
                if k == key:
                    return value
        return None


def open_shard(uri: str) -> Reader:
    fs, path = _store_of(uri)
    return Reader(fs.open_input_file(path))


def _store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(uri.replace(f"{scheme}:", "s3:", 1) if scheme in ("s3a", "s3n") else uri)


def qualified(spark, folder: str) -> str:
    """`folder` with the scheme of the session's file system, where it names none: executors and driver mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents as shards under `folder` (which all executors reach); returns the manifest: number, uri, docs, ids.

    Rows are range-partitioned and sorted by doc_id (null first; repeats in order of their texts' hash), then encoded and
    streamed to one file per partition, named by its number, so numbers are in key order. A file is written under its
    attempt's name and renamed when whole, so retries and speculative copies leave one complete file of the same bytes; what
    failed attempts left is removed. The manifest is a written table with one small row per shard.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    folder = qualified(spark, folder)
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes), spark.sparkContext.defaultParallelism if total > shard_bytes else 1)
    order = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]  # rows that are equal may part, too
    ordered = docs.repartitionByRange(shards, *order).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        own, ending = encoder(source.value), np.array([end_id], "<u4").tobytes()
        fs, base = _store_of(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, aside = f"part-{task.partitionId():07d}.sst", f".{uuid.uuid4().hex}"
        writer = None
        with fs.open_output_stream(f"{base}/{aside}") as out:
            for batch in slices(batches, limit=SLICE_BYTES):
                for doc_id, value in zip(batch.column("doc_id").to_pylist(), own.ids(texts(batch))):
                    writer = writer or Writer(out)
                    writer.add(key_of(doc_id), value + ending)
            if writer:
                writer.close()
        if not writer:
            fs.delete_file(f"{base}/{aside}")
            return
        fs.move(f"{base}/{aside}", f"{base}/{name}")
        row = [[task.partitionId()], [f"{folder}/{name}"], [writer.docs], [writer.ids]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in row], names=["number", "uri", "docs", "ids"])

    manifest = materialise(ordered.mapInArrow(run, "number long, uri string, docs long, ids long"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop(folder)):
        for left in fs.globStatus(hadoop(f"{folder}/.*")) or []:
            fs.delete(left.getPath(), False)
    return manifest


def starts(manifest: DataFrame) -> DataFrame:
    """(uri, base): the number of ids before each shard. Sums run within GROUP shards, and over the sums of groups."""
    group = F.floor(F.col("number") / GROUP).alias("g")
    within = Window.partitionBy("g").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    rows = manifest.select("number", "uri", "ids", group)
    groups = rows.groupBy("g").agg(F.sum("ids").alias("n")).select("g", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("first"))
    return rows.withColumn("own", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(groups, "g").select("uri", (F.col("first") + F.col("own")).alias("base"))


def read_shards(spark, manifest: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for uri, at in zip(*(batch.column(c).to_pylist() for c in ("uri", "base"))):
                rows = []
                for key, value in open_shard(uri):
                    rows.append((id_of(key), at, len(value) // 4, zlib.crc32(value)))
                    at += len(value) // 4
                    if len(rows) == READ_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)

    jobs = materialise(starts(manifest))
    return jobs.repartition(max(1, jobs.count()), "uri").mapInArrow(run, schema)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the ids of all documents, each followed by `end_id`, and return what the files hold.

    doc_id, start, n_tokens (with the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers), one row
    per input row. A null text is empty: its only id is the end id. Null doc_ids come first in the files, repeats follow
    one another in the order of a hash of their texts. Other columns are not read; an empty table writes no file and gives
    an empty result. `folder` is by default a new one in the session's shared folder.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/tessera-sst-{uuid.uuid4().hex}"
    return read_shards(spark, write_shards(docs, vocabulary, folder, end_id))
