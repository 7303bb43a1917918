"""Sorted-string-table shards of token ids: prefix-compressed blocks, sparse index, Bloom filter and footer.

A file holds documents in ascending order of their key: a byte 0 for a null id, else a byte 1 and the id as 8
big-endian bytes with the sign bit flipped; so documents without id come first. Layout, integers little-endian:

    block*   zstd of entries: shared u8, kept u8, kept key bytes, n_ids u32, n_ids ids (u16, or u32 by a flag)
             in which shared counts the key bytes equal to the previous entry's, 0 at a block's start
    index    for each block: first key 9 bytes (zeros behind a shorter one), offset u64, length u32, raw length u32,
             entries u32
    bloom    hashes u32, bits u32, bit array; of the ids that aren't null
    footer   index offset u64, blocks u32, bloom offset u64, documents u64, ids u64, wide u8, magic 8 bytes

A key is found by the Bloom filter, a binary search of the index and a scan of one block. Repeated keys stay, in
the order of their ids' checksum and then of their rows.
"""

from __future__ import annotations

import bisect
import io
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import chunks, fresh_path, mix, put_in_place, stored, utf8
from .tokens import WordEncoder, default_tokenizer, worker_memory

MAGIC = b"HGSSTv02"
BLOCK_BYTES = 64 << 10
#: Ids of a shard, about.
SHARD_IDS = 32 << 20
FOOTER = "<QIQQQB8s"
INDEX = "<9sQIII"
END_ID = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def bloom_bits(keys: np.ndarray, bits: int, hashes: int) -> np.ndarray:
    """Places of each key (as u64) in a Bloom filter, one column a hash function."""
    a, b = mix(keys), mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) % np.uint64(bits) for i in range(hashes)], axis=1)


class ShardWriter:
    """Writes one file; add() takes documents in ascending order of doc_id."""

    def __init__(self, out, wide: bool = False, bits_per_key: int = 10) -> None:
        self.out, self.wide, self.bits_per_key = out, wide, bits_per_key
        self.at = self.ids = self.documents = 0
        self.index: list[tuple] = []
        self.keys: list[int] = []
        self.codec = zstandard.ZstdCompressor(level=1)
        self._open()

    def _open(self) -> None:
        self.block, self.size, self.last, self.first, self.entries = [], 0, b"", b"", 0

    def _close_block(self) -> None:
        if self.entries:
            raw = b"".join(self.block)
            packed = self.codec.compress(raw)
            self.index.append((self.first, self.at, len(packed), len(raw), self.entries))
            self.out.write(packed)
            self.at += len(packed)
        self._open()

    def add(self, doc_id: int | None, ids: bytes | memoryview) -> None:
        """ids as u16, or as u32 if wide, little-endian."""
        key = key_of(doc_id)
        shared = 0
        while shared < min(len(self.last), len(key)) and self.last[shared] == key[shared]:
            shared += 1
        n = len(ids) // (4 if self.wide else 2)
        head = struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<I", n)
        self.first = self.first or key
        self.block += (head, ids)
        self.size, self.last, self.entries = self.size + len(head) + len(ids), key, self.entries + 1
        if doc_id is not None:
            self.keys.append(doc_id + (1 << 63))
        self.ids, self.documents = self.ids + n, self.documents + 1
        if self.size >= BLOCK_BYTES:
            self._close_block()

    def finish(self) -> None:
        self._close_block()
        index_at = self.at
        index = b"".join(struct.pack(INDEX, *x) for x in self.index)
        hashes, bits = 7, max(64, self.bits_per_key * len(self.keys))
        flags = np.zeros(bits + 7 & ~7, np.uint8)
        if self.keys:
            flags[bloom_bits(np.array(self.keys, np.uint64), bits, hashes).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<II", hashes, bits) + np.packbits(flags, bitorder="little").tobytes()
        self.out.write(index + bloom)
        self.out.write(struct.pack(FOOTER, index_at, len(self.index), index_at + len(index), self.documents, self.ids, self.wide, MAGIC))


class ShardReader:
    """Reads one file from anything with seek() and read()."""

    def __init__(self, file) -> None:
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - struct.calcsize(FOOTER))
        index_at, blocks, bloom_at, self.documents, self.ids, self.wide, magic = struct.unpack(FOOTER, file.read(struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard, or one cut short")
        file.seek(index_at)
        rest = file.read(end - struct.calcsize(FOOTER) - index_at)
        self.index = [struct.unpack_from(INDEX, rest, i * struct.calcsize(INDEX)) for i in range(blocks)]
        self.hashes, self.bits = struct.unpack_from("<II", rest, bloom_at - index_at)
        self.bloom = np.frombuffer(rest, np.uint8, offset=bloom_at - index_at + 8)

    def block(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        """Keys and ids, in the width they are stored with."""
        _, at, length, raw_length, entries = self.index[k]
        self.file.seek(at)
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(length), max_output_size=raw_length)
        p, key, width = 0, b"", 4 if self.wide else 2
        for _ in range(entries):
            shared, kept = raw[p], raw[p + 1]
            key = key[:shared] + raw[p + 2 : p + 2 + kept]
            (n,) = struct.unpack_from("<I", raw, p + 2 + kept)
            p += 6 + kept
            yield id_of(key), np.frombuffer(raw, f"<u{width}", n, p)
            p += n * width

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, doc_id: int | None) -> bool:
        if doc_id is None:
            return True
        at = bloom_bits(np.array([doc_id + (1 << 63)], np.uint64), self.bits, self.hashes)[0].astype(np.int64)
        return bool(np.all(self.bloom[at >> 3] >> (at & 7).astype(np.uint8) & 1))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this key; None asks for those without id."""
        found: list[np.ndarray] = []
        if self.may_hold(doc_id):
            key, firsts = key_of(doc_id).ljust(9, b"\0"), [x[0] for x in self.index]
            for k in range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key)):
                found += [ids for i, ids in self.block(k) if i == doc_id]
        return found


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, row, n_tokens, crc, wide and body (the ids as u16, or as u32 if wide) of each text with its end id.

    Null texts are empty. row is any number of the row's own, crc the checksum of body.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_memory(("words", tokenizer), lambda: WordEncoder(tokenizer))
        for part in chunks(batches):
            ids, at = encode(*utf8(part.column("text")))
            whole = np.insert(ids, at[1:], end_id)
            at = at + np.arange(len(at))
            wide = bool(len(whole)) and int(whole.max()) >= 1 << 16
            whole = whole.astype("<u4" if wide else "<u2")
            ends = at * whole.itemsize
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(whole)]).cast(pa.binary())
            raw = memoryview(whole).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row"), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([wide] * part.num_rows), body], ["doc_id", "row", "n_tokens", "crc", "wide", "body"])

    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("keys of these files are whole numbers: doc_id has to be a byte, short, int or long")
    rows = docs.select(F.col("doc_id").cast("long"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n_tokens long, crc long, wide boolean, body binary")


def write_shards(docs: DataFrame, path: str, shards: int | None = None, tokenizer: str | None = None, end_id: int = END_ID) -> list[tuple[int, int, int]]:
    """Tokenize docs (doc_id, text) and write them under path, sorted, a file a shard; (shard, documents, ids) of each.

    Spark deals the rows to shards by ranges of (doc_id, crc, row), so an id that many rows have is split like any
    range. Rows without doc_id come first. A task writes to a name of its own and takes the shard's name when the file
    is whole; a repeated task makes the same bytes. shards is by default the number that gives each SHARD_IDS ids.
    """
    spark = docs.sparkSession
    rows = stored(encoded(docs, tokenizer or default_tokenizer(), end_id), "encoded")
    ids, wider = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.max("wide"), F.lit(False))).head()
    shards = shards or max(1, -(-ids // SHARD_IDS))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        at, token, writer = TaskContext.get().partitionId(), int(np.random.default_rng().integers(1 << 62)), None
        made = f"{base}/.{at}-{token}"
        for batch in batches:
            for doc, wide, body in zip(batch.column("doc_id").to_pylist(), batch.column("wide").to_pylist(), batch.column("body").to_pylist(), strict=True):
                writer = writer or ShardWriter(fs.open_output_stream(made), wider)
                writer.add(doc, body if wide == wider else np.frombuffer(body, "<u2").astype("<u4").tobytes())
        if writer:
            writer.finish()
            writer.out.close()
            put_in_place(fs, made, f"{base}/{at:06d}.sst")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (at, writer.documents, writer.ids)], ["shard", "documents", "ids"])

    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    order = ("doc_id", "crc", "row")
    out = rows.select(*order, "wide", "body").repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "wide", "body")
    # One row a shard reaches the driver.
    return sorted((r.shard, r.documents, r.ids) for r in out.mapInArrow(write, "shard long, documents long, ids long").collect())


def read_shards(spark: SparkSession, path: str, shards: Iterable[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all shards), n_tokens, ids_crc32 from the files alone."""
    first, before = [], 0
    for shard, documents, ids in sorted(shards):
        if documents:
            first.append((shard, before))
        before += ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("before").to_pylist(), strict=True):
                rows: list[tuple[int | None, int, int, int]] = []
                with fs.open_input_file(f"{base}/{shard:06d}.sst") as file:
                    for doc, ids in ShardReader(file):
                        rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    tasks = spark.createDataFrame(first, "shard long, before long").repartition(max(1, len(first)))
    return tasks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple[int | None, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ([], [], [], []))], ["doc_id", "start", "n_tokens", "ids_crc32"])


def look_up(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the wanted doc_ids (column doc_id), by binary search in the shards whose ranges hold each.

    A null asks for the documents without id. A shard's first key is in its index; files are opened once a task. The
    first keys (9 bytes a shard) are read first.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path).select("path")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, low = batch.column(0).to_pylist(), []
            for name in names:
                fs, at = pafs.FileSystem.from_uri(name)
                with fs.open_input_file(at) as file:
                    low.append(ShardReader(file).index[0][0])
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(low, pa.binary())], ["path", "low"])

    ranges = sorted((bytes(r.low), r.path) for r in files.mapInArrow(ends, "path string, low binary").collect())
    lows, names = [r[0] for r in ranges], [r[1] for r in ranges]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[int, ShardReader] = {}
        for batch in batches:
            found: list[tuple[int | None, list[int]]] = []
            for doc in batch.column("doc_id").to_pylist():
                key = key_of(doc).ljust(9, b"\0")
                for k in range(max(0, bisect.bisect_left(lows, key) - 1), bisect.bisect_right(lows, key)):
                    if k not in readers:
                        fs, at = pafs.FileSystem.from_uri(names[k])
                        readers[k] = ShardReader(fs.open_input_file(at))
                    found += [(doc, ids.tolist()) for ids in readers[k].get(doc)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return wanted.select(F.col("doc_id").cast("long")).mapInArrow(find, "doc_id long, ids array<long>")


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as shards in the shared folder and read them back, see write_shards() and read_shards()."""
    spark = docs.sparkSession
    path = fresh_path(spark, "sst")
    return read_shards(spark, path, write_shards(docs, path, tokenizer=tokenizer))
