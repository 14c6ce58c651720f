"""Token-id files: sorted string tables keyed by document identifier.

A file holds documents in ascending key order::

    header   magic
    blocks   entries (shared prefix length, suffix length, value length: varints;
             key suffix; value = ids as little-endian integers of the file's
             width: 2 bytes if the vocabulary allows, else 4); a block's first key
             is whole
    index    one entry a block: key length (varint), key, offset, length, count
    bloom    bits over all keys
    footer   offsets of index and bloom, counts, hashes, width, magic

so a lookup reads the footer, asks the Bloom filter, finds the block by binary
search in the sparse index and scans that block alone.

Writing range-partitions documents by key, encodes them where they lie and
writes one or more files a partition, each of a bounded size, first under an
attempt's own name and then by a rename, so a repeated task leaves the same
files.  The manifest (one row a file) is a table in the shared folder.

Defined results
* null and empty texts: the end id alone.  Null ids sort first, under the empty key.
* repeated ids: kept, next to one another by their texts; a lookup returns all.
* very long texts: one entry each; a file ends after the entry that fills it.
* empty table: no files, no rows.  Other columns take no part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import give_back, materialize, shared_dir
from .tokens import encoder

MAGIC = b"QGSST\x00\x01\n"
FOOTER = struct.Struct("<QQQQQHH8s")  # index at, bloom at, bloom bytes, entries, tokens, hashes, width, magic
BLOCK_BYTES = 64 * 1024
FILE_BYTES = 128 * 1024 * 1024
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as the ids do."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def key_hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & ((1 << 64) - 1), (h >> 64) | 1


def bloom_places(key: bytes, bits: int):
    a, b = key_hashes(key)
    return [(a % bits + i * (b % bits)) % bits for i in range(BLOOM_HASHES)]


class FileWriter:
    """Streams one table into ``sink``; entries come in key order, ids as uint32 bytes.

    Only the open block, a sparse index entry a block and a hash a key are held.
    """

    def __init__(self, sink, width: int = 4):
        self.sink, self.width, self.at = sink, width, 0
        self.block, self.index, self.hashes = bytearray(), [], array("Q")
        self.first = self.last = b""
        self.in_block = self.tokens = self.entries = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        self.tokens += len(value) // 4
        if self.width == 2:
            value = np.frombuffer(value, dtype="<u4").astype("<u2").tobytes()
        shared = 0
        if self.in_block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.hashes.extend(key_hashes(key))
        self.in_block += 1
        self.entries += 1
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            self.index.append((self.first, self.at, len(self.block), self.in_block))
            self._put(bytes(self.block))
            self.block, self.in_block = bytearray(), 0

    def __len__(self) -> int:
        return self.at + len(self.block)

    def finish(self) -> None:
        self._end_block()
        index_at, index = self.at, bytearray()
        for key, offset, length, count in self.index:
            put_varint(index, len(key))
            index += key + struct.pack("<QQI", offset, length, count)
        self._put(bytes(index))
        bloom_at = self.at
        bits = max(64, self.entries * BLOOM_BITS_PER_KEY) + 7 & ~7
        bloom = np.zeros(bits, dtype=bool)
        h = np.frombuffer(self.hashes, dtype=np.uint64).reshape(-1, 2) % np.uint64(bits)
        for i in range(BLOOM_HASHES):
            bloom[(h[:, 0] + np.uint64(i) * h[:, 1]) % np.uint64(bits)] = True
        self._put(np.packbits(bloom, bitorder="little").tobytes())
        self._put(FOOTER.pack(index_at, bloom_at, bits // 8, self.entries, self.tokens, BLOOM_HASHES, self.width, MAGIC))


class FileReader:
    """Random access and scans over one table in any pyarrow file system."""

    def __init__(self, path: str):
        system, inner = pafs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        size = self.file.size()
        self.file.seek(size - FOOTER.size)
        self.index_at, self.bloom_at, self.bloom_bytes, self.entries, self.tokens, _, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token table: {path}")
        raw = self._read(self.index_at, self.bloom_at - self.index_at)
        self.index, at = [], 0
        while at < len(raw):
            n, at = get_varint(raw, at)
            self.index.append((raw[at : at + n], *struct.unpack_from("<QQI", raw, at + n)))
            at += n + 20

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, k: int):
        _, offset, length, count = self.index[k]
        data, at, key = self._read(offset, length), 0, b""
        for _ in range(count):
            shared, at = get_varint(data, at)
            own, at = get_varint(data, at)
            n, at = get_varint(data, at)
            key = key[:shared] + data[at : at + own]
            value = data[at + own : at + own + n]
            yield key, value if self.width == 4 else np.frombuffer(value, dtype="<u2").astype("<u4").tobytes()
            at += own + n

    def scan(self):
        for k in range(len(self.index)):
            yield from self._block(k)

    def may_hold(self, key: bytes) -> bool:
        bloom = self._read(self.bloom_at, self.bloom_bytes)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bloom_bytes * 8))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry under ``doc_id``."""
        key = key_of(doc_id)
        if not self.index or not self.may_hold(key):
            return []
        firsts = [x[0] for x in self.index]
        k = bisect_right(firsts, key) - 1
        while k > 0 and firsts[k] == key:  # repeats may begin in the block before
            k -= 1
        out = []
        for k in range(max(k, 0), len(self.index)):
            if firsts[k] > key:
                break
            out += [np.frombuffer(v, dtype="<u4") for x, v in self._block(k) if x == key]
        return out

    def close(self) -> None:
        self.file.close()


class _OpenFile:
    """A file under its attempt's name until it is whole, then under its own."""

    def __init__(self, folder: str, name: str, width: int):
        self.system, inner = pafs.FileSystem.from_uri(folder)
        self.system.create_dir(inner, recursive=True)
        self.attempt, self.final, self.path = f"{inner}/.{name}.{uuid.uuid4().hex}", f"{inner}/{name}", f"{folder}/{name}"
        self.out = self.system.open_output_stream(self.attempt)
        self.writer, self.first = FileWriter(self.out, width), None

    def add(self, doc_id: int | None, value: bytes) -> None:
        if not self.writer.entries:
            self.first = doc_id
        self.writer.add(key_of(doc_id), value)

    def close(self) -> tuple:
        self.writer.finish()
        self.out.close()
        self.system.move(self.attempt, self.final)
        return self.path, self.writer.entries, self.writer.tokens, self.first, id_of(self.writer.last)


def write_tables(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, partitions: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``docs`` (doc_id, text) as files; the manifest: a row a file."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = struct.pack("<I", end_id)

    def run(batches):
        part, files, now = TaskContext.get().partitionId(), [], None
        encode = encoder(tokenizer)
        width = 2 if max(encode.size, end_id + 1) <= 1 << 16 else 4

        def close():
            nonlocal now
            path, *about = now.close()
            files.append((path, part, len(files), *about))
            now = None

        for b in batches:
            for at in range(0, b.num_rows, 500):  # few texts at a time, to bound memory
                some = b.slice(at, 500)
                for i, v in zip(some.column(0).to_pylist(), encode.encode(some.column(1).to_pylist()), strict=True):
                    now = now or _OpenFile(folder, f"part-{part:06d}-{len(files):05d}.sst", width)
                    now.add(i, v + end)
                    if len(now.writer) >= file_bytes:
                        close()
        if now:
            close()
        if files:
            types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*files, strict=True), types, strict=True)], names=MANIFEST_NAMES)
        give_back()

    placed = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(placed.mapInArrow(run, MANIFEST), "sst-manifest")


MANIFEST = "path string, part int, file int, entries long, tokens long, first_id long, last_id long"
MANIFEST_NAMES = [x.split()[0] for x in MANIFEST.split(", ")]


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tables(manifest: DataFrame) -> DataFrame:
    """One row a document, read from the files: doc_id, start, n_tokens, ids_crc32."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    many = max(1, min(manifest.count(), 4096))

    def run(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = FileReader(path), []
                for key, value in reader.scan():
                    rows.append((id_of(key), base, len(value) // 4, zlib.crc32(value)))
                    base += len(value) // 4
                    if len(rows) >= 10_000:
                        yield _to_batch(rows)
                        rows = []
                reader.close()
                if rows:
                    yield _to_batch(rows)

    return files.repartition(many, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Digest form: write all documents, then read them back from the files."""
    spark: SparkSession = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-tables/{uuid.uuid4().hex}"
    return read_tables(write_tables(docs, folder))
