"""Token-ID output (6): sorted-string-table shards.

A shard is one file. Documents are keyed by identifier and stored in key order
in blocks; a block's entries drop the prefix that their key shares with the
key before, a block is compressed and carries a checksum. Behind the blocks
come a sparse index (each block's last key and place), a Bloom filter over the
keys, and a footer of fixed size:

    block*  index  bloom  footer
    entry   varint shared, varint rest, varint bytes of value, key rest, value
    index   for each block: varint key length, key, u64 offset, u32 stored, u32 raw, u32 crc32
    footer  u64 index offset, u64 bloom offset, u64 documents, u64 tokens, u32 id width, u32 crc32 of index and bloom, magic

Shards hold ascending key ranges, so a lookup is a binary search over shards,
then over the block index, then within a block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, prepare
from .tokens import encoder, vocabulary

MAGIC = b"SLTSST01"
_FOOTER = struct.Struct("<QQQQII8s")
_PLACE = struct.Struct("<QIII")
#: Raw bytes from which a block is closed.
BLOCK = 64 << 10
_SIGN = 1 << 63


def key_of(doc_id: int | None) -> bytes:
    """Bytes that sort as identifiers do; null comes first."""
    return b"\0" if doc_id is None else b"\1" + ((int(doc_id) + _SIGN) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else int.from_bytes(key[1:], "big") - _SIGN


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b, i: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[i]
        i += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, i
        shift += 7


def _pair(key: bytes) -> tuple[int, int]:
    return zlib.crc32(key), zlib.crc32(key, 0x9E3779B9) | 1


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = _pair(key)
    return [(a + i * b) % bits for i in range(7)]


class Writer:
    """Streams (key, value) pairs in key order to a file; memory is one block, the index and 8 bytes a key."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.tokens = 0
        self.block, self.raw, self.last = [], 0, b""
        self.index, self.keys = bytearray(), array("I")

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [head, value]
        self.raw += len(head) + len(value)
        self.last = key
        self.keys.extend(_pair(key))
        self.docs += 1
        self.tokens += len(value) // self.width
        if self.raw >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            raw = b"".join(self.block)
            data = pa.compress(raw, codec="zstd", asbytes=True)
            self.index += _varint(len(self.last)) + self.last + _PLACE.pack(self.at, len(data), len(raw), zlib.crc32(data))
            self.out.write(data)
            self.at += len(data)
            self.block, self.raw = [], 0

    def close(self) -> None:
        self.flush()
        bits = max(64, 10 * self.docs)
        a, b = np.frombuffer(self.keys, np.uint32).reshape(-1, 2).T.astype(np.uint64)
        bloom = np.zeros(bits, bool)
        for i in range(7):
            bloom[(a + np.uint64(i) * b) % np.uint64(bits)] = True
        bloom = struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        self.out.write(bytes(self.index))
        self.out.write(bloom)
        self.out.write(_FOOTER.pack(self.at, self.at + len(self.index), self.docs, self.tokens, self.width, zlib.crc32(bloom, zlib.crc32(self.index)), MAGIC))


class Reader:
    """One shard. get() is a Bloom probe, two binary searches and one block; items() streams all of it."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        index, bloom, self.docs, self.tokens, self.width, crc, magic = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard of this format")
        tail = self.file.read_at(size - _FOOTER.size - index, index)
        if zlib.crc32(tail) != crc:
            raise ValueError(f"{uri}: index or filter is damaged")
        cut = bloom - index
        self.bits = struct.unpack_from("<Q", tail, cut)[0]
        self.bloom = np.frombuffer(tail, np.uint8, offset=cut + 8)
        self.lasts, self.places, i = [], [], 0
        while i < cut:
            n, i = _read_varint(tail, i)
            self.lasts.append(tail[i : i + n])
            self.places.append(_PLACE.unpack_from(tail, i + n))
            i += n + _PLACE.size

    def _block(self, j: int):
        at, stored, raw, crc = self.places[j]
        data = self.file.read_at(stored, at)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        data = pa.decompress(data, decompressed_size=raw, codec="zstd", asbytes=True)
        i, key = 0, b""
        while i < len(data):
            shared, i = _read_varint(data, i)
            rest, i = _read_varint(data, i)
            n, i = _read_varint(data, i)
            key = key[:shared] + data[i : i + rest]
            i += rest
            yield key, data[i : i + n]
            i += n

    def items(self):
        for j in range(len(self.places)):
            yield from self._block(j)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document with this identifier."""
        key, out = key_of(doc_id), []
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _probes(key, self.bits)):
            return out
        j = bisect.bisect_left(self.lasts, key)
        while j < len(self.lasts):
            block = list(self._block(j))
            at = bisect.bisect_left(block, key, key=lambda e: e[0])
            while at < len(block) and block[at][0] == key:
                out.append(np.frombuffer(block[at][1], f"<u{self.width}"))
                at += 1
            if at < len(block):
                break
            j += 1
        return out


_MANIFEST = "part int, file string, n_docs long, n_tokens long, first binary, last binary"


def write(docs: DataFrame, uri: str, vocab: str | None = None, end_id: int = 2) -> list:
    """Write whole texts' ids plus end_id as shards under uri, in ascending doc_id order.

    Returns the manifest, one row a shard in key order. Null text is empty (the
    end id alone); a null doc_id sorts first; rows with equal doc_id are all
    kept, by text. An empty table writes no shard. A task writes beside and
    then renames, so a retried task replaces its own file.
    """
    vocab = vocab or vocabulary()

    def task(batches):
        enc, part = encoder(vocab), TaskContext.get().partitionId()
        fs, base = pafs.FileSystem.from_uri(uri)
        beside, final = f"{base}/_tmp-{TaskContext.get().taskAttemptId()}", f"{base}/shard-{part:06d}.sst"
        end, writer, out, least = np.array([end_id], enc.dtype).tobytes(), None, None, None
        for batch in batches:
            ids, first = enc.batch(batch.column(1))
            for doc_id, i, j in zip(batch.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(beside)
                    writer, least = Writer(out, enc.dtype.itemsize), key_of(doc_id)
                writer.add(key_of(doc_id), ids[i:j].tobytes() + end)
        if writer is not None:
            writer.close()
            out.close()
            if fs.get_file_info(final).type != pafs.FileType.NotFound:  # of an attempt that was lost after its move; some stores don't move onto a file
                fs.delete_file(final)
            fs.move(beside, final)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [f"shard-{part:06d}.sst"], "n_docs": pa.array([writer.docs], pa.int64()), "n_tokens": pa.array([writer.tokens], pa.int64()), "first": [least], "last": [writer.last]})

    prepare(docs.sparkSession)
    laid = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return sorted(laid.mapInArrow(task, _MANIFEST).collect(), key=lambda r: r["part"])


def read(spark: SparkSession, uri: str, manifest: list) -> DataFrame:
    """doc_id, start (ids in all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit).

    A row for each document written, in any order: nulls, repeats and very long
    documents as write() took them; an empty manifest gives no rows.
    """
    rows, ahead = [], 0
    for r in manifest:
        rows.append((f"{uri}/{r['file']}", ahead))
        ahead += r["n_tokens"]

    def task(batches):
        for batch in batches:
            for file, at in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                cols: tuple[list, ...] = ([], [], [], [])
                held = 0
                shard = Reader(file)
                for key, value in shard.items():
                    ids = np.frombuffer(value, f"<u{shard.width}").astype("<u4")
                    for c, v in zip(cols, (id_of(key), at, len(ids), ids.tobytes()), strict=True):
                        c.append(v)
                    at += len(ids)
                    held += 4 * len(ids)
                    if held > 4 << 20:
                        yield pack(cols)
                        cols, held = ([], [], [], []), 0
                yield pack(cols)

    def pack(cols):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    files = spark.createDataFrame(rows, "file string, at long").repartition(max(1, len(rows)))
    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")


def op6(docs: DataFrame, vocab: str | None = None) -> DataFrame:
    """Write all documents as shards into the shared folder, read them back, and digest each document."""
    uri = new_path(docs.sparkSession, "sst")
    back = read(docs.sparkSession, uri, write(docs, uri, vocab))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
