"""Token ids in sorted-string-table shards.

A shard file holds, in key order, prefix-compressed entries in compressed
blocks, then a sparse index (first key, place and size of each block), a Bloom
filter of the keys and a fixed footer.  `Table.get` asks the Bloom filter,
finds the block by binary search in the index and searches it; `lookup` does so
for a table of keys, whose shards follow from the manifest.

Keys are document ids, big-endian with the sign bit turned, so bytes sort as
integers do; a null id is the empty-most key.  Values are the ids, 16 bits each
where they all fit and 32 bits otherwise.

Defined results: a null or empty text is its end id alone; null ids come first;
rows that repeat an id are all kept, in text order; an empty table makes no
file and no row; a very long text is one entry, in a block of its own.  Other
input columns are not read.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.kernels import U64, mix, trim
from larder.llm.staging import Stage, partitions_for
from larder.llm.tokens import default_path, encoder

MAGIC = b"LRDRSST1"
FOOTER = struct.Struct("<QQQQQQI8s")
ENTRY = struct.Struct("<HHIB")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _bloom_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """For each 64-bit key the places of its bits, by double hashing."""
    a, b = mix(keys), mix(keys ^ U64(0x5851F42D4C957F2D)) | U64(1)
    return (a[:, None] + np.arange(BLOOM_HASHES, dtype=U64) * b[:, None]) % U64(bits)


def _bloom_key(key: bytes) -> int:
    return int.from_bytes(key[1:], "big") if key[0] else 0x0DDC0FFEE


def filesystem(uri: str):
    """The file system and path of a URI of the shared folder (local, HDFS, S3 or GCS)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file:///{uri.removeprefix('file:').lstrip('/')}")


class Writer:
    """Appends entries in key order; a few blocks, the index and the keys' hashes are all it holds."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.zip = sink, zstandard.ZstdCompressor(level=1)
        self.at = self.entries = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.block, self.first, self.last, self.least = bytearray(), b"", b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.entries:
            self.least = key
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        top = min(len(key), len(self.last))
        while shared < top and key[shared] == self.last[shared]:
            shared += 1
        wide = bool(len(ids) and ids.max() > 0xFFFF)
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += ENTRY.pack(shared, len(key) - shared, len(value), wide) + key[shared:] + value
        self.last = key
        self.hashes.append(_bloom_key(key))
        self.entries += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _put(self, raw: bytes) -> tuple[int, int]:
        self.sink.write(raw)
        self.at += len(raw)
        return self.at - len(raw), len(raw)

    def _end_block(self) -> None:
        raw = self.zip.compress(bytes(self.block))
        at, size = self._put(raw + struct.pack("<I", zlib.crc32(raw)))
        self.index.append((self.first, at, size))
        self.block = bytearray()

    def finish(self) -> None:
        if self.block:
            self._end_block()
        index_at, index_size = self._put(b"".join(struct.pack("<HQQ", len(k), at, n) + k for k, at, n in self.index))
        bits = max(64, BLOOM_BITS * len(self.hashes))
        bloom = np.zeros(-(-bits // 8), dtype=np.uint8)
        places = _bloom_places(np.array(self.hashes, dtype=U64), bits).ravel() if self.hashes else np.zeros(0, U64)
        np.bitwise_or.at(bloom, (places >> U64(3)).astype(np.int64), (1 << (places & U64(7)).astype(np.int64)).astype(np.uint8))
        bloom_at, _ = self._put(bloom.tobytes())
        head = struct.pack("<QQQQQQ", index_at, index_size, bloom_at, bits, self.entries, self.tokens)
        self._put(head + struct.pack("<I8s", zlib.crc32(head), MAGIC))


class Table:
    """Reads one shard file."""

    def __init__(self, source):
        import zstandard

        self.source, self.unzip = source, zstandard.ZstdDecompressor()
        size = source.size()
        if size < FOOTER.size:
            raise ValueError("not a shard file: too short")
        raw = self._at(size - FOOTER.size, FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.entries, self.tokens, crc, magic = FOOTER.unpack(raw)
        if magic != MAGIC or zlib.crc32(raw[:48]) != crc:
            raise ValueError("not a shard file: bad footer")
        self.bloom = np.frombuffer(self._at(bloom_at, -(-self.bits // 8)), dtype=np.uint8)
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        raw, at = self._at(index_at, index_size), 0
        while at < len(raw):
            k, place, n = struct.unpack_from("<HQQ", raw, at)
            self.keys.append(raw[at + 18 : at + 18 + k])
            self.places.append((place, n))
            at += 18 + k

    def _at(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        raw = self._at(*self.places[i])
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("bad block checksum")
        raw, at, last = self.unzip.decompress(raw[:-4]), 0, b""
        while at < len(raw):
            shared, more, n, wide = ENTRY.unpack_from(raw, at)
            at += ENTRY.size
            last = last[:shared] + raw[at : at + more]
            at += more
            yield last, np.frombuffer(raw, "<u4" if wide else "<u2", n // (4 if wide else 2), at)
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.places)):
            yield from self.block(i)

    def maybe(self, key: bytes) -> bool:
        places = _bloom_places(np.array([_bloom_key(key)], dtype=U64), self.bits)[0]
        return bool(np.all(self.bloom[(places >> U64(3)).astype(np.int64)] >> (places & U64(7)).astype(np.uint8) & 1))

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The first entry with the key, or None."""
        key = key_of(doc_id)
        if not self.maybe(key):
            return None
        i = max(0, bisect.bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            entries = list(self.block(i))
            j = bisect.bisect_left(entries, key, key=lambda e: e[0])
            if j < len(entries) and entries[j][0] == key:
                return entries[j][1]
            i += 1
        return None


MANIFEST = "shard int, path string, n_docs long, n_tokens long, first long, last long"


def write_shards(docs: DataFrame, root: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encodes and writes all documents in key order; returns the manifest, one entry per shard."""
    path = tokenizer or default_path()
    end = np.array([end_id], dtype="<u4")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, out, name = encoder(path), TaskContext.get().partitionId(), None, ""
        for batch in batches:
            for lo, hi, found, cuts in enc.column(batch.column(1)):
                if out is None:  # each attempt writes a file of its own; the manifest names the one that counts
                    system, folder = filesystem(root)
                    system.create_dir(folder, recursive=True)
                    name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.sst"
                    out = Writer(system.open_output_stream(name, compression=None))
                for key, a, b in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    out.add(key_of(key), np.concatenate([found[a:b], end]))
        trim()
        if out is not None:
            out.finish()
            out.sink.close()
            numbers = [shard, out.entries, out.tokens, id_of(out.least), id_of(out.last)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([numbers[0]], pa.int32()), pa.array([f"{root}/{name.rsplit('/', 1)[1]}"]), *(pa.array([n], pa.int64()) for n in numbers[1:])],
                names=["shard", "path", "n_docs", "n_tokens", "first", "last"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(shards or partitions_for(rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return sorted((r.asDict() for r in rows.mapInArrow(write, MANIFEST).collect()), key=lambda r: r["shard"])  # a row per shard


READ = "doc_id long, start long, n_tokens long, ids binary"


def read_shards(spark, manifest: list[dict]) -> DataFrame:
    """All documents of the shards, with their place in the whole sequence of ids."""
    starts, total = [], 0
    for m in manifest:
        starts.append((m["path"], total))
        total += m["n_tokens"]
    files = spark.createDataFrame(starts, "path string, start long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = filesystem(name)
                with system.open_input_file(place) as f:
                    held, size = [], 0
                    for key, ids in Table(f):
                        held.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    return files.repartition(max(1, len(starts))).mapInArrow(read, READ)


def lookup(spark, manifest: list[dict], keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The first entry of each key asked for that is there: doc_id, n_tokens, ids.

    A key's shard follows from the manifest's last keys by binary search; keys meet by shard, and each shard's file is
    opened once for its keys, of which the Bloom filter and the sparse index read one block at most.
    """
    lasts = np.array([m["last"] if m["last"] is not None else -(1 << 63) for m in manifest], dtype=np.int64)
    paths = [m["path"] for m in manifest]

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lasts, ids.to_numpy(dtype=np.int64), "left").astype(np.int32))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, file = -1, None, None
        for batch in batches:
            held = []
            for key, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if file is not None:
                        file.close()
                    system, place = filesystem(paths[shard])
                    at, file = shard, system.open_input_file(place)
                    table = Table(file)
                ids = table.get(key)
                if ids is not None:
                    held.append((key, len(ids), ids.astype("<u4").tobytes()))
            if held:
                c = list(zip(*held, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary())], names=["doc_id", "n_tokens", "ids"])
        if file is not None:
            file.close()

    asked = keys.select(F.col(doc_id).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    asked = asked.withColumn("shard", shard_of("doc_id")).where(F.col("shard") < len(paths))
    return asked.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(find, "doc_id long, n_tokens long, ids binary")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*held, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())],
        names=["doc_id", "start", "n_tokens", "ids"]
    )


def op6_token_sstable(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, Stage(spark, "op6").path("shards"))
    return read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
