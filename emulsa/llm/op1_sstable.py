"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order.  Key: one byte (0: null id, 1: not) and the id as a
big-endian unsigned 64-bit number with its sign bit flipped, so byte order is id order.  Layout:

    blocks | sparse index | Bloom filter | footer

Block: entries (shared, unshared: 1 byte each; number of ids: 4 bytes; unshared key bytes; ids), keys
prefix-compressed against the entry before, the first key of a block whole.  Index: per block its first
key (9 bytes), offset (8), size (4), entries (4) and ids before it in the shard (8).  Bloom filter: bits
of ``BITS`` per key, ``PROBES`` probes.  Footer (56 bytes): magic, offsets and sizes, documents, ids.

Null text: empty, so the end id alone.  Equal ids stand side by side in order of their text's hash; where
rows of one id fill several shards, these shards' order, and so ``start`` within that id, may differ between runs.
Empty tables give no shard.  Only id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emulsa.llm.common import cut, shared_dir, slices
from emulsa.llm.wordbpe import WordEncoder, default_path

MAGIC, END = b"EMSST001", 1
BLOCK, SHARD, BITS, PROBES = 64 << 10, 64 << 20, 10, 7
FOOTER = struct.Struct("<8sQIQIIQQI")
INDEX = struct.Struct("<9sQIIQ")
ENTRY = struct.Struct("<BBI")
#: Intervals of keys in which wanted ids and shards meet, at most.
FENCES = 4096
MANIFEST = "shard string, first_key binary, last_key binary, n_docs long, n_ids long, n_bytes long"


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\1" + ((doc_id & (1 << 64) - 1) ^ 1 << 63).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    if not key[0]:
        return None
    v = int.from_bytes(key[1:], "big") ^ 1 << 63
    return v - (1 << 64) if v >> 63 else v


def probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Collects sorted entries; a finished shard is one bytes object of about ``SHARD`` bytes."""

    def __init__(self, wide: bool):
        self.dtype = "<u4" if wide else "<u2"
        self.out, self.block, self.index, self.keys = bytearray(), bytearray(), [], []
        self.before, self.n_ids, self.entries, self.ids_at, self.first = b"", 0, 0, 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, self.before, self.entries, self.ids_at = key, b"", 0, self.n_ids
        shared = next((i for i, (x, y) in enumerate(zip(key, self.before, strict=False)) if x != y), min(len(key), len(self.before)))
        self.block += ENTRY.pack(shared, len(key) - shared, len(ids)) + key[shared:] + ids.astype(self.dtype).tobytes()
        self.before = key
        self.entries += 1
        self.n_ids += len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK:
            self.close_block()

    def close_block(self) -> None:
        if self.block:
            self.index.append(INDEX.pack(self.first, len(self.out), len(self.block), self.entries, self.ids_at))
            self.out += self.block
            self.block = bytearray()

    def finish(self) -> bytes:
        self.close_block()
        index = b"".join(self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.out)
        self.out += index + bloom
        self.out += FOOTER.pack(MAGIC, at, len(self.index), at + len(index), len(bloom), bits, len(self.keys), self.n_ids, int(self.dtype == "<u4"))
        return bytes(self.out)


class ShardReader:
    """Reads a shard through a seekable file: footer, index and filter at once, blocks when asked for."""

    def __init__(self, file):
        self.file = file
        file.seek(file.size() - FOOTER.size)
        magic, at, blocks, bloom_at, bloom_size, self.bits, self.n_docs, self.n_ids, wide = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        raw = file.read(bloom_at - at)
        self.bloom = file.read(bloom_size)
        self.index = [INDEX.unpack_from(raw, i * INDEX.size) for i in range(blocks)]
        self.firsts = [x[0] for x in self.index]
        self.dtype, self.width = ("<u4", 4) if wide else ("<u2", 2)

    def block(self, k: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, its ids)"""
        _, at, size, entries, before = self.index[k]
        self.file.seek(at)
        raw, pos, key = self.file.read(size), 0, b""
        for _ in range(entries):
            shared, own, n = ENTRY.unpack_from(raw, pos)
            pos += ENTRY.size
            key = key[:shared] + raw[pos : pos + own]
            pos += own
            yield key, before, np.frombuffer(raw, self.dtype, n, pos)
            pos += n * self.width
            before += n

    def scan(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """All entries of an id: filter first, then binary search of the index, then its blocks."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        found, k = [], max(0, bisect_right(self.firsts, key) - 1)
        while k and self.firsts[k] == key:
            k -= 1
        while k < len(self.index) and self.firsts[k] <= key:
            found += [ids for other, _, ids in self.block(k) if other == key]
            k += 1
        return found


def opened(path: str):
    fs, inner = pa.fs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def write_shards(docs: DataFrame, folder: str, end: int = END, path: str | None = None) -> DataFrame:
    """Writes the shards into a shared folder and returns the manifest, itself checkpointed.

    A task writes each shard under a name of its own attempt; only names in the manifest count, so a
    repeated task leaves at most an unlisted file behind.
    """
    path = path or default_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of(path)
        wide = encoder.whole.get_vocab_size() > 1 << 16
        fs, inner = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(inner)
        shard = ShardWriter(wide)

        def close(w: ShardWriter) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.sst"
            content = w.finish()
            with fs.open_output_stream(f"{inner}/{name}.part") as f:
                f.write(content)
            fs.move(f"{inner}/{name}.part", f"{inner}/{name}")
            return pa.RecordBatch.from_pydict({"shard": [f"{folder}/{name}"], "first_key": [w.keys[0]], "last_key": [w.keys[-1]], "n_docs": [len(w.keys)], "n_ids": [w.n_ids], "n_bytes": [len(content)]})

        for batch in slices(batches):
            ids, at = encoder.texts(batch.column(1), end)
            for k, doc_id in enumerate(batch.column(0).to_pylist()):
                shard.add(key_of(doc_id), ids[at[k] : at[k + 1]])
                if len(shard.out) >= SHARD:
                    yield close(shard)
                    shard = ShardWriter(wide)
        if shard.keys:
            yield close(shard)

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(write, MANIFEST))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files."""
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("first_key", "last_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.withColumn("before", first).select("shard", "before")  # one small row for each shard
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with opened(name) as f:
                    reader = ShardReader(f)
                    for k in range(len(reader.index)):
                        rows = [(id_of(key), before + at, len(ids), zlib.crc32(ids.astype("<u4"))) for key, at, ids in reader.block(k)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.repartition(n, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, tokens) for the wanted ids that exist, shard by shard through filter and index.

    Wanted ids and shards meet by intervals between at most ``FENCES`` first keys, drawn by a hash; the driver sees
    no more than these, however many shards there are.
    """
    drawn = manifest.select("first_key").distinct().orderBy(F.xxhash64("first_key")).limit(FENCES).collect()
    fences = sorted(bytes(r.first_key) for r in drawn)

    def of_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(fences, key_of(d)) for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0)], names=["interval", "doc_id"])

    def of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in range(bisect_right(fences, r[0]), bisect_right(fences, r[1]) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.string()))], names=["interval", "first_key", "last_key", "shard"])

    def meet(wanted: pa.Table, shards: pa.Table) -> pa.Table:
        shards = sorted(zip(*(shards[c].to_pylist() for c in ("last_key", "first_key", "shard")), strict=True))
        lasts, rows = [x[0] for x in shards], []
        for doc_id in wanted["doc_id"].to_pylist():
            key = key_of(doc_id)
            for _, first, shard in shards[bisect_left(lasts, key) :]:
                if first > key:
                    break
                rows.append((shard, doc_id))
        return pa.table({"shard": pa.array([r[0] for r in rows], pa.string()), "doc_id": pa.array([r[1] for r in rows], pa.int64())})

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, reader = None, None
        for batch in batches:
            got = []
            for shard, doc_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    name, reader = shard, ShardReader(opened(shard))
                got += [(doc_id, ids.tolist()) for ids in reader.get(doc_id)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], names=["doc_id", "tokens"])

    asked = ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().mapInArrow(of_ids, "interval int, doc_id long")
    ranges = manifest.select("first_key", "last_key", "shard").mapInArrow(of_shards, "interval int, first_key binary, last_key binary, shard string")
    wanted = asked.groupBy("interval").cogroup(ranges.groupBy("interval")).applyInArrow(meet, "shard string, doc_id long")
    return wanted.repartition("shard", F.pmod(F.col("doc_id"), F.lit(8))).sortWithinPartitions("shard", "doc_id").mapInArrow(probe, "doc_id long, tokens array<long>")


def shard_folder(spark) -> str:
    return f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}"
