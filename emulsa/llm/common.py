"""Shared helpers: whole-text Arrow batches, ASCII white-space words, packed buckets, checkpoints.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``.  Null text counts as empty everywhere.
"""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
#: Bytes of text whose entries are held in memory at once, as one bucket.
BUCKET_BYTES = 64 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="emulsa-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_dir(df.sparkSession)
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def free_name(docs: DataFrame, name: str) -> str:
    """name, lengthened until no column of docs has it, in any case."""
    used = {c.lower() for c in docs.columns}
    while name in used:
        name += "_"
    return name


def with_row(docs: DataFrame, row: str) -> DataFrame:
    """docs with ``row``, 128 bits of hashes of all columns: equal for rows that agree in everything, and only for those.

    Columns that hold maps count by their JSON, so maps of another order differ.
    """
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    columns = [x for f in docs.schema.fields for x in (plain(f), F.col(f"`{f.name}`").isNull())]
    return docs.withColumn(row, F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), *columns)), 16, "0") for k in (1, 2)]))


def n_buckets(docs: DataFrame, per_partition: int = 4) -> int:
    """Buckets of packed shuffles: some for each of the session's shuffle partitions, and one for each BUCKET_BYTES of text at least."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    return max(per_partition * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to
        give_back()


def give_back() -> None:
    """Returns freed memory to the machine: Spark keeps Python workers, and what they hold, between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def filled(col: pa.Array) -> pa.Array:
    return pc.fill_null(col.cast(pa.string()), "")


def split_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(codes, offsets, dictionary): words of text i are dictionary[codes[offsets[i]:offsets[i + 1]]]."""
    parts = pc.ascii_split_whitespace(filled(col))
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not real.all():
        flat = flat.filter(pa.array(real))
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), offsets, d.dictionary


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit xxh3 of each string's UTF-8 bytes."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(w, seed) for w in strings.cast(pa.binary()).to_pylist()), np.uint64, len(strings))


def distinct(x: np.ndarray) -> np.ndarray:
    """The ascending distinct values; sorting is many times faster here than a table of hashes."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray], chunk: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """One row for each bucket, with each column's values of that bucket as little-endian bytes."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    ends = np.r_[starts[1:], len(b)]
    cols = {k: v[order] for k, v in columns.items()}
    yield pa.RecordBatch.from_pydict(
        {"bucket": pa.array(b[starts].astype(np.int32), pa.int32())}
        | {k: pa.array([v[s:e].tobytes() for s, e in zip(starts, ends, strict=True)], pa.binary()) for k, v in cols.items()}
    )


def unpacked(col, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in col.to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated aranges: starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, np.int64)
    full = np.flatnonzero(lengths > 0)
    s, n = starts[full].astype(np.int64), lengths[full].astype(np.int64)
    at = np.r_[0, np.cumsum(n)[:-1]]
    out[at] = s - np.r_[0, s[:-1] + n[:-1] - 1]
    del ends
    return np.cumsum(out)


def crc_mod(col, n: int):
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n
