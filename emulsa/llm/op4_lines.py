"""Line dedup by content-defined chunks of lines.

Each line is hashed, and a rolling hash is taken over the hashes of ``WINDOW`` lines.  A chunk ends after a line
(neither the first nor the last) whose rolling hash is less than those of the lines before and after it.  So a
boundary depends on ``WINDOW + 2`` lines around it and on nothing else: an insertion moves only the boundaries
next to it, and passages that agree are cut alike but for ``WINDOW`` lines at their start and one at their end.
Chunks have two lines or more (but for the last of a text, which may be one line) and about three in the mean.
What is certain to go of a repeated passage is all between its first and last common boundary; a passage of
fewer than six lines may have no two of them and stay.

Chunks of two or more lines that occur more than once in the table are removed but for the first, by
(id, place).  Chunks are found by a 128-bit hash; the bytes under each hash are then compared, by grouping
on hash and bytes, and a hash that stands for different bytes removes nothing.  The places of the ``HOT`` most
frequent chunks are marked by a broadcast of their hashes, those of all others by a join.

Null text: empty, one empty line.  Single-line chunks always stay.  Null ids come first; rows with equal
ids are told apart by a 128-bit hash of id and text; rows that agree in everything share one fate.  Very long
texts are read whole.  An empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import cut, filled, mix, slices

WINDOW, HOT = 2, 4096
FACTOR = 0x9E3779B97F4A7C15


def rolled(lines: list[str]) -> np.ndarray:
    """The rolling hash of the WINDOW lines up to each line."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines))
    out, factor = h.copy(), 1
    for k in range(1, WINDOW):
        factor = factor * FACTOR % (1 << 64)
        out[k:] += h[:-k] * np.uint64(factor)
    return mix(out)


def chunks(lines: list[str]) -> list[tuple[int, int]]:
    """(first line, end) of each chunk of the lines."""
    r = rolled(lines)
    ends = (np.flatnonzero((r[1:-1] < r[:-2]) & (r[1:-1] < r[2:])) + 2).tolist()
    return list(zip([0, *ends], [*ends, len(lines)], strict=True))


def chunk_table(rows: DataFrame) -> DataFrame:
    """row, doc_id, chunk, n_lines, key and bytes of each chunk; rows has row, doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            out = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), filled(batch.column(2)).to_pylist(), strict=True):
                lines = text.split("\n")
                for k, (s, e) in enumerate(chunks(lines)):
                    if e - s > 1:
                        body = "\n".join(lines[s:e])
                        out.append((row, doc_id, k, e - s, xxhash.xxh3_128_digest(body), body))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)], names=["row", "doc_id", "chunk", "n_lines", "key", "body"])

    return rows.select("row", "doc_id", "text").mapInArrow(run, "row binary, doc_id long, chunk int, n_lines int, key binary, body string")


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), kept_sha256 and text (the lines that stay) of every row."""
    text = F.coalesce("text", F.lit(""))
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(k), "doc_id", text)), 16, "0") for k in (1, 2)]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row", F.unhex(F.concat(*halves)))
    table = chunk_table(rows)
    first = F.min(F.struct("doc_id", "row", "chunk")).alias("first")
    # equal bytes meet map-side; only hashes, counts and the first places go on
    variants = table.groupBy("key", "body").agg(first, F.count("*").alias("n")).select("key", "first", "n")
    repeated = variants.groupBy("key").agg(F.count("*").alias("variants"), F.first("first").alias("first"), F.sum("n").alias("n")).where("variants = 1 and n > 1").select("key", "first", "n")
    repeated = cut(repeated)
    hot = cut(repeated.orderBy(F.desc("n"), "key").limit(HOT).select("key", "first"))
    rare = repeated.select("key", "first").join(F.broadcast(hot.select("key")), "key", "left_anti")
    places = cut(table.select("row", "chunk", "key").join(F.broadcast(hot), "key", "left"))
    marked = places.where("first is not null").unionByName(places.where("first is null").drop("first").join(rare, "key"))
    gone = marked.where("not (first.row = row and first.chunk = chunk)").groupBy("row").agg(F.collect_set("chunk").alias("gone"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=8 << 20):
            out = []
            for doc_id, text, drop in zip(batch.column(0).to_pylist(), filled(batch.column(1)).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, drop = text.split("\n"), set(drop or ())
                stay = [x for k, (s, e) in enumerate(chunks(lines)) if k not in drop for x in lines[s:e]]
                kept = "\n".join(stay)
                out.append((doc_id, len(lines), len(lines) - len(stay), hashlib.sha256(kept.encode()).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "text"])

    return rows.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(rebuild, "doc_id long, n_lines long, n_removed long, kept_sha256 string, text string")
