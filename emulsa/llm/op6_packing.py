"""Best-fit packing by length patterns fitted with non-negative least squares.

The lengths of all pieces form a histogram of at most ``window`` counts, which alone reaches the
driver.  There, patterns of one to three lengths that fill a sequence exactly are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded down, and what is
left over is packed best-fit-decreasing, still as counts.  The plan says, for the r-th piece of length
l, in which sequence and where it lies; pieces learn their rank from per-chunk counts.

Both sides of the final cogroup come from the same rows, so a chunk has its ranks whenever it has pieces.

Null and empty texts have the end id alone.  Repeated rows are packed each for itself.  An empty table
gives an empty result.  Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emulsa.llm.common import cut, slices
from emulsa.llm.wordbpe import WordEncoder, default_path

WINDOW, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk string"


def pieces(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None) -> DataFrame:
    """Every document's ids in pieces of at most ``window``; ``chunk`` names the batch they came from."""
    path = path or default_path()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = WordEncoder.of(path), TaskContext.get().partitionId()
        for k, batch in enumerate(slices(batches)):
            ids, at = encoder.texts(batch.column(1), end)
            n = np.diff(at)
            count = -(-n // window)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * window
            length = np.minimum(window, n[doc] - start)
            first = at[doc] + start
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[s : s + m]) for s, m in zip(first, length, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([f"{task:07d}-{k:06d}"] * len(doc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "chunk"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut_up, PIECES)


def fit_patterns(hist: np.ndarray, window: int, step: int = 8, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of three lengths, 0: none) and their fitted, rounded counts."""
    lengths = np.flatnonzero(hist)
    lengths = lengths[lengths < window]
    pair = np.array([(0, a, window - a) for a in lengths if 2 * a <= window and hist[window - a]], np.int64).reshape(-1, 3)
    triple = []
    coarse = lengths[:: max(1, step * len(lengths) // max(1, window))]
    for a in coarse:
        b = lengths[(lengths >= a) & (2 * lengths <= window - a)]
        b = b[hist[window - a - b] > 0]
        triple.append(np.stack([np.full(len(b), a), b, window - a - b], 1))
    patterns = np.concatenate([pair, *triple]).astype(np.int64) if len(pair) or triple else np.empty((0, 3), np.int64)
    if not len(patterns):
        return patterns, np.empty(0, np.int64)
    target = hist.astype(float).copy()
    target[0] = 0
    used = patterns > 0
    # rows: lengths, columns: patterns; each column has two or three entries, so products are sums by index
    times = lambda x: np.bincount(patterns.ravel(), weights=(used * x[:, None]).ravel(), minlength=len(hist))
    back = lambda y: (np.where(used, y[patterns], 0)).sum(1)
    # the largest eigenvalue of A'A, by power iteration, sets the step of accelerated projected gradient
    v = np.ones(len(patterns))
    for _ in range(20):
        w = back(times(v))
        top = np.linalg.norm(w) / np.linalg.norm(v)
        v = w / np.linalg.norm(w)
    x = z = np.zeros(len(patterns))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - back(times(z) - target) / (1.05 * top))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    counts = np.floor(x).astype(np.int64)
    left = hist.astype(np.int64).copy()
    for k in np.argsort(-counts, kind="stable"):
        if not counts[k]:
            break
        need = np.bincount(patterns[k][used[k]], minlength=len(hist))
        where = np.flatnonzero(need)
        counts[k] = min(counts[k], int((left[where] // need[where]).min()))
        left[where] -= need[where] * counts[k]
    return patterns, counts


def best_fit(hist: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit-decreasing over counts: [(lengths of a sequence, how many such sequences)]."""
    room: dict[int, list[list]] = {}
    for length in range(window, 0, -1):
        n = int(hist[length])
        while n:
            space = min((r for r in room if r >= length), default=None)
            if space is None:
                per = window // length
                full, rest = divmod(n, per)
                for count, m in ((full, per), (1, rest)):
                    if count and m:
                        room.setdefault(window - m * length, []).append([(length,) * m, count])
                n = 0
                break
            group = room[space].pop()
            if not room[space]:
                del room[space]
            per = space // length
            count = min(group[1], n // per)
            if count:
                room.setdefault(space - per * length, []).append([group[0] + (length,) * per, count])
                n -= count * per
                if group[1] > count:
                    room.setdefault(space, []).append([group[0], group[1] - count])
            else:  # fewer are left than one sequence of the group takes
                room.setdefault(space - n * length, []).append([group[0] + (length,) * n, 1])
                if group[1] > 1:
                    room.setdefault(space, []).append([group[0], group[1] - 1])
                n = 0
    return [(tuple(p), c) for groups in room.values() for p, c in groups]


def make_plan(hist: np.ndarray, window: int) -> tuple[dict[int, np.ndarray], int]:
    """For each length, rows (first rank, first sequence, offset in it); and the number of sequences."""
    left = hist.astype(np.int64).copy()
    patterns, counts = fit_patterns(hist, window)
    chosen = [(tuple(int(v) for v in p if v), int(c)) for p, c in zip(patterns, counts, strict=True) if c]
    for p, c in chosen:
        for v in p:
            left[v] -= c
    chosen += best_fit(left, window)
    rank = np.zeros(window + 1, np.int64)
    plan: dict[int, list] = {}
    sequence = 0
    for p, c in chosen:
        offset = 0
        for v in sorted(p, reverse=True):
            plan.setdefault(v, []).append((rank[v], sequence, offset))
            rank[v] += c
            offset += v
        sequence += c
    return {k: np.array(v, np.int64) for k, v in plan.items()}, sequence


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, path: str | None = None) -> DataFrame:
    """One row for each piece with its ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, window, end, path))
    by_chunk = rows.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    by_chunk = cut(by_chunk.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    hist = np.zeros(window + 1, np.int64)
    for length, n in by_chunk.groupBy("length").agg(F.sum("n")).collect():  # at most ``window`` rows
        hist[length] = n
    plan, _ = make_plan(hist, window)
    plan = spark.sparkContext.broadcast(plan)

    def place(rows: pa.Table, firsts: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        length = rows["length"].to_numpy()
        order = np.argsort(length, kind="stable")
        sorted_l = length[order]
        local = np.empty(len(length), np.int64)
        local[order] = np.arange(len(length)) - np.searchsorted(sorted_l, sorted_l)
        first = np.zeros(window + 1, np.int64)
        first[firsts["of"].to_numpy()] = firsts["first_rank"].to_numpy()
        rank = local + first[length]
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for v in np.unique(length):
            at, p = np.flatnonzero(length == v), plan.value[int(v)]
            k = np.searchsorted(p[:, 0], rank[at], "right") - 1
            sequence[at], offset[at] = p[k, 1] + rank[at] - p[k, 0], p[k, 2]
        return rows.drop_columns(["chunk"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    out = PIECES.removesuffix(", chunk string") + ", sequence_id long, offset long"
    # columns of their own: both sides come from ``rows``, and shared identities are pruned away under an aggregate
    firsts = by_chunk.select(F.concat("chunk", F.lit("")).alias("of_chunk"), (F.col("length") + 0).alias("of"), (F.col("first") + 0).alias("first_rank"))
    return rows.groupBy("chunk").cogroup(firsts.groupBy("of_chunk")).applyInArrow(place, out)
