"""Counts in a table of fixed size, and a sieve of keys: what a join would drop need not be shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from emulsa.llm.common import mix, packed, unpacked

SLICE_CELLS, SIEVE_BITS = 1 << 16, 1 << 24


def tally(positions: DataFrame, cells: int) -> np.ndarray:
    """How often each cell occurs, for a table of packed (bucket, cells, counts): 4 log2 of the counts, in ``cells`` bytes."""

    def add(table: pa.Table) -> pa.Table:
        total = np.bincount(unpacked(table["cells"], "<u2"), weights=unpacked(table["counts"], "<u2"), minlength=SLICE_CELLS)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "classes": [np.ceil(4 * np.log2(total + 1)).astype(np.uint8).tobytes()]})

    out = np.zeros(cells, np.uint8)
    for r in positions.groupBy("bucket").applyInArrow(add, "bucket int, classes binary").collect():  # ``cells`` bytes in all
        out[r.bucket * SLICE_CELLS : (r.bucket + 1) * SLICE_CELLS] = np.frombuffer(bytes(r.classes), np.uint8)
    return out


def used_cells(seen: np.ndarray) -> Iterator[pa.RecordBatch]:
    used = np.flatnonzero(seen)
    yield from packed((used // SLICE_CELLS).astype(np.int32), {"cells": (used % SLICE_CELLS).astype("<u2"), "counts": np.minimum(seen[used].astype(np.uint32), 65535).astype("<u2")})


def sieve(keys: DataFrame) -> np.ndarray:
    """SIEVE_BITS bits, one set for each wanted key (the one long column): a key without its bit is not wanted.

    A bounded broadcast: with very many keys all bits are set, and only the join after it decides.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SIEVE_BITS, np.uint8)
        for batch in batches:
            seen[place(batch.column(0).to_numpy())] = 1
        yield from used_cells(seen)

    return np.packbits(tally(keys.mapInArrow(mark, "bucket int, cells binary, counts binary"), SIEVE_BITS) > 0)


def place(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) % np.uint64(SIEVE_BITS)).astype(np.int64)


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = place(keys)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
