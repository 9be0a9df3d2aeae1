"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts earlier are removed.

Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the least by a hash (the leftmost of equals)
is its anchor, which depends on the string alone.  An anchor serves a run of neighbouring starts and has
a context: all bytes of their strings.  Equal strings have equal anchors at equal places, so comparing
contexts around equal anchors finds every repeat, while about one position in 35 is an anchor.

1. Anchors go to buckets by gram hash, each with a hash of its context; a batch sends each context once.
   Of equal contexts all but the earliest are settled: all their strings start earlier elsewhere.
2. Where a gram has several contexts, one of each sends its bytes.  A bucket puts the parts right and
   (reversed) left of the gram in suffix order, by deep-shallow sorting: multikey quicksort on
   eight-byte words to a depth of ``SHALLOW`` bytes, then a blind trie for each group with a longer
   common prefix.  The common prefixes of neighbours tell, for each place of the gram in a string, which
   strings are equal, byte by byte; all but the earliest are marked.
3. The spans go back to their documents, whose text is read again.  Texts that have no span, or no open
   anchor in step 2, are sifted out where they are read and not shuffled.

Order: by id (null first), then by the text's hash where ids repeat or are null (such input is sorted in
ranges and numbered within them).  Rows that agree in everything count as one after another.  Null text:
empty.  Texts under LENGTH bytes lose nothing.  Only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import cut, filled, mix, n_buckets, packed, slices, unpacked
from emulsa.llm.sieve import passes, sieve

LENGTH, GRAM, SHALLOW = 100, 32, 16
SIDE = LENGTH - GRAM
SLICE = 4 << 20
FIRST = np.dtype([("gram", "<u8"), ("context", "<u8"), ("uid", "<i8"), ("pos", "<i4"), ("low", "u1"), ("high", "u1"), ("flag", "u1")])
REPLY = np.dtype([("uid", "<i8"), ("pos", "<i4"), ("low", "u1"), ("high", "u1"), ("flag", "u1")])
BYTES = np.dtype([("gram", "<u8"), ("uid", "<i8"), ("pos", "<i4"), ("low", "u1"), ("high", "u1"), ("left", "u1", SIDE), ("right", "u1", SIDE)])
SPAN = np.dtype([("uid", "<i8"), ("start", "<i4"), ("end", "<i4")])
SETTLED, OPEN = 0, 1


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position on, by doubling."""
    h = mix(raw.astype(np.uint64) + np.uint64(1))
    factor, n = np.uint64(0x9E3779B97F4A7C15), 1
    while n < GRAM:
        with np.errstate(over="ignore"):
            h = h[:-n] * factor + h[n:]
            factor = factor * factor
        n *= 2
    return mix(h)


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first start, last start) of each anchor; texts are raw[offsets[i]:offsets[i + 1]]."""
    none = np.empty(0, np.int64)
    if len(raw) < LENGTH:
        return none.astype(np.uint64), none, none, none
    h = gram_hashes(raw)
    low = np.uint64((1 << 31) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    span, n = SIDE + 1, 1
    while 2 * n <= span:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    if n < span:
        least = np.minimum(least[: -(span - n)], least[span - n :])
    starts = np.ones(len(least), bool)
    for e in offsets[1:]:  # a string lies within one text
        starts[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(starts)
    if not len(at):
        return none.astype(np.uint64), none, none, none
    q = (least[at] & low).astype(np.int64)
    change = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[change[1:] - 1, len(q) - 1]
    return h[q[change]], q[change], at[change], at[last]


def joined(col: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    texts = filled(col).cast(pa.binary()).to_pylist()
    raw = b"".join(texts)
    return np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64), raw


def uid_bucket(uid: np.ndarray, n: int) -> np.ndarray:
    return (mix(uid.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def multikey_quicksort(keys: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Groups, in order, of the entries ``at`` that agree in all columns of ``keys``."""
    out, stack = [], [(at, 0)]
    while stack:
        at, depth = stack.pop()
        if len(at) == 1 or depth == keys.shape[1]:
            out.append(at)
            continue
        k = keys[at, depth]
        pivot = np.partition(k, len(k) // 2)[len(k) // 2]
        less, same = k < pivot, k == pivot
        for part, d in ((at[~(less | same)], depth), (at[same], depth + 1), (at[less], depth)):
            if len(part):
                stack.append((part, d))
    return out


class BlindTrie:
    """Orders strings of one length by branching bytes alone; one comparison with a leaf per insertion."""

    def __init__(self):
        self.root = None

    def add(self, text: bytes, entry: int) -> None:
        if self.root is None:
            self.root = [len(text), text, [entry]]
            return
        node = self.root
        while type(node[2]) is dict:  # blind: skipped bytes are not looked at
            node = node[2].get(text[node[0]]) or next(iter(node[2].values()))
        other = node[1]
        if other == text:
            node[2].append(entry)
            return
        x = int.from_bytes(other, "big") ^ int.from_bytes(text, "big")
        common = len(text) - (x.bit_length() + 7) // 8
        leaf, above, node = [len(text), text, [entry]], None, self.root
        while node[0] < common:
            above, node = node, node[2][text[node[0]]]
        if node[0] == common:
            node[2][text[common]] = leaf
            return
        split = [common, None, {other[common]: node, text[common]: leaf}]
        if above is None:
            self.root = split
        else:
            above[2][text[above[0]]] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node[2]) is dict:
                stack += [node[2][c] for c in sorted(node[2], reverse=True)]
            else:
                out += node[2]
        return out


def deep_shallow(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows of ``text`` by group and bytes, common prefix with the row before, -1 at a new group)."""
    wide = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    wide[:, : text.shape[1]] = text
    words = wide[:, :SHALLOW].copy().view(">u8").astype(np.uint64)
    keys = np.concatenate([group[:, None].astype(np.uint64), words], 1)
    order = []
    for part in multikey_quicksort(keys, np.arange(len(text))):
        if len(part) > 1:
            trie = BlindTrie()
            for k in part.tolist():
                trie.add(text[k].tobytes(), k)
            order += trie.order()
        else:
            order += part.tolist()
    order = np.array(order, np.int64)
    differ = text[order[1:]] != text[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), text.shape[1]) if len(order) > 1 else np.empty(0, np.int64)
    return order, np.r_[-1, np.where(group[order[1:]] == group[order[:-1]], common, -1)]


def repeats(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, start) of every string of the entries that starts earlier in another entry."""
    e_order = np.lexsort((e["pos"], e["uid"]))
    group = np.unique(e["gram"], return_inverse=True)[1]
    right, right_common = deep_shallow(group, np.ascontiguousarray(e["right"]))
    left, left_common = deep_shallow(group, np.ascontiguousarray(e["left"]))
    rank = np.empty(len(e), np.int64)
    rank[e_order] = np.arange(len(e))
    which, starts = [], []
    for o in range(SIDE + 1):
        of_right, of_left = np.empty(len(e), np.int64), np.empty(len(e), np.int64)
        of_right[right] = np.cumsum(right_common < SIDE - o)
        of_left[left] = np.cumsum(left_common < o)
        on = np.flatnonzero((e["low"] <= o) & (o <= e["high"]))
        if not len(on):
            continue
        key = of_right[on] * (len(e) + 1) + of_left[on]
        by = np.lexsort((rank[on], key))
        on, key = on[by], key[by]
        head = np.r_[True, key[1:] != key[:-1]]
        first = on[np.flatnonzero(head)[np.cumsum(head) - 1]]
        later = (e["uid"][on] != e["uid"][first]) | (e["pos"][on] != e["pos"][first])
        which.append(on[later])
        starts.append(e["pos"][on[later]] - o)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *which]), np.concatenate([none, *starts])


def numbered(docs: DataFrame, rest: list[str] | None = None) -> DataFrame:
    """uid (order of rows), doc_id, text and, as a struct, the columns named in rest."""
    more = ["rest"] if rest else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    ids = rows.select("doc_id").groupBy("doc_id").count().where("doc_id is null or count > 1")
    if ids.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "text", *more)
    hashed = rows.select(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"), "doc_id", "text", *more)
    order = [F.col("doc_id").asc_nulls_first(), "h", "text"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges of rows, each sorted; a row's number is the size of the ranges before its own and its place there
    ranged = cut(hashed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("h"))
    placed = ranged.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place"), "doc_id", "text", *more)
    sizes = {r.part: r["count"] for r in placed.groupBy("part").count().collect()}  # one row a partition
    before = [0]
    for k in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(k, 0))
    return placed.select((F.get(F.lit(before).cast("array<bigint>"), F.col("part")) + F.col("place")).alias("uid"), "doc_id", "text", *more)


def spans(rows: DataFrame) -> DataFrame:
    """For each uid that loses bytes: ``settled`` (anchors) and ``marked`` (spans), packed; rows has uid and text."""
    n = n_buckets(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            raw, offsets, data = joined(batch.column(1))
            h, q, first, last = anchors(raw, offsets)
            doc = np.searchsorted(offsets, first, "right") - 1
            out = np.empty(len(h), FIRST)
            out["gram"], out["uid"], out["pos"] = h, batch.column(0).to_numpy()[doc], q - offsets[doc]
            out["low"], out["high"], out["flag"] = q - last, q - first, OPEN
            digest, view = xxhash.xxh3_64_intdigest, memoryview(data)
            out["context"] = np.fromiter((digest(view[s:e]) for s, e in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)), np.uint64, len(h))
            by = np.lexsort((out["pos"], out["uid"], out["context"], out["gram"]))
            out = out[by]
            again = np.r_[False, (out["gram"][1:] == out["gram"][:-1]) & (out["context"][1:] == out["context"][:-1])] if len(out) else np.empty(0, bool)
            out["flag"][again] = SETTLED
            yield from packed((out["gram"] % np.uint64(n)).astype(np.int32), {"rows": out})

    def settle(table: pa.Table) -> pa.Table:
        e = unpacked(table["rows"], FIRST)
        done, e = e[e["flag"] == SETTLED], e[e["flag"] == OPEN]
        e = e[np.lexsort((e["pos"], e["uid"], e["context"], e["gram"]))]
        new_gram = np.r_[True, e["gram"][1:] != e["gram"][:-1]]
        new = new_gram | np.r_[True, e["context"][1:] != e["context"][:-1]]
        e["flag"][~new] = SETTLED
        per_gram = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_gram)) if len(e) else np.empty(0, np.int64)
        several = per_gram[np.cumsum(new_gram) - 1] > 1
        out = np.concatenate([done, e[~new | several]])
        reply = np.empty(len(out), REPLY)
        for k in REPLY.names:
            reply[k] = out[k]
        parts = list(packed(uid_bucket(reply["uid"], n), {"rows": reply}))
        return pa.Table.from_batches(parts, schema=pa.schema([("bucket", pa.int32()), ("rows", pa.binary())]))

    def by_uid(table: pa.Table, dtype: np.dtype) -> tuple[np.ndarray, list[np.ndarray]]:
        e = unpacked(table["rows"], dtype)
        e = e[np.argsort(e["uid"], kind="stable")]
        at = np.flatnonzero(np.r_[True, e["uid"][1:] != e["uid"][:-1]])
        return e["uid"][at], np.split(e, at[1:])

    def gather(table: pa.Table) -> pa.Table:
        uid, each = by_uid(table, REPLY)
        return pa.table({"uid": pa.array(uid, pa.int64()), "settled": pa.array([x[x["flag"] == SETTLED].tobytes() or None for x in each], pa.binary()), "open": pa.array([x[x["flag"] == OPEN].tobytes() or None for x in each], pa.binary())})

    first = rows.select("uid", "text").mapInArrow(send, "bucket int, rows binary").groupBy("bucket").applyInArrow(settle, "bucket int, rows binary")
    first = cut(first.groupBy("bucket").applyInArrow(gather, "uid long, settled binary, open binary"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            parts = []
            for text, marks in zip(filled(batch.column(0)).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                e = np.frombuffer(marks, REPLY)
                raw = np.frombuffer(bytes(SIDE) + text + bytes(SIDE), np.uint8)
                out = np.empty(len(e), BYTES)
                for k in ("uid", "pos", "low", "high"):
                    out[k] = e[k]
                at = e["pos"].astype(np.int64) + SIDE
                out["gram"] = [xxhash.xxh3_64_intdigest(text[p : p + GRAM]) for p in e["pos"].tolist()]
                out["left"] = raw[at[:, None] - 1 - np.arange(SIDE)]
                out["right"] = raw[at[:, None] + GRAM + np.arange(SIDE)]
                # beyond its own strings a context has zeros, so that equal ones are equal
                out["left"][np.arange(SIDE) >= e["high"][:, None]] = 0
                out["right"][np.arange(SIDE) >= SIDE - e["low"][:, None]] = 0
                parts.append(out)
            out = np.concatenate(parts)
            yield from packed((out["gram"] % np.uint64(n)).astype(np.int32), {"rows": out})

    def compare(table: pa.Table) -> pa.Table:
        e = unpacked(table["rows"], BYTES)
        entry, start = repeats(e)
        uid = e["uid"][entry]
        by = np.lexsort((start, uid))
        uid, start = uid[by], start[by].astype(np.int64)
        parts = []
        if len(uid):
            new = np.r_[True, (uid[1:] != uid[:-1]) | (start[1:] > start[:-1] + LENGTH)]
            at = np.flatnonzero(new)
            out = np.empty(len(at), SPAN)
            out["uid"], out["start"] = uid[at], start[at]
            out["end"] = start[np.r_[at[1:] - 1, len(uid) - 1]] + LENGTH
            parts = list(packed(uid_bucket(out["uid"], n), {"rows": out}))
        return pa.Table.from_batches(parts, schema=pa.schema([("bucket", pa.int32()), ("rows", pa.binary())]))

    def gather_spans(table: pa.Table) -> pa.Table:
        uid, each = by_uid(table, SPAN)
        return pa.table({"uid": pa.array(uid, pa.int64()), "marked": pa.array([x.tobytes() for x in each], pa.binary())})

    opened = first.where("open is not null").select("uid", "open")
    asked = sifted(rows.select("uid", "text"), opened).join(opened, "uid").select("text", "open")
    second = asked.mapInArrow(contexts, "bucket int, rows binary").groupBy("bucket").applyInArrow(compare, "bucket int, rows binary")
    second = second.groupBy("bucket").applyInArrow(gather_spans, "uid long, marked binary")
    return cut(first.where("settled is not null").select("uid", "settled").join(second, "uid", "full_outer"))


def sifted(rows: DataFrame, wanted: DataFrame, keep: bool = True) -> DataFrame:
    """The rows whose uid may be wanted (or, without ``keep``, certainly is not), found where they are read."""
    bits = rows.sparkSession.sparkContext.broadcast(sieve(wanted.select("uid")))
    at = rows.columns.index("uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(bits.value, batch.column(at).to_numpy()) == keep))

    return rows.mapInArrow(run, rows.schema)


def with_spans(rows: DataFrame) -> DataFrame:
    """rows with ``settled`` and ``marked``; texts that lose nothing are not shuffled."""
    found = spans(rows)
    none = F.lit(None).cast("binary")
    return sifted(rows, found).join(found, "uid", "left").unionByName(sifted(rows, found, False).withColumns({"settled": none, "marked": none}))


def removed(size: int, settled: bytes | None, marked: bytes | None) -> np.ndarray:
    """Sorted, disjoint (start, end) rows of removed bytes."""
    s = np.frombuffer(settled or b"", REPLY)
    m = np.frombuffer(marked or b"", SPAN)
    start = np.r_[s["pos"].astype(np.int64) - s["high"], m["start"]]
    end = np.r_[s["pos"].astype(np.int64) - s["low"] + LENGTH, m["end"]]
    if not len(start):
        return np.empty((0, 2), np.int64)
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, start, 1)
    np.add.at(step, end, -1)
    on = np.r_[False, np.cumsum(step[:-1]) > 0, False]
    edge = np.flatnonzero(on[1:] != on[:-1])
    return edge.reshape(-1, 2)


def kept_bytes(text: bytes, runs: np.ndarray) -> bytes:
    ends = [0, *runs[:, 1].tolist()]
    starts = [*runs[:, 0].tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes themselves."""
    rows = numbered(docs)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            out = []
            for doc_id, text, settled, marked in zip(batch.column(0).to_pylist(), filled(batch.column(1)).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                runs = removed(len(text), settled, marked)
                kept = kept_bytes(text, runs)
                out.append((doc_id, len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    marked = with_spans(rows).select("doc_id", "text", "settled", "marked")
    return marked.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def whole_characters(text: bytes, runs: np.ndarray) -> str:
    """The text without the characters all of whose bytes are removed."""
    if not len(runs):
        return text.decode()
    raw = np.frombuffer(text, np.uint8)
    gone = np.zeros(len(raw), bool)
    for a, b in runs:
        gone[a:b] = True
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    all_gone = np.logical_and.reduceat(gone, lead)
    length = np.diff(np.r_[lead, len(raw)])
    return raw[~np.repeat(all_gone, length)].tobytes().decode()


def deduplicate_texts(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut from text (whole characters only) and n_chars set anew."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    rows = numbered(docs, rest)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE):
            texts = [whole_characters(t, removed(len(t), s, m)) for t, s, m in zip(filled(batch.column(1)).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            cols, names = [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            if rest:
                cols, names = [*cols, batch.column(4)], [*names, "rest"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    marked = with_spans(rows).select("doc_id", "text", "settled", "marked", *(["rest"] if rest else []))
    schema = marked.select("doc_id", "text", *(["rest"] if rest else [])).schema
    out = marked.mapInArrow(finish, schema)
    made = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")} | {c: F.col(f"rest.`{c}`") for c in rest}
    return out.select(*[made[c].alias(c) for c in docs.columns])
