"""Bigram language model in log-frequency Bloom filters, with exact unigram counts beside it.

Counting: texts are dealt into slices.  A slice sends its distinct words and word pairs, as 64-bit hashes with their counts
in training rows (0 in none), to buckets by hash, ascending; a bucket adds them up.  A bucket's filter holds for each n-gram
of training its quantised count q = 1 + floor(log_BASE c): the n-gram is inserted at levels 1 to q.  A count is read back by
probing levels 1, 2, ... until one is absent.  A filter is sized by its own n-grams, and every pair is in it.
The number of buckets follows the bytes of the training texts, so that no score depends on the cluster.

Score of a token w after v (the start of a text is a word of its own):
    P(w | v) = k(v) c(v,w) / (c(v) + F) + (1 - k(v)) (c(w) + 0.1) / (N + 0.1 (V + 1)),  k(v) = STRONG c(v) / (c(v) + F + WEAK)
with counts from the filters.  F = f V is what false hits add to the counts after v in the mean, f being the
filters' rate of false hits, measured from their fill: the first term sums to k(v) over all known words, false hits
included, and rare words, whose few true pairs false hits would outweigh, fall back on the second term.  So a sum
over w is 1 but for the quantised counts and chance; tests hold it between 0.8 and 1.25.

Filters stay in their buckets: what a slice sends to be counted is also its question.  A bucket reads the level of each
n-gram that any slice holds from its filter, once, and answers each slice in the order of its hashes, with the words' exact
counts for the base and with its totals.  Every slice writes to every bucket, so that all totals reach it.  N-grams cross the
network once, and nothing is broadcast or sent to the driver.

Words have 64-bit hashes, pairs 48-bit ones.

Null text: empty, one end token.  Repeated rows are scored each; ids may be null or repeated.  Very long texts are
read whole, one in a batch.  With no training rows N = V = 0 and every token has the base probability of an unseen
one.  An empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import crc_mod, distinct, filled, hash_strings, mix, slices, split_words, unpacked

BASE, PROBES, BITS = 1.35, 8, 12
#: A slice adds up what is frequent in it whenever more n-grams than these wait.
FREQUENT = 1 << 20
BUCKET, WIDE_BUCKET, MANY = 2 << 20, 64 << 20, 4096
STRONG, WEAK = 0.75, 4.0
END, START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
CHUNK, SLICE = 1 << 19, 8 << 20


def lower_ascii(col: pa.Array) -> pa.Array:
    return pc.ascii_lower(filled(col))


def tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes of the batch's dictionary with the end token last, codes, offsets), ends included."""
    codes, offsets, words = split_words(lower_ascii(col))
    h = np.append(hash_strings(words), END)
    codes = np.insert(codes, offsets[1:], len(h) - 1)
    return h, codes, offsets + np.arange(len(offsets))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (mix(before * np.uint64(3) + np.uint64(1)) ^ word) & np.uint64((1 << 48) - 1)


def pairs(h: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the word before each token, and of the pair."""
    before = np.empty(len(codes), np.uint64)
    if len(codes):
        before[1:] = h[codes[:-1]]
        before[offsets[:-1]] = START
    return before, pair_hash(before, h[codes])


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """By intervals of the upper 32 bits of 64, or of the 48 that pairs have: what lies in a bucket is close together, so steps are short."""
    upper = np.where(h >> np.uint64(48), h >> np.uint64(32), h >> np.uint64(16))
    return (upper * np.uint64(n) >> np.uint64(32)).astype(np.int32)


#: Planes of a packed n-gram: its lowest 32 bits, the 8 above and the rest.
PLANES = {"h0": "<u4", "h1": "u1", "h2": "<u4"}


def in_steps(bucket: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(order by bucket, planes of the steps between a bucket's ascending hashes): steps are short, so that the upper planes compress away."""
    order = np.argsort(bucket, kind="stable")
    b, step = bucket[order], h[order]
    step[1:] -= np.where(b[1:] == b[:-1], step[:-1], np.uint64(0))
    return order, dict(zip(PLANES, ((step & np.uint64(0xFFFFFFFF)).astype("<u4"), (step >> np.uint64(32) & np.uint64(0xFF)).astype("u1"), (step >> np.uint64(40)).astype("<u4")), strict=True))


def from_steps(h0: bytes, h1: bytes, h2: bytes) -> np.ndarray:
    low, mid, top = (np.frombuffer(x, t).astype(np.uint64) for x, t in zip((h0, h1, h2), PLANES.values(), strict=True))
    return np.cumsum(low | mid << np.uint64(32) | top << np.uint64(40), dtype=np.uint64)


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


#: Levels 1, 2, ... as counts: the middle, on a logarithmic scale, of the whole counts that share a level.
def level_counts(n: int = 160) -> np.ndarray:
    low = np.ceil(BASE ** np.arange(n) - 1e-9)
    high = np.maximum(np.ceil(BASE ** np.arange(1, n + 1) - 1e-9) - 1, low)
    return np.r_[0.0, np.sqrt(low * high)]


def start_and_step(h: np.ndarray, level: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """What the PROBES bit positions (start + i * step) of each (n-gram, level) follow from."""
    x = mix(h + np.asarray(level).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return x, mix(x) | np.uint64(1)


def build_filter(h: np.ndarray, counts: np.ndarray) -> bytes:
    """The filter's bits, BITS of them for each n-gram and level."""
    left = levels(counts) if len(counts) else np.zeros(0, np.int64)
    size = int(left.sum()) * BITS // 8 + 8
    bits = np.zeros(size * 8, bool)
    while len(h):
        x, step = start_and_step(h, left)
        for i in range(PROBES):
            bits[(x + np.uint64(i) * step) % np.uint64(size * 8)] = True
        left = left - 1
        h, left = h[left > 0], left[left > 0]
    return np.packbits(bits, bitorder="little").tobytes()


def false_hits(bits: bytes) -> float:
    """The rate at which the filter takes an absent n-gram for one of level 1."""
    raw = np.frombuffer(bits, np.uint8)
    return float((np.bitwise_count(raw).sum(dtype=np.int64) / (8 * len(raw))) ** PROBES)


def side_by_side(parts: dict[int, bytes], n: int) -> tuple[np.ndarray, bytes]:
    """(bytes of each bucket's filter, the filters); a bucket without one has a byte of zeros."""
    each = [parts.get(b) or b"\0" for b in range(n)]
    return np.array([len(x) for x in each], np.int64), b"".join(each)


class Filters:
    """The buckets' filters side by side, read through vectorised probes."""

    def __init__(self, sizes: np.ndarray, raw: bytes):
        self.n, self.bits = len(sizes), sizes * 8
        self.first = np.r_[0, np.cumsum(sizes)[:-1]] * 8
        self.raw = np.frombuffer(raw, np.uint8)
        self.value = level_counts()

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        """Probe by probe, each only for those that all before have hit."""
        b = bucket_of(h, self.n) if self.n > 1 else np.zeros(len(h), np.int32)
        size, first = self.bits[b].astype(np.uint64), self.first[b]
        x, step = start_and_step(h, level)
        alive = np.arange(len(h))
        for i in range(PROBES):
            at = ((x[alive] + np.uint64(i) * step[alive]) % size[alive]).astype(np.int64) + first[alive]
            alive = alive[((self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)]
        out = np.zeros(len(h), bool)
        out[alive] = True
        return out

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of n-grams, from repeated membership probes; 0 for those that are absent."""
        level = np.zeros(len(h), np.int64)
        alive = np.arange(len(h))
        for k in range(1, len(self.value)):
            alive = alive[self.has(h[alive], k)]
            if not len(alive):
                break
            level[alive] = k
        return level

    def counts(self, h: np.ndarray) -> np.ndarray:
        return self.value[self.levels(h)]


def looked_up(h: np.ndarray, table: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """(is in the ascending table, of each of values what is there or 0)"""
    if not len(table):
        return np.zeros(len(h), bool), *(np.zeros(len(h), np.int64) for _ in values)
    at = np.minimum(np.searchsorted(table, h), len(table) - 1)
    hit = table[at] == h
    return hit, *(np.where(hit, x[at], 0) for x in values)


#: Planes of a count: its lowest 8 bits and the 32 above.
COUNT_PLANES = {"c0": "u1", "c1": "<u4"}
ASKED = "bucket int, slice int, pairs boolean, h0 binary, h1 binary, h2 binary, c0 binary, c1 binary"
ANSWERED = "slice int, bucket int, pairs boolean, levels binary, counts binary, n_tokens long, n_words long, false_hits double"
COUNTED = "bucket int, hashes binary, counts binary, filter binary, n_tokens long, n_words long, false_hits double"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def n_buckets(size: int) -> int:
    """One bucket for each BUCKET bytes of text, and from MANY buckets on for each WIDE_BUCKET bytes; 16 at least."""
    return max(16, min(-(-size // BUCKET), MANY), -(-size // WIDE_BUCKET))


def buckets_for(docs: DataFrame) -> int:
    return n_buckets(docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0)


def flagged(docs: DataFrame, trains, scored: bool = True) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.select("doc_id", "text", (crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), trains.alias("trains"), F.lit(scored).alias("scored"))


def dealt(rows: DataFrame, n_slices: int) -> DataFrame:
    return rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit(""))), F.lit(n_slices)).cast("int"))


def summed(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct hashes, their summed counts, where each of h is among them)"""
    order = np.argsort(h, kind="stable")
    x = h[order]
    new = np.r_[True, x[1:] != x[:-1]][: len(x)]
    at, back = np.flatnonzero(new), np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[at], np.add.reduceat(c[order].astype(np.int64), at) if len(at) else np.empty(0, np.int64), back


def ask(rows: DataFrame, n: int) -> DataFrame:
    """The n-grams of each slice of rows (text, trains, slice) with their counts in training rows: two rows, words and pairs, for each slice and bucket."""

    def send(table: pa.Table) -> pa.Table:
        waiting: tuple[list, list] = ([], [])  # words, pairs
        for batch in slices(table.select(["text", "trains"]).to_batches(), most=SLICE):
            h, codes, offsets = tokens(batch.column(0))
            counted = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), np.diff(offsets))
            c, there = np.bincount(codes[counted], minlength=len(h)), np.bincount(codes, minlength=len(h)) > 0
            p, of_pairs, _ = summed(pairs(h, codes, offsets)[1], counted)
            for kind, x, of_x in ((0, h[there], c[there]), (1, p, of_pairs)):
                waiting[kind].append((x, of_x))
                if sum(len(y) for y, _ in waiting[kind]) > FREQUENT:
                    waiting[kind][:] = [summed(*map(np.concatenate, zip(*waiting[kind], strict=True)))[:2]]
        parts = []
        for kind in (0, 1):
            h, c, _ = summed(*map(np.concatenate, zip(*waiting[kind], strict=True)))
            bucket = bucket_of(h, n)
            order, planes = in_steps(bucket, h)
            planes |= {"c0": (c[order] & 0xFF).astype("u1"), "c1": (c[order] >> 8).astype("<u4")}
            ends = np.cumsum(np.bincount(bucket, minlength=n))
            cells = {k: pa.array([v[s:e].tobytes() for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)], pa.binary()) for k, v in planes.items()}
            parts.append(pa.table({"bucket": pa.array(np.arange(n), pa.int32()), "slice": pa.array([table["slice"][0].as_py()] * n, pa.int32()), "pairs": pa.array([kind == 1] * n)} | cells))
        return pa.concat_tables(parts)

    return rows.groupBy("slice").applyInArrow(send, ASKED)


class Bucket:
    """What slices have sent to one bucket: of words and of pairs the distinct hashes, counts and each slice's places among them; the filter of those that training has."""

    def __init__(self, table: pa.Table):
        self.kinds = []
        for kind in (False, True):
            part = table.filter(pc.equal(table["pairs"], kind))
            cells = [from_steps(*x) for x in zip(*(part[k].to_pylist() for k in PLANES), strict=True)]
            low, high = (unpacked(part[k], t).astype(np.int64) for k, t in COUNT_PLANES.items())
            h, c, back = summed(np.concatenate([np.empty(0, np.uint64), *cells]), low | high << 8)
            self.kinds.append((part["slice"].to_pylist(), [len(x) for x in cells], h, c, back))
        (*_, h, c, _), (*_, p, d, _) = self.kinds
        self.words, self.counts = h[c > 0], c[c > 0]
        self.bits = build_filter(np.r_[self.words, p[d > 0]], np.r_[self.counts, d[d > 0]])
        self.totals = {"n_tokens": int(c.sum()), "n_words": len(self.words), "false_hits": false_hits(self.bits)}


def train(docs: DataFrame, n: int) -> DataFrame:
    """The model of all rows of docs as a table: one row for each bucket, with its words, their exact counts and its filter."""

    def add(table: pa.Table) -> pa.Table:
        b = Bucket(table)
        return pa.Table.from_pylist([{"bucket": table["bucket"][0].as_py(), "hashes": b.words.tobytes(), "counts": b.counts.astype("<i8").tobytes(), "filter": b.bits} | b.totals], pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary()), ("filter", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("false_hits", pa.float64())]))

    return ask(dealt(flagged(docs, F.lit(True)), max(1, n // 4)), n).groupBy("bucket").applyInArrow(add, COUNTED)


def answer(table: pa.Table) -> pa.Table:
    """Levels, from the filter, and words' exact counts for each slice that has sent to this bucket, in the order of its hashes."""
    b, bucket, parts = Bucket(table), table["bucket"][0].as_py(), []
    lm = Filters(np.array([len(b.bits)]), b.bits)
    for are_pairs, (slice_ids, sizes, h, c, back) in zip((False, True), b.kinds, strict=True):
        level, ends = lm.levels(h).astype("u1")[back], np.cumsum(sizes)
        exact = np.empty(0, "<i8") if are_pairs else c.astype("<i8")[back]
        cut_up = lambda x: pa.array([x[e - k : e].tobytes() for k, e in zip(sizes, ends, strict=True)], pa.binary())
        same = lambda v, t: pa.array([v] * len(sizes), t)
        parts.append(pa.table({"slice": pa.array(slice_ids, pa.int32()), "bucket": same(bucket, pa.int32()), "pairs": same(are_pairs, pa.bool_()), "levels": cut_up(level), "counts": cut_up(exact)} | {k: same(v, pa.float64() if k == "false_hits" else pa.int64()) for k, v in b.totals.items()}))
    return pa.concat_tables(parts)


def _score(flags: DataFrame) -> DataFrame:
    """Scores of the rows that ``scored`` marks under a model of those that ``trains`` marks."""
    size = flags.agg(F.sum(F.octet_length("text")).alias("all"), F.sum(F.when(F.col("trains"), F.octet_length("text"))).alias("training")).first()
    n = n_buckets(size.training or 0)
    rows = dealt(flags, max(1, n_buckets(size["all"] or 0) // 4))

    def read(text: pa.Array) -> tuple:
        """offsets; code of each token and, by code, hash; the same of the pairs."""
        h, codes, offsets = tokens(text)
        pair, _, back = summed(pairs(h, codes, offsets)[1], np.zeros(len(codes), np.int64))
        return offsets, codes, h, back, pair

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        value = level_counts()
        batches = list(slices(table.select(["doc_id", "text", "held_out", "scored"]).to_batches(), most=SLICE))
        texts = [read(x.column(1)) for x in batches] if table.nbytes <= 4 * SLICE else None  # a large slice is read twice
        words, all_pairs = np.empty(0, np.uint64), np.empty(0, np.uint64)
        for _, codes, h, _, pair in texts or (read(x.column(1)) for x in batches):
            words = distinct(np.concatenate([words, h[np.bincount(codes, minlength=len(h)) > 0]]))
            all_pairs = distinct(np.concatenate([all_pairs, pair]))
        told = told.sort_by("bucket")
        of_words, of_pairs = (told.filter(pc.equal(told["pairs"], kind)) for kind in (False, True))
        n_train, n_words = (pc.sum(of_words[k]).as_py() for k in ("n_tokens", "n_words"))
        rates = [x for x in of_words["false_hits"].to_pylist() if x]
        false_mass = sum(rates) / max(1, len(rates)) * n_words
        scale = n_train + 0.1 * (n_words + 1)

        def placed(h: np.ndarray, col, dtype) -> np.ndarray:
            out = np.empty(len(h), dtype)
            out[np.argsort(bucket_of(h, n), kind="stable")] = unpacked(col, dtype)
            return out

        word_levels, exact, pair_levels = placed(words, of_words["levels"], "u1"), placed(words, of_words["counts"], "<i8"), placed(all_pairs, of_pairs["levels"], "u1")
        out = []
        for k, batch in enumerate(batches):
            offsets, codes, h, back, pair = texts[k] if texts else read(batch.column(1))
            _, level, count = looked_up(h, words, word_levels, exact)
            pair_level = looked_up(pair, all_pairs, pair_levels)[1]
            first = offsets[:-1]
            c1 = value[level]
            base = (c1 + 0.1) / scale
            of_before = np.empty(len(codes))
            of_before[1:] = c1[codes[:-1]]
            of_before[first] = c1[-1]  # as many starts as ends
            c2 = np.minimum(value[pair_level][back], of_before)
            trust = STRONG * of_before / (of_before + false_mass + WEAK)
            p = trust * c2 / np.maximum(of_before + false_mass, 1) + (1 - trust) * base[codes]
            made = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(np.add.reduceat((count > 0).astype(np.int64)[codes], first), pa.int64()), pa.array(np.full(batch.num_rows, n_train), pa.int64()),
                 pa.array(np.add.reduceat(np.log10((count + 0.1) / scale)[codes], first)), pa.array(np.add.reduceat(np.log10(p), first))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )
            out.append(made.filter(batch.column(3)))
        return pa.Table.from_batches(out)

    told = ask(rows, n).groupBy("bucket").applyInArrow(answer, ANSWERED)
    return rows.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(finish, SCORED)


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Scores of every row of docs under a model of all rows of training."""
    return _score(flagged(docs, F.lit(False)).unionByName(flagged(training, F.lit(True), False)))


def score_documents(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and scores them all."""
    return _score(flagged(docs, crc_mod(F.col("doc_id"), 10) != 0))
