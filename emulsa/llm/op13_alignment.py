"""Alignment of two tokenizers' tokens of one text, and corpus-wide counts of linked ids.

Byte ranges of A and B tokens that overlap are the edges of a bipartite graph; union-find over it gives
its components, which are the minimal groups: runs of tokens between neighbouring offsets at which both
sides end.  Members of a component expand to links: pairs of an A and a B token whose ranges end together
(overlaps that don't are counted too).  Id pairs are counted over the corpus by an ordinary aggregate.

Work is done once for each distinct fragment of a slice of texts.  A text is cut at a blank (U+0020) that
follows a letter, digit or printable ASCII sign and doesn't end the text: A's pre-tokenizer always splits
there, and no piece of B has a blank after another character, so tokens on both sides are those of the
whole text (tests hold this against the libraries).

A slice keeps its texts' distinct pairs; the counts come back to it by a join, one row for each distinct pair of
the slice, so nothing is broadcast and no pair gathers more rows than there are slices.

Null and empty texts, and texts whose joined bytes differ from blank + text on either side, have no tokens:
zeros and an empty digest.  Repeated rows and ids are rows of their own; an empty table gives an empty
result; only id and text are read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import cut, filled, give_back, ranges, slices
from emulsa.llm.wordbpe import byte_alphabet, default_path

CUT = re.compile(r"(?<=[\w!-~]) (?!\Z)")
#: Where a text can't be split at each blank as it stands.
UNEVEN = re.compile(r"\A |[^\w!-~] | \Z")
BLANK = "▁"
#: The byte-level pre-tokenizer's pattern: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A fragment before a cut ends like this.
ENDS = re.compile(r"[\w!-~]\Z")
#: Fragments encoded in one call, and bytes of text in a slice.
TOGETHER, SLICE = 2000, 4 << 20
SHIFT = 32
ROWS = "slice string, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, at binary, times binary, a int, b int, n long"
OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, n_best long, count_sum long, groups_sha256 string"


def split(text: str) -> list[str]:
    return CUT.split(text) if UNEVEN.search(text) else text.split(" ")


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (A token, B token) whose byte ranges overlap; both sides cover the same bytes from 0 on."""
    first = np.searchsorted(b_end, np.r_[0, a_end[:-1]], "right")
    last = np.searchsorted(np.r_[0, b_end[:-1]], a_end, "left")
    count = last - first
    return np.repeat(np.arange(len(a_end)), count), ranges(first, count)


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node of each node's component: larger roots hang under smaller ones, paths are halved until flat."""
    parent = np.arange(n)
    while len(u):
        low, high = np.minimum(u, v), np.maximum(u, v)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        u, v = parent[u], parent[v]
        open_ = u != v
        u, v = u[open_], v[open_]
    return parent


@dataclass
class Tokens:
    """Both sides' ids of distinct fragments in the order in which they were encoded; fragment i is the ``place[i]``-th, and the k-th has ids at[k] .. at[k + 1]."""

    a: np.ndarray
    b: np.ndarray
    a_at: np.ndarray
    b_at: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    place: np.ndarray
    valid: np.ndarray


@dataclass
class Aligned:
    """What each distinct fragment contributes to a text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_overlaps: np.ndarray
    pairs: np.ndarray
    pairs_at: np.ndarray
    text: np.ndarray
    text_at: np.ndarray


def table(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all entries, where each begins, and its length."""
    length = np.fromiter(map(len, entries), np.int64, len(entries))
    return np.frombuffer(b"".join(entries), np.uint8), np.cumsum(length) - length, length


class Aligner:
    """Both tokenizers and their tokens' bytes; made once in each Python worker."""

    _made: dict[tuple[str, str], "Aligner"] = {}

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"{a_path}: ids don't follow the order of merges")
        # ids in the order of merges are ranks, by which this library gives the same tokens several times faster
        self.a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        names = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            names[i] = t
        self.a_bytes = table(names)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(BLANK, " ").encode()
        self.b_bytes = table([piece(i) for i in range(self.b.vocab_size())])
        self.digits = table([str(i).encode() for i in range(max(len(names), self.b.vocab_size()))])

    @classmethod
    def of(cls, a_path: str, b_path: str) -> "Aligner":
        if (a_path, b_path) not in cls._made:
            cls._made[a_path, b_path] = cls(a_path, b_path)
        return cls._made[a_path, b_path]

    def tokens(self, fragments: list[str]) -> Tokens:
        """Fragments that may stand before a cut are encoded together, ``TOGETHER`` at a time, where both sides give their bytes back; others alone."""
        order: list[int] = []
        parts: dict[str, list[np.ndarray]] = {"a": [], "b": [], "ends": []}
        valid = np.ones(len(fragments), bool)
        regular = [k for k, f in enumerate(fragments) if ENDS.search(f)]
        alone = [[k] for k, f in enumerate(fragments) if not ENDS.search(f)]
        todo = [regular[k : k + TOGETHER] for k in range(0, len(regular), TOGETHER)] + alone
        while todo:
            texts = [" ".join([fragments[k] for k in group]) for group in todo]
            a_lists = [self.a.encode_ordinary(" " + t) for t in texts]
            b_lists = self.b.encode(texts, num_threads=1)
            again = []
            for group, t, a, b in zip(todo, texts, a_lists, b_lists, strict=True):
                a, b = np.array(a, np.int64), np.array(b, np.int64)
                want = np.frombuffer((" " + t).encode(), np.uint8)
                if not (np.array_equal(joined(self.a_bytes, a), want) and np.array_equal(joined(self.b_bytes, b), want)):
                    if len(group) > 1:
                        again += [[k] for k in group]
                        continue
                    valid[group[0]] = False
                    a = b = a[:0]
                    want = want[:0]
                order += group
                parts["a"].append(a)
                parts["b"].append(b)
                size = [1 + len(fragments[k].encode()) for k in group] if len(group) > 1 else [len(want)]
                parts["ends"].append(np.array(size, np.int64))
            todo = again
        a, b, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in parts.values())
        a_end, b_end, ends = np.cumsum(self.a_bytes[2][a]), np.cumsum(self.b_bytes[2][b]), np.cumsum(size)
        place = np.empty(len(fragments), np.int64)
        place[np.array(order, np.int64)] = np.arange(len(order))
        at = lambda end: np.r_[0, np.searchsorted(end, ends, "right")]
        return Tokens(a, b, at(a_end), at(b_end), a_end, b_end, place, valid)

    def align(self, fragments: list[str]) -> tuple[Aligned, np.ndarray, np.ndarray]:
        """The fragments' contributions, each fragment's place among them, and whether its bytes come back."""
        t = self.tokens(fragments)
        n, m = len(t.a), len(t.b)
        u, v = overlaps(t.a_end, t.b_end)
        parent = union_find(n + m, u, v + n)
        # a component's least node is its first A token; roots in that order number the groups
        root = np.flatnonzero(parent[:n] == np.arange(n))
        a_of, b_of = np.searchsorted(root, parent[:n]), np.searchsorted(root, parent[n:])
        # links: members of one component that end together
        same = np.minimum(np.searchsorted(t.b_end, t.a_end), max(0, m - 1))
        linked = np.flatnonzero((t.b_end[same] == t.a_end) & (b_of[same] == a_of)) if m else np.empty(0, np.int64)
        pairs = (t.a[linked] << SHIFT) | t.b[same[linked]]
        groups_at = np.searchsorted(root, t.a_at)
        # a1,a2|b1;: tokens by group, A before B, each with its digits and a sign after it
        rank = np.concatenate([np.arange(n) + np.searchsorted(b_of, a_of), np.arange(m) + np.searchsorted(a_of, b_of, "right")])
        ids, sign = np.empty(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
        ids[rank] = np.concatenate([t.a, t.b])
        sign[rank[:n][np.r_[a_of[1:] != a_of[:-1], True][:n]]] = ord("|")
        sign[rank[n:][np.r_[b_of[1:] != b_of[:-1], True][:m]]] = ord(";")
        flat, start, length = self.digits
        ends = np.cumsum(length[ids] + 1)
        text = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        text[ends - 1] = sign
        keep = np.ones(len(text), bool)
        keep[ends - 1] = False
        text[keep] = flat[ranges(start[ids], length[ids])]
        tokens_at = t.a_at + t.b_at
        text_at = np.r_[0, ends][tokens_at]
        made = Aligned(np.diff(t.a_at), np.diff(t.b_at), np.diff(groups_at), np.diff(np.searchsorted(u, t.a_at)), pairs, np.searchsorted(linked, t.a_at), text, text_at)
        return made, t.place, t.valid


def joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], ids: np.ndarray) -> np.ndarray:
    flat, start, length = table
    return flat[ranges(start[ids], length[ids])]


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """For each slice of texts: a row for each document with its distinct pairs (their places in the slice, and how often), and one for each distinct pair with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, task = Aligner.of(a_path, b_path), TaskContext.get().partitionId()
        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (c.split(" ") for c in ROWS.split(", "))])
        for k, batch in enumerate(slices(batches, most=SLICE)):
            code: dict[str, int] = {}
            codes = [np.array([code.setdefault(p, len(code)) for p in split(t)] if t else [], np.int64) for t in filled(batch.column(1)).to_pylist()]
            got, place, valid = aligner.align(list(code))
            del code
            n_pairs = np.diff(got.pairs_at)
            keys, pair = np.unique(got.pairs, return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            rows: dict[str, list] = {n: [] for n in schema.names}
            for row, (doc, c) in enumerate(zip(batch.column(0).to_pylist(), codes, strict=True)):
                ok = len(c) > 0 and bool(valid[c].all())
                c = place[c if ok else c[:0]]
                at, times = np.unique(pair[ranges(got.pairs_at[c], n_pairs[c])], return_counts=True)
                total[at] += times
                text = got.text[ranges(got.text_at[c], got.text_at[c + 1] - got.text_at[c])]
                digest = hashlib.sha256(text[:-1]).hexdigest() if ok else ""
                line = (None, row, doc, int(got.n_a[c].sum()), int(got.n_b[c].sum()), int(got.n_groups[c].sum()), int(times.sum()), int(got.n_overlaps[c].sum()), digest, at.astype("<u4").tobytes(), times.astype("<u4").tobytes(), None, None, None)
                for n, x in zip(schema.names, line, strict=True):
                    rows[n].append(x)
            name = f"{task:07d}-{k:06d}"
            rows["slice"] = [name] * len(codes)
            yield pa.RecordBatch.from_pydict(rows, schema)
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict(
                {n: pa.nulls(len(used), schema.field(n).type) for n in schema.names}
                | {"slice": pa.array([name] * len(used), pa.string()), "row": pa.array(used, pa.int32()), "a": pa.array(keys[used] >> SHIFT, pa.int32()), "b": pa.array(keys[used] & ((1 << SHIFT) - 1), pa.int32()), "n": pa.array(total[used], pa.int64())},
                schema,
            )
            del codes, got, pair, rows
            give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in the corpus; best: no other A id has more with this B id."""
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy(F.col("b").alias("of_b")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("b") == F.col("of_b")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each document: its tokens, groups and links, and how its links stand in the corpus."""
    rows = cut(encoded(docs, a_path or default_path("byte_bpe_50k.json"), b_path or default_path("piece_bpe_32k.model")))
    pairs = rows.where("a is not null").select("slice", F.col("row").alias("place"), "a", "b", "n")
    known = cut(pair_counts(pairs)).select(F.col("a").alias("of_a"), F.col("b").alias("of_b"), "count", "best")
    # columns of their own on the second side: both come from ``rows``
    answers = pairs.join(known, (F.col("a") == F.col("of_a")) & (F.col("b") == F.col("of_b")))
    answers = answers.select(F.concat("slice", F.lit("")).alias("of_slice"), (F.col("place") + 0).alias("place"), F.col("count").alias("pair_count"), "best")
    texts = rows.where("a is null").drop("a", "b", "n")

    def total(texts: pa.Table, answers: pa.Table) -> pa.Table:
        places = answers["place"].to_numpy()
        size = int(places.max()) + 1 if len(places) else 0
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[places] = answers["pair_count"].to_numpy()
        best[places] = answers["best"].to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for at, times in zip(texts["at"].to_pylist(), texts["times"].to_pylist(), strict=True):
            at, times = np.frombuffer(at, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
            n_best.append(int((best[at] * times).sum()))
            count_sum.append(int((count[at] * times).sum()))
        texts = texts.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return texts.select([c.split(" ")[0] for c in OUT.split(", ")])

    return texts.groupBy("slice").cogroup(answers.groupBy("of_slice")).applyInArrow(total, OUT)
