"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that occur side by side in no vocabulary token can never end up in one token, so
between them a cut is certain.  Words are cut there, the fragments are encoded independently (and kept,
as they recur far more often than words), and their ids are concatenated.  Decoding joins the token
strings with one blank, as the library does for a file without a decoder.

Null text: empty, so no ids and an empty decoded text.  Rows are independent: repeated rows give equal
results, an empty table none, and only id and text are read.  Very long words are encoded with a heap of
merges, in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import slices, split_words
from emulsa.llm.wordbpe import byte_alphabet, default_path

CACHE = 500_000


class ForcedBoundaryBpe:
    """Encoder and decoder read from a tokenizer file; made once in each Python worker."""

    _made: dict[str, "ForcedBoundaryBpe"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {v: k for k, v in (self.vocab | self.special).items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.bytes = byte_alphabet()
        self.seen: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.plain = regex.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    @classmethod
    def of(cls, path: str) -> "ForcedBoundaryBpe":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @cached_property
    def joined(self) -> frozenset[str]:
        """Pairs of byte letters that stand side by side in some token."""
        pairs = set()
        for token in self.vocab:
            body = token.removesuffix(self.suffix) if self.suffix else token
            pairs.update(map("".join, zip(body, body[1:], strict=False)))
        return frozenset(pairs)

    def fragments(self, letters: str) -> list[str]:
        """The pieces between forced boundaries."""
        out, start, joined = [], 0, self.joined
        for i in range(1, len(letters)):
            if letters[i - 1 : i + 1] not in joined:
                out.append(letters[start:i])
                start = i
        out.append(letters[start:])
        return out

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Merges of lowest rank first, leftmost first among equals, with a heap over a linked list."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += self.suffix
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = self.merges
        heap = [(rank[p], i, *p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (parts[k], parts[after[k]])) in rank:
                    heapq.heappush(heap, (rank[p], k, *p))
        return tuple(self.vocab[p] for p in parts if p is not None)

    def letters(self, letters: str) -> tuple[int, ...]:
        ids, parts, seen = (), self.fragments(letters), self.seen
        for k, part in enumerate(parts):
            key = (part, k == len(parts) - 1)
            got = seen.get(key)
            if got is None:
                if len(seen) >= CACHE:
                    seen.clear()
                got = seen[key] = self.merge(*key)
            ids += got
        return ids

    def ordinary(self, text: str) -> tuple[int, ...]:
        """Normalise (NFC, one blank for white space, lower case letter by letter), split and encode."""
        if not self.plain.fullmatch(text):
            text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
            text = "".join(c.lower() for c in text)
        else:
            text = text.lower()
        table, ids = self.bytes, ()
        for piece in self.pieces.findall(text):
            ids += self.letters(piece if piece.isascii() and piece.isprintable() else "".join(table[b] for b in piece.encode()))
        return ids

    def encode(self, text: str) -> tuple[int, ...]:
        ids, at = (), 0
        for m in self.specials.finditer(text) if self.specials else ():
            ids += self.ordinary(text[at : m.start()]) + (self.special[m[0]],)
            at = m.end()
        return ids + self.ordinary(text[at:])

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids)


def encode_decode(docs: DataFrame, path: str | None = None, with_values: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with_values: also ids and decoded themselves."""
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ForcedBoundaryBpe.of(path)
        for batch in slices(batches):
            codes, offsets, words = split_words(batch.column(1))
            each = [bpe.encode(w) for w in words.to_pylist()]
            counts = np.fromiter(map(len, each), np.int64, len(each))
            said = [" ".join(map(str, ids)) for ids in each]
            shown = [bpe.decode(ids) for ids in each]
            # words of nothing but removed characters have no ids and leave no blank
            keep = counts[codes] > 0
            offsets = np.r_[0, np.cumsum(keep)][offsets]
            codes = codes[keep].tolist()
            total = np.r_[0, np.cumsum(counts[codes])][offsets] if codes else np.zeros(len(offsets), np.int64)
            ids_sha, text_sha, ids, text = [], [], [], []
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                own = codes[s:e]
                ids_sha.append(hashlib.sha256(" ".join([said[c] for c in own]).encode()).hexdigest())
                decoded = " ".join([shown[c] for c in own])
                text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_values:
                    ids.append([i for c in own for i in each[c]])
                    text.append(decoded)
            cols = [batch.column(0), pa.array(np.diff(total), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_values:
                cols += [pa.array(ids, pa.list_(pa.int32())), pa.array(text, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
