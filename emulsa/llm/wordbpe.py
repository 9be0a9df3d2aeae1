"""Token ids of whole texts by the ``tokenizers`` library, one distinct word at a time.

The tokenizer file collapses white space and then drops it, so ASCII white space is a hard boundary:
a text's ids are the ids of its words in order.  Each distinct word of a batch is encoded once.  Plain words are
lower-cased by Arrow and cut into pieces, whose distinct ones go to the library's BPE model many in a call, with white
space between them as its only boundary; every other word goes through the whole ``encode``.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from emulsa.llm.common import ranges, split_words

#: Printable ASCII and the precomposed Latin-1 letters: NFC leaves them, lower-casing is one to one.
PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Pieces in one call of the library; longer ones take more time a piece.
CALL = 256


def byte_alphabet() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return table


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes batches; made once in each Python worker."""

    _made: dict[str, "WordEncoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        table = byte_alphabet()
        table[0x20] = " "  # only between pieces
        self.letters = np.array([ord(table[b]) for b in range(256)], "<u2")

    @classmethod
    def of(cls, path: str) -> "WordEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces of plain words one after the other, how many each has)"""
        ids, length = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(pieces), CALL):
            some = pieces[k : k + CALL]
            letters = self.letters[np.frombuffer(" ".join(some).encode(), np.uint8)].tobytes().decode("utf-16-le")
            made = self.model.encode(letters, add_special_tokens=False)
            ids.append(np.array(made.ids, np.uint32))
            length.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))
        return np.concatenate(ids), np.concatenate(length)

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words one after the other, how many each has)"""
        plain = pc.and_(pc.match_substring_regex(words, PLAIN), pc.invert(pc.match_substring(words, "<|")))
        lower = pc.utf8_lower(words.filter(plain))
        single = pc.utf8_is_alpha(lower)  # letters alone are one piece
        parts = [PIECES.findall(w) for w in lower.filter(pc.invert(single)).to_pylist()]
        found = pa.concat_arrays([lower.filter(single), pa.array([p for ps in parts for p in ps], pa.string())]).dictionary_encode()
        ids, length = self.pieces(found.dictionary.to_pylist())
        plain, single = (x.to_numpy(zero_copy_only=False) for x in (plain, single))
        others = [self.whole.encode(w, add_special_tokens=False).ids for w in words.filter(pa.array(~plain)).to_pylist()]
        # words as runs of pieces, of which the others' ids are the last ones
        pieces = np.r_[found.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(length), len(length) + len(others))]
        n_pieces, first = np.ones(len(words), np.int64), np.empty(len(words), np.int64)
        ones, several = np.flatnonzero(plain)[single], np.flatnonzero(plain)[~single]
        n_pieces[several] = np.fromiter(map(len, parts), np.int64, len(parts))
        by = np.r_[ones, several, np.flatnonzero(~plain)]
        first[by] = np.r_[0, np.cumsum(n_pieces[by])][:-1]
        ids = np.concatenate([ids, *(np.array(x, np.uint32) for x in others)])
        length = np.r_[length, np.fromiter(map(len, others), np.int64, len(others))]
        start = np.r_[0, np.cumsum(length)][:-1]
        pieces = pieces[ranges(first, n_pieces)]
        per_piece = length[pieces]
        return ids[ranges(start[pieces], per_piece)], np.diff(np.r_[0, np.cumsum(per_piece)][np.r_[0, np.cumsum(n_pieces)]])

    def texts(self, col: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each closed by the id ``end`` if given."""
        codes, offsets, words = split_words(col)
        flat, length = self.words(words)
        start = np.r_[0, np.cumsum(length)][:-1]
        per_word = length[codes]
        ids = flat[ranges(start[codes], per_word)] if len(codes) else np.empty(0, np.uint32)
        at = np.r_[0, np.cumsum(per_word)][offsets]
        if end is None:
            return ids, at
        ids = np.insert(ids, at[1:], end).astype(np.uint32)
        return ids, at + np.arange(len(at))
