"""Operators 1, 6 and 8 against the tokenizers library."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tests.llm.conftest import plain
from tokenizers import Tokenizer

from emulsa.llm import op1_sstable, op6_packing, op8_bpe


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
def test_shards(table, request, library):
    df = request.getfixturevalue(table)
    manifest = op1_sstable.write_shards(df, op1_sstable.shard_folder(df.sparkSession))
    got = op1_sstable.read_shards(manifest).collect()
    rows = plain(df)
    ids = [library.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(i), crc(i)) for (d, _), i in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [d for d, _ in rows]


@pytest.mark.parametrize("fences", [0, 3, 4096])
def test_lookup(spark, docs, library, fences, monkeypatch):
    monkeypatch.setattr(op1_sstable, "FENCES", fences)
    manifest = op1_sstable.write_shards(docs, op1_sstable.shard_folder(spark))
    some = [d for d, _ in plain(docs)][::17]
    got = {r.doc_id: r.tokens for r in op1_sstable.lookup(manifest, spark.createDataFrame([(d,) for d in [*some, 10**12]], "doc_id long")).collect()}
    texts = dict(plain(docs))
    assert got == {d: library.encode(texts[d], add_special_tokens=False).ids + [1] for d in some}


def test_shard_blocks_and_misses():
    w = op1_sstable.ShardWriter(False)
    ids = [None, *sorted(random.Random(1).sample(range(-(10**9), 10**9), 5000))]
    for k, d in enumerate(ids):
        w.add(op1_sstable.key_of(d), np.arange(k % 50))
    raw = w.finish()

    class File:
        at = 0
        size = lambda self: len(raw)
        seek = lambda self, p: setattr(self, "at", p)

        def read(self, n):
            self.at += n
            return raw[self.at - n : self.at]

    r = op1_sstable.ShardReader(File())
    assert len(r.index) > 1 and r.n_docs == len(ids)
    assert [op1_sstable.id_of(k) for k, _, _ in r.scan()] == ids
    for k in (0, 1, 700, 5000):
        assert [x.tolist() for x in r.get(ids[k])] == [list(range(k % 50))]
    assert r.get(10**9 + 5) == []


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
def test_encode_decode(table, request, library):
    df = request.getfixturevalue(table)
    got = op8_bpe.encode_decode(df, with_values=True).collect()
    want = []
    for d, t in plain(df):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((str(d), ids, library.decode(ids, skip_special_tokens=False)))
    assert sorted((str(r.doc_id), r.ids, r.decoded) for r in got) == sorted(want)
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_encode_odd_strings(spark, library):
    rnd = random.Random(5)
    letters = "abAB'’sStT09 \t\n\x1c\x85\xa0​　éÉßñİıſKﬁ日本語🙂<|>endoftext!?-_\x00\x7fΣς"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b", "<|endoftext|><|endoftext|>", "é É", "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.ids, r.decoded) for r in op8_bpe.encode_decode(df, with_values=True).collect()}
    shards = {r.doc_id: r.ids_crc32 for r in op1_sstable.read_shards(op1_sstable.write_shards(df, op1_sstable.shard_folder(spark))).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[k] == (ids, library.decode(ids, skip_special_tokens=False)), repr(t)
        assert shards[k] == crc([*ids, 1]), repr(t)


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
def test_packing(table, request, library):
    df = request.getfixturevalue(table)
    got = op6_packing.pack(df).collect()
    want = []
    for d, t in plain(df):
        ids = [*library.encode(t, add_special_tokens=False).ids, 0]
        want += [(str(d), k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    least = math.ceil(sum(w[3] for w in want) / 2048)
    assert least <= len(held) <= least + max(2, 0.03 * least)


def test_patterns_fit_large_histograms():
    hist = np.random.default_rng(3).poisson(40, 2049)
    hist[0] = 0
    plan, n = op6_packing.make_plan(hist, 2048)
    least = -(-int((hist * np.arange(2049)).sum()) // 2048)
    assert least <= n <= 1.01 * least
    placed = defaultdict(list)
    for length, rows in plan.items():
        ends = [*rows[1:, 0], hist[length]]
        for (first, sequence, offset), end in zip(rows, ends, strict=True):
            for k in range(end - first):
                placed[sequence + k].append((offset, length))
    assert len(placed) == n and sum(len(p) for p in placed.values()) == hist.sum()
    for p in placed.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
