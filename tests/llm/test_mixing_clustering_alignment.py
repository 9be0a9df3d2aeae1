"""Operators 11 to 13 against plain Python."""

import hashlib
import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tests.llm.conftest import plain
from tokenizers import Tokenizer

from emulsa.llm import op11_mixing, op12_clustering, op13_alignment
from emulsa.llm.wordbpe import byte_alphabet

# --- op11 ---


def plain_targets(sizes):
    """By sharing the excess again and again; keys: source or None."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), set(order), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3 * sizes[s]
                free.discard(s)
    return target


def check_mix(df):
    rows = df.select("doc_id", "text", "source").collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r.source] += words(r.text)
    want = plain_targets(sizes)
    got = op11_mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, words(r.text)) for r in rows)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op11_mixing.mix(df.repartition(3)).collect()), key=str)
    known = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        known[r.source_size, round(r.target, 4)].append(r)
    for s, target in want.items():
        mine = known[sizes[s], round(target, 4)]
        alike = [t for t in want if (sizes[t], round(want[t], 4)) == (sizes[s], round(target, 4))]
        assert len(mine) == sum(r.source in alike for r in rows)
        # what a hash doesn't tell apart is shared to the nearest word
        assert abs(sum(r.taken for r in mine) - target * len(alike)) <= max(1, len(mine) / 2)
    return got


def test_mix(docs, edges, spark):
    check_mix(docs)
    check_mix(edges.withColumn("source", F.when(F.col("doc_id") < 9, "a").when(F.col("doc_id") > 11, "é").when(F.col("doc_id") == 10, "")))
    check_mix(edges.withColumn("source", F.lit(None).cast("string")))
    assert check_mix(edges.where("false").withColumn("source", F.lit("a"))) == []
    assert [tuple(r)[2:] for r in check_mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string"))] == [(0, 0, 0.0, 0)] * 2


def test_mix_of_equal_rows(spark):
    """One group of rows that agree in everything holds a third of the table."""
    data = [(None, "one two three", "a")] * 300 + [(k, f"w{k} x y", "ab"[k % 2]) for k in range(600)]
    check_mix(spark.createDataFrame(data, "doc_id long, text string, source string"))


def test_mixes_are_nested(docs):
    got = op11_mixing.mix(docs, shares=(0.3, 0.6, 1.0)).collect()
    by = defaultdict(dict)
    for r in got:
        by[r.doc_id][r.share] = r.taken
    assert all(t[0.3] <= t[0.6] <= t[1.0] for t in by.values())
    for share in (0.3, 0.6, 1.0):
        assert abs(sum(t[share] for t in by.values()) / sum({(r.source_size, r.target): r.target for r in got if r.share == share}.values()) - 1) < 0.01


def test_whole_documents(docs):
    got = op11_mixing.mix(docs, whole=True).collect()
    assert all(r.taken % max(1, r.size) == 0 for r in got)
    largest, taken = defaultdict(int), defaultdict(int)
    for r in got:
        key = (r.source_size, r.target)
        largest[key], taken[key] = max(largest[key], r.size), taken[key] + r.taken
    assert all(abs(taken[k] - k[1]) <= largest[k] / 2 for k in taken)


def test_salted_join(docs, monkeypatch):
    want = sorted(map(tuple, op11_mixing.mix(docs).collect()))
    monkeypatch.setattr(op11_mixing, "BROADCAST", 0)
    assert sorted(map(tuple, op11_mixing.mix(docs).collect())) == want


# --- op12 ---


def plain_clusters(rows, k=16, rounds=3):
    rows = [(i, [math.floor(64 * x) if abs(x) < 2**53 else int(x) * 64 for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(rows, key=lambda r: digest(r[0]))[:k]]
    distance = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))

    def assign():
        return [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(rows, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    inertia = Counter()
    for d, j in found:
        inertia[j] += d
    whole = sum(inertia.values())
    long = lambda x: x if x < 1 << 63 else None
    return Counter((i, j, long(d), long(inertia[j]), long(whole), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(rows, found, strict=True))


def clustered(df, **more):
    return Counter(tuple(r)[:6] for r in op12_clustering.cluster(df, **more).collect())


SCHEMA = "vec_id long, embedding array<double>, label int, cluster int, x string, norms int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, "", 0) for i, v in rows], SCHEMA)


def vectors(seed, n, scale=1.0):
    r = np.random.default_rng(seed)
    return [(i, (r.normal(size=64) * scale).tolist()) for i in range(n)]


def test_clusters(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert clustered(df) == plain_clusters([(r.vec_id, r.embedding) for r in df.collect()])


def test_screening(spark):
    """Vectors that differ in where their weight lies need few exact distances."""
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=64) * 0.1 + np.repeat(np.eye(8)[i % 8] * (1 + i % 2), 8)).tolist()) for i in range(400)]
    assert clustered(table(spark, rows)) == plain_clusters(rows)
    assert 1 <= op12_clustering.cluster(table(spark, rows)).agg(F.avg("exact_distances")).first()[0] < 8


@pytest.mark.parametrize("case", ["bad", "few", "ties", "wide", "empty"])
def test_clusters_of_odd_tables(case, spark):
    rows = vectors(1, 60)
    if case == "bad":
        rows += [(100, None), (101, [0.5] * 63), (102, [0.5] * 65), (103, [None] + [0.5] * 63), (104, [math.nan] + [0.5] * 63), (105, [-math.inf] + [0.5] * 63), (106, []), (None, [0.25] * 64)]
    elif case == "few":
        rows = rows[:5]
    elif case == "ties":
        rows = [(i % 50, [float(i % 2)] * 64) for i in range(300)] + [(i, [0.5] * 64) for i in range(50, 80)]
        rows = [(i, v if i > 49 else [float(i % 2)] * 64) for i, v in rows]
    elif case == "wide":
        rows += [(200, [1e30] + [0.0] * 63), (201, [-1e300] * 64), (202, [3e6] * 64), (203, [2.0**40 + 0.25] * 64)]
    elif case == "empty":
        rows = []
    got = clustered(table(spark, rows))
    assert got == plain_clusters(rows)


def test_screening_keeps_the_nearest():
    r = np.random.default_rng(4)
    for scale in (1, 30, 1 << 20):
        x = r.integers(-scale, scale + 1, (400, 64))
        x[:50] = x[50:100]
        centroids = [*x[::25].tolist(), *x[:3].tolist()]
        cluster, best, tried = op12_clustering.nearest(x, op12_clustering.segment_norms(x), centroids)
        d = ((x[:, None, :] - np.array(centroids)[None]) ** 2).sum(2)
        assert (cluster == d.argmin(1)).all() and (best == d.min(1)).all() and (tried <= len(centroids)).all()


# --- op13 ---

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  x  ", "a  b", "▁x y", "tail ", "\n word\n  two \t three ", "<|endoftext|> <s> </s> <unk> <0x0A>", "日本 の 😀 é é \x85 \xa0 y", "\x00 a", "don't we'll I'm", "x" * 3000, "1 2 3 44 555 6666", "ﬁ İ　x ᠎ z"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A_PATH)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    letters = {c: x for x, c in byte_alphabet().items()}
    names = {i: t for t, i in json.load(open(A_PATH))["model"]["vocab"].items()}

    def encode(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(letters[c] for c in names[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        want = b" " + text.encode()
        return ([], []) if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want else (list(zip(ids_a, bytes_a, strict=True)), list(zip(ids_b, bytes_b, strict=True)))

    return encode


def ranges(tokens):
    at, out = 0, []
    for i, x in tokens:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain_alignment(rows, encode):
    counts, made = Counter(), []
    for doc, text in rows:
        a, b = map(ranges, encode(text))
        ends = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = []
        sides = [iter(a), iter(b)]
        for e in ends:
            group = ([], [])
            for side, ids in zip(sides, group, strict=True):
                while True:
                    i, _, q = next(side)
                    ids.append(i)
                    if q == e:
                        break
            groups.append(group)
        by_end = {f: j for j, _, f in b}  # no two tokens of a side end together
        links = [(i, by_end[e]) for i, _, e in a if e in by_end]
        counts.update(links)
        made.append((doc, a, b, groups, links))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    digest = lambda g: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest() if g else ""
    return Counter((doc, len(a), len(b), len(g), len(ln), sum(counts[x] == best[x[1]] for x in ln), sum(counts[x] for x in ln), digest(g)) for doc, a, b, g, ln in made)


def aligned(df):
    return Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in op13_alignment.align(df).collect())


@pytest.mark.parametrize("name", ["docs", "edges", "empty", "odd"])
def test_alignment(name, spark, request, both):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string") if name == "odd" else request.getfixturevalue(name)
    assert aligned(df.repartition(3)) == plain_alignment(plain(df), both)


def test_fragments_are_the_whole_text(both):
    """Cut at blanks, both tokenizers give the tokens of the whole text."""
    rnd = random.Random(5)
    alphabet = [*"ab c  \n\t'sé.1,▁\x1c\x85　\xa0-x<|>0A", "<s>", " the", "'ll", "日本", "😀", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choices(alphabet, k=rnd.randint(1, 40)))
        a, b = both(text)
        assert op13_alignment.split(text) == op13_alignment.CUT.split(text)
        if a:
            parts = [both(p) for p in op13_alignment.CUT.split(text)]
            assert [x for p, _ in parts for x in p] == a and [x for _, p in parts for x in p] == b


def test_components_are_the_minimal_groups():
    rnd = random.Random(6)
    for _ in range(200):
        n = rnd.randint(1, 60)
        ends = [np.array(sorted({*rnd.sample(range(1, n + 1), rnd.randint(1, n)), n})) for _ in "ab"]
        u, v = op13_alignment.overlaps(*ends)
        starts = [np.r_[0, e[:-1]] for e in ends]
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        parent = op13_alignment.union_find(len(ends[0]) + len(ends[1]), u, v + len(ends[0]))
        both_end = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        group = [np.searchsorted(both_end, e) for e in ends]
        assert len(np.unique(parent)) == len(both_end)
        assert len({*zip(parent.tolist(), np.concatenate(group).tolist(), strict=True)}) == len(both_end)
