"""Operators 3 and 9: the contract by brute force, the models by held-out quality."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import plain

from emulsa.llm import op3_lm, op9_quality
from tests.llm.test_duplicates import lower


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), None]


def remainder(d, n):
    return zlib.crc32(b"" if d is None else str(d).encode()) % n


@pytest.mark.parametrize("table", ["docs", "edges", "empty"])
@pytest.mark.parametrize("frequent", [1 << 20, 50])
def test_scores(table, frequent, request, monkeypatch):
    monkeypatch.setattr(op3_lm, "FREQUENT", frequent)
    df = request.getfixturevalue(table)
    rows = plain(df)
    counts = Counter(w for d, t in rows if remainder(d, 10) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        own = tokens(t)
        want.append((str(d), remainder(d, 10) == 0, len(own), sum(counts[w] > 0 for w in own), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in op3_lm.score_documents(df).collect()]
    for g, w in zip(sorted(got), sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


def test_model_beats_base_on_held_out_rows(docs):
    held = [r for r in op3_lm.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in held)


@pytest.mark.parametrize("frequent", [1 << 23, 20])
def test_scores_hold_every_pair(docs, frequent, monkeypatch):
    """Scores from exact counts, quantised: no pair is left out, however few n-grams are broadcast."""
    monkeypatch.setattr(op3_lm, "FREQUENT", frequent)
    monkeypatch.setattr(op3_lm, "FREQUENT_PAIRS", frequent, raising=False)
    rows = plain(docs)
    train = [tokens(t) for d, t in rows if remainder(d, 10)]
    words, pairs = Counter(w for ws in train for w in ws), Counter(p for ws in train for p in zip([None, *ws], ws, strict=False))
    scale = sum(words.values()) + 0.1 * (len(words) + 1)
    value, false_mass = op3_lm.level_counts(), len(words) * filters(docs)[1]
    level = lambda c: value[op3_lm.levels(np.array([c]))[0]] if c else 0.0
    want = {}
    for d, t in rows:
        total, own = 0.0, tokens(t)
        for v, w in zip([None, *own], own, strict=False):
            c1, c2 = level(words[v]), min(level(pairs[v, w]), level(words[v]))
            k = op3_lm.STRONG * c1 / (c1 + false_mass + op3_lm.WEAK)
            total += math.log10(k * c2 / max(c1 + false_mass, 1) + (1 - k) * (level(words[w]) + 0.1) / scale)
        want[d] = total
    got = {r.doc_id: r.score for r in op3_lm.score_documents(docs).collect()}
    assert got.keys() == want.keys()
    trained = [d for d in want if remainder(d, 10)]
    assert sum(got[d] for d in trained) == pytest.approx(sum(want[d] for d in trained), rel=0.01)  # filters err by false hits alone
    assert np.mean([got[d] >= 1.02 * want[d] for d in trained]) > 0.95


def filters(docs):
    """(the filters of a model of the training rows, their mean rate of false hits)"""
    training = docs.where(op3_lm.crc_mod(docs.doc_id, 10) != 0)
    n = op3_lm.buckets_for(training)
    model = op3_lm.train(training, n).select("bucket", "filter", "false_hits").collect()
    return op3_lm.Filters(*op3_lm.side_by_side({r.bucket: bytes(r.filter) for r in model}, n)), sum(r.false_hits for r in model) / len(model)


def test_probabilities_sum_to_one(docs):
    """After frequent and rare words alike, over all known words and the unseen one, false hits included."""
    lm, rate = filters(docs)
    words = Counter(w for d, t in plain(docs) if remainder(d, 10) for w in tokens(t))
    known = [w for w in words if w is not None]
    h = np.append(op3_lm.hash_strings(op3_lm.pa.array(known)), op3_lm.END)
    c1 = lm.counts(h)
    total, false_mass = sum(words.values()), rate * len(words)
    base = np.append((c1 + 0.1) / (total + 0.1 * (len(words) + 1)), 0.1 / (total + 0.1 * (len(words) + 1)))
    by_count = sorted(range(len(known)), key=lambda i: -words[known[i]])
    for i in by_count[:20] + by_count[1000:1020] + by_count[-20:]:
        c2 = np.append(np.minimum(lm.counts(op3_lm.pair_hash(np.full(len(h), h[i]), h)), c1[i]), 0)
        trust = op3_lm.STRONG * c1[i] / (c1[i] + false_mass + op3_lm.WEAK)
        assert 0.8 < (trust * c2 / max(c1[i] + false_mass, 1) + (1 - trust) * base).sum() < 1.25, known[i]


def test_scores_do_not_depend_on_the_cluster(spark, docs):
    got = []
    for n in ("3", "16"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            got.append(sorted((r.doc_id, r.score) for r in op3_lm.score_documents(docs.repartition(int(n))).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def test_scores_without_open_or_known_ngrams(spark):
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    other = spark.createDataFrame([(2, "x y z " * 50)], "doc_id long, text string")
    for docs, training, known in ((one, one, 4), (one, other, 1), (one, one.where("false"), 0)):
        (r,) = op3_lm.score(docs, training).collect()
        assert r.n_tokens == 4 and r.n_known == known and r.score <= 0


def test_filter_holds_quantised_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    c = np.maximum(1, rng.zipf(1.5, 20_000) % 100_000).astype(np.int64)
    bits = op3_lm.build_filter(h, c)
    f = op3_lm.Filters(*op3_lm.side_by_side({0: bits}, 1))
    got = f.counts(h)
    assert (got >= c / op3_lm.BASE).all()  # never fewer than the level says
    assert np.mean(got <= c * op3_lm.BASE) > 0.9
    assert np.mean(f.counts(rng.integers(0, 1 << 63, 200_000).astype(np.uint64)) > 0) == pytest.approx(op3_lm.false_hits(bits), rel=0.5)


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(1, len(order) + 1)
    n = label.sum()
    return (rank[label].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in op9_quality.classify(docs, labels).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert sorted(got) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for d, r in got.items():
        assert r.held_out == (remainder(d, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [d for d in quality if d in got and got[d].held_out]
    score, label = np.array([got[d].score for d in held]), np.array([quality[d] == 1 for d in held])
    assert auc(score, label) > 0.9
    assert np.mean((score >= 0.3)[label]) > 0.95


def test_quality_edges(spark, edges, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    some = spark.createDataFrame([(10, 1, "x"), (12, 0, "y"), (None, 1, None), (11, None, "z"), (7, 1, "")], "doc_id long, quality int, text string")
    for labels in (none, some):
        got = op9_quality.classify(edges, labels).collect()
        assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
        kept = op9_quality.keep_good(edges, labels)
        assert kept.columns == edges.columns and kept.count() == sum(r.predicted for r in got)
        assert op9_quality.classify(empty, labels).count() == 0


def test_non_negative_risk_separates():
    rng = np.random.default_rng(0)
    width = op9_quality.WIDTH
    good, bad = rng.normal(0.5, 0.2, (400, width)), rng.normal(0.3, 0.2, (600, width))
    good[:, 2 * op9_quality.SHAPES] = bad[:, 2 * op9_quality.SHAPES] = 1
    w, scale = op9_quality.fit(good[:200].astype(np.float32), np.concatenate([good[200:], bad]).astype(np.float32), 0.25)
    assert (good / scale @ w).mean() > (bad / scale @ w).mean()


def test_prior_comes_from_positives_and_unlabelled_rows():
    """No labels of the unlabelled rows are looked at; the prior they were drawn with is found."""
    rng = np.random.default_rng(8)
    for prior in (0.2, 0.5, 0.85):
        good = lambda n: rng.normal(1.5, 1, (n, 6))
        n = 4000
        k = int(prior * n)
        unlabelled = np.concatenate([good(k), rng.normal(-1.5, 1, (n - k, 6))])[rng.permutation(n)]
        wide = lambda x: np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float32)
        assert abs(op9_quality.estimate_prior(wide(good(2000)), wide(unlabelled)) - prior) < 0.05
    assert op9_quality.estimate_prior(np.ones((1, 3), np.float32), np.ones((9, 3), np.float32)) == 0.5
