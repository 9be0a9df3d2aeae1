"""Operator 3: what crosses the network, and rows scored under a model of others."""

import numpy as np

from emulsa.llm import op3_lm
from emulsa.llm.common import distinct


def test_steps_between_the_pairs_of_a_bucket_are_short():
    h = distinct(np.random.default_rng(1).integers(0, 1 << 48, 800_000).astype(np.uint64))
    bucket = op3_lm.bucket_of(h, 4096)
    order, planes = op3_lm.in_steps(bucket, h)
    assert np.mean(planes["h1"] > 0) < 0.02 and np.mean(planes["h2"] > 0) < 0.02  # one first hash a bucket, and chance
    ends = np.cumsum(np.bincount(bucket, minlength=4096))
    back = [op3_lm.from_steps(*(planes[k][s:e].tobytes() for k in op3_lm.PLANES)) for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]
    assert (np.concatenate(back) == h[order]).all()


def test_ngrams_are_shuffled_to_their_buckets_once(docs):
    before = docs.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None)
    plan = op3_lm.score_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(bucket") == 1 and "Scan ExistingRDD" not in plan  # nor is a model written first
    assert len(docs.sparkSession.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(before) <= 2  # the size of the texts


def test_large_slices_are_read_twice(docs, monkeypatch):
    want = sorted((r.doc_id, r.n_known, r.score) for r in op3_lm.score_documents(docs).collect())
    monkeypatch.setattr(op3_lm, "SLICE", 1000)
    got = sorted((r.doc_id, r.n_known, r.score) for r in op3_lm.score_documents(docs).collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], rtol=1e-9)


def test_training_rows_of_another_table_are_not_scored(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    training = spark.createDataFrame([(5, "a c " * 9), (6, "")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens) for r in op3_lm.score(docs, training).collect())
    assert got == [("1", 3, 2, 20), ("None", 1, 1, 20)]
