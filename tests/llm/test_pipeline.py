"""Stages of the pipeline on null and repeated ids and repeated rows, against plain Python."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from emulsa.llm import pipeline as corpus_pipeline


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_exact(spark, edges):
    got, groups = rows(corpus_pipeline.exact(spark, edges, "")), {}
    for r in edges.collect():
        text = r.text or ""
        order = (-len(text), r.doc_id is not None, r.doc_id or 0)
        groups.setdefault(re.sub("[\\x20\\x09-\\x0D]", "", text), []).append((order, tuple(r)))
    assert sum(got.values()) == len(groups) and set(got.values()) == {1}
    for group in groups.values():
        best = min(order for order, _ in group)
        assert sum(got[r] for r in {r for order, r in group if order == best}) == 1


def test_near(spark):
    long = [" ".join(f"{k}w{i}" for i in range(60)) for k in range(4)]
    data = [(None, long[0], "a"), (None, long[0], "b"), (5, long[1], "a"), (5, long[1], "a"), (5, long[2], "a"), (None, long[2], "a"), (7, long[3], "a"), (3, long[3] + " more", "a"), (None, None, "a"), (None, "", None), (8, "", "a")]
    got = rows(corpus_pipeline.near(spark, spark.createDataFrame(data, "doc_id long, text string, lang string"), ""))
    either = [got.pop((None, long[0], x), 0) for x in "ab"]
    assert sum(either) == 1 and got == Counter([(5, long[1], "a"), (5, long[2], "a"), (3, long[3] + " more", "a"), (None, None, "a"), (None, "", None), (8, "", "a")])


def test_passages(spark, edges):
    got = corpus_pipeline.passages(spark, edges.withColumn("n_chars", F.lit(0)), "")
    assert got.columns == [*edges.columns, "n_chars"]
    found = got.collect()
    assert Counter(r.doc_id for r in found) == Counter(r.doc_id for r in edges.collect())
    assert all(r.n_chars == len(r.text) for r in found)
    texts = {r.doc_id: r.text for r in found}
    alphabet = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 12
    assert texts[11] == "" and 0 < len(texts[10]) < len(alphabet) and texts[-1] == "negative ids come first"


def test_stages_in_a_row(spark, edges, sf):
    docs = edges.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect(), name


def test_clashing_names_and_maps(spark, sf):
    """Columns named like inner ones, and maps, come through every stage unchanged."""
    words = [" ".join(f"{k}w{i}" for i in range(40)) for k in range(3)]
    data = [(k, words[k % 3], {"a": k % 3}, "r", 1.5, "x") for k in range(6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, tags map<string,int>, __row string, __Score double, `a.b` string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        found = got.collect()
        assert all((r[3], r[4], r[5]) == ("r", 1.5, "x") and r.tags == {"a": r.doc_id % 3} for r in found), name
        if name in ("exact", "near"):
            assert sorted(r.doc_id for r in found) == [0, 1, 2]


def test_empty_table(spark, empty, sf):
    docs = empty.withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.char_length("text").cast("long")})
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.collect() == [], name


def test_run_packs_what_the_stages_keep(spark, sf):
    """The pipeline's rows are the library's ids of the texts that the first four stages leave, packed without gap or overlap."""
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
    want, total = Counter(), 0
    for r in docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= 1.05 * -(-total // 2048) + 1
