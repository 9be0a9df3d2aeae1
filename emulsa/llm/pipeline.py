"""Corpus pipeline: quality classifier, exact dedup, near dedup, passage dedup, packing.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
Ids may be null or repeated: decisions come back by a hash of all columns, and of rows that agree in
everything ``exact`` and ``near`` keep one.  Further columns of any name and type pass through every stage but the last.
An empty table passes through all stages as such; very long texts are read whole, one in a slice.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.llm import op5_jaccard, op6_packing, op7_exact, op9_quality, op10_suffix
from emulsa.llm.common import cut, free_name, shared_dir, with_row


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return op9_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rows_of(docs: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """One row of docs for each value of ``row`` in kept."""
    return with_row(docs, row).join(kept.select(row), row, "left_semi").dropDuplicates([row]).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, one stays."""
    row = free_name(docs, "__row")
    return rows_of(docs, op7_exact.deduplicate(with_row(docs, row), row=row).where("kept"), row)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates, its least id stays (null last); a text without shingles stays."""
    row = free_name(docs, "__row")
    found = cut(op5_jaccard.join_components(with_row(docs, row), row=row))
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row]
    winners = found.where("label is not null").groupBy("label").agg(least.alias(row))
    return rows_of(docs, winners.select(row).union(found.where("label is null").select(row)), row)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out of the text."""
    return op10_suffix.deduplicate_texts(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, packed into sequences."""
    return op6_packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("passages", passages), ("packing", packing)]

#: A learned model and similarity components are beyond SQL; small tests hold ``exact`` and ``near`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
