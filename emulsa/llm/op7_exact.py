"""Exact dedup with a heavy-hitter split; DataFrame functions only.

Texts are compared after deleting ASCII white space, by SHA-256.  A Misra-Gries summary (Spark's
``approx_top_k`` keeps one of ``TRACKED`` counters) names candidates for frequent digests: any digest
with more than rows / TRACKED copies is among them.  Exact aggregation over the candidates' rows, combined
map-side, verifies their winners; at most ``HEAVY`` winners (2 MB or so) are broadcast, so copies of frequent texts are
settled where they are read.  All other digests have at most rows / TRACKED copies each; they are combined map-side
into one row a digest, which an ordinary join brings back to its copies.

Of equal texts the row with the most code points stays, then the smallest id (null before all others).
Null text: empty.  Rows that agree in everything: each is reported, and all of the winner's id count as
kept.  An empty table gives an empty result.  Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.llm.common import cut

HEAVY, TRACKED = 16384, 16384
SPACE = " \t\n\x0b\x0c\r"


def digests(docs: DataFrame, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.char_length(text).cast("long").alias("chars"),
        F.sha2(F.translate(text, SPACE, ""), 256).alias("text_sha256"),
        *more,
    )


def deduplicate(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED, row: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    With ``row``, a column that tells rows apart, it decides between rows of one id, and is returned too.
    """
    more = [row] if row else []
    rows = cut(digests(docs, *more))  # texts are read once; from here on rows are digests
    found = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    candidates = found.select(F.explode("top").alias("t")).select(F.col("t.item").alias("text_sha256")).where(F.col("t.count") > 1)
    least = F.min(F.struct((-F.col("chars")).alias("less"), F.col("doc_id").alias("keep_id"), *more))
    best = least.alias("best")
    winners = rows.join(F.broadcast(candidates), "text_sha256", "left_semi").groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))
    winners = cut(winners.where("group_size > 1"))  # at most ``heavy`` rows
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    settled = marked.where("best is not null")
    others = marked.where("best is null").drop("best", "group_size")
    rest = others.groupBy("text_sha256").agg(best, F.count("*").alias("group_size"))  # combined map-side
    others = others.join(rest, "text_sha256")
    return settled.unionByName(others).select(
        "doc_id",
        F.col("best.keep_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col(row or "doc_id").eqNullSafe(F.col(f"best.{row or 'keep_id'}")).alias("kept"),
        "text_sha256",
        *more,
    )


ORACLE = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
r as (
  select *, first_value(doc_id) over (partition by text_sha256 order by chars desc, doc_id nulls first) as keep_id,
         count(*) over (partition by text_sha256) as group_size from n)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from r
"""
