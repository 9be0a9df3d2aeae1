"""The library of training pairs, its history and the gate of a new model, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFO = "id string, name string, added_utc timestamp_ntz, damaged_file_name string, restored_file_name string, damage_share double, alignment_score double"
TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def pair_id(added: str | Column, token: str | Column) -> Column:
    """Time to the second and a token's hexadecimal digits, 27 characters in all."""
    at = F.col(added) if isinstance(added, str) else added
    return F.substring(F.concat(F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), token), 1, 27)


def file_name(path: str | Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_stem(path: str | Column) -> Column:
    """The name up to its last full stop."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def to_info(infos: DataFrame) -> DataFrame:
    """id, json: one document for each pair."""
    names = [f.split()[0] for f in INFO.split(", ")]
    return infos.select("id", F.to_json(F.struct(*names), {"timestampNTZFormat": TIME}).alias("json"))


def listed(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that have both a readable document (id, json) and a pair file (id), by the time they were added."""
    read = files.join(pairs.select("id"), "id", "left_semi").select(F.from_json("json", INFO + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "timestampNTZFormat": TIME}).alias("i"))
    return read.where("i is not null and i._bad is null").select("i.*").drop("_bad").orderBy("added_utc", "id")


def added(library: DataFrame, new: DataFrame) -> DataFrame:
    """library with new pairs; one that is there already is replaced."""
    return library.join(new.select("id"), "id", "left_anti").unionByName(new)


def removed(library: DataFrame, ids: DataFrame) -> DataFrame:
    return library.join(ids.select("id"), "id", "left_anti")


def newest(history: DataFrame, most: int | None = None) -> DataFrame:
    """History lines (seq, ...), the last one first; at most ``most`` where that is wanted for display."""
    ordered = history.orderBy(F.desc("seq"))
    return ordered if most is None else ordered.limit(most)


def gate(current: DataFrame, candidate: DataFrame, current_replay: DataFrame, candidate_replay: DataFrame) -> DataFrame:
    """One row: mean scores (image_id, iou) of both models on the same pairs, replay scores (iou), and whether to accept.

    Accepted: no worse on the pairs and at least 95 % as good on the replayed rows.
    """
    both = current.select("image_id", F.col("iou").alias("a")).join(candidate.select("image_id", F.col("iou").alias("b")), "image_id")
    replay = current_replay.select(F.col("iou").alias("c")).unionByName(candidate_replay.select(F.col("iou").alias("d")), allowMissingColumns=True)
    rows = both.select("a", "b").unionByName(replay, allowMissingColumns=True)
    means = rows.agg(F.avg("a").alias("current_iou"), F.avg("b").alias("candidate_iou"), F.count("a").alias("pairs"), F.max("c").alias("current_replay"), F.max("d").alias("candidate_replay"))
    return means.withColumn("accepted", (F.col("candidate_iou") >= F.col("current_iou") - 1e-4) & (F.col("candidate_replay") >= 0.95 * F.col("current_replay")))
