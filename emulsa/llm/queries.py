"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emulsa.llm import op1_sstable, op2_spotsigs, op3_lm, op4_lines, op5_jaccard, op6_packing, op7_exact, op8_bpe, op9_quality, op10_suffix, op11_mixing, op12_clustering, op13_alignment, pipeline
from emulsa.llm.common import documents


def op1_sstable_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_sstable.read_shards(op1_sstable.write_shards(documents(spark, sf_dir), op1_sstable.shard_folder(spark)))


def op2_spotsigs_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_spotsigs.compare_edits(documents(spark, sf_dir))


def op3_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_lm.score_documents(documents(spark, sf_dir))


def op4_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_lines.deduplicate(documents(spark, sf_dir)).drop("text")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_jaccard.join_components(documents(spark, sf_dir))


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_packing.pack(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_exact.deduplicate(documents(spark, sf_dir))


def op8_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_bpe.encode_decode(documents(spark, sf_dir))


def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_suffix.deduplicate(documents(spark, sf_dir)).drop("kept")


def op11_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_mixing.mix(documents(spark, sf_dir)).drop("share")


def op12_block_norm_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("exact_distances")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op13_alignment.align(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_sstable_shards, op2_spotsigs_fingerprints, op3_bloom_lm, op4_line_chunks, op5_jaccard_join, op6_pattern_packing, op7_exact_dedup, op8_forced_boundary_bpe, op9_pu_quality, op10_suffix_dedup, op11_hash_threshold_mix, op12_block_norm_clusters, op13_token_alignment]
    return {f.__name__: f for f in own} | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": op7_exact.ORACLE, "op11_hash_threshold_mix": op11_mixing.ORACLE, "op12_block_norm_clusters": op12_clustering.oracle()}
