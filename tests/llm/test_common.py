from pyspark.sql import functions as F

from emulsa.llm import common


def test_n_buckets(spark, empty, monkeypatch):
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = spark.range(100).select(F.when(F.col("id") > 0, F.repeat(F.lit("é"), 500)).alias("text"))
    assert common.n_buckets(docs) == common.n_buckets(empty) == least
    monkeypatch.setattr(common, "BUCKET_BYTES", 1000)
    assert common.n_buckets(docs) == max(least, 99)
    assert common.n_buckets(empty) == least
