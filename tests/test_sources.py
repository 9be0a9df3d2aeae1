"""Files written and read by the Python data sources."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tests.test_training import shapes, table

from emulsa.sources import file_formats as ff
from emulsa.sources import jpeg
from emulsa.sources import rasters as rt
from emulsa.sources import training_files as tf


def names(folder):
    return sorted(p.name for p in folder.iterdir() if not p.name.startswith("."))


def images(spark):
    a, b = shapes(37, 21), shapes(16, 24, fine=4)
    a[3:6, 4:9] = [1.3, -0.2, 0.5]  # beyond the range
    return table(spark, a, 7).unionByName(table(spark, b, 8)).withColumn("a", F.lit(0.5)), {7: a, 8: b}


def scanned(spark, folder):
    got = rt.image_files(spark, f"file://{folder}").withColumn("image_id", F.regexp_extract("origin", r"([0-9]+)\.[a-z]+$", 1).cast("long")).toPandas().sort_values(["y", "x"])
    return {k: d[["r", "g", "b"]].to_numpy().reshape(d.height.iloc[0], d.width.iloc[0], 3) for k, d in got.groupby("image_id")}


def test_png_files_come_back(spark, tmp_path):
    df, want = images(spark)
    rt.save_images(df, f"file://{tmp_path}/out")
    assert names(tmp_path / "out") == ["7.png", "8.png"]
    got = scanned(spark, tmp_path / "out")
    assert all(np.allclose(got[k], np.round(np.clip(v, 0, 1) * 255) / 255, atol=1e-9) for k, v in want.items())
    # once more: the same files, none besides
    rt.save_images(df.repartition(5), f"file://{tmp_path}/out")
    assert names(tmp_path / "out") == ["7.png", "8.png"]
    rt.save_images(df.where("image_id = 8"), f"file://{tmp_path}/out", mode="overwrite")
    assert names(tmp_path / "out") == ["8.png"]
    with pytest.raises(ValueError, match="unsupported"):
        rt.encode_images(df, "gif")


@pytest.mark.parametrize("quality", [-3, 1, 50, 95, 400])
def test_jpeg_files_come_back(spark, tmp_path, quality):
    df, want = images(spark)
    rt.save_images(df, f"file://{tmp_path}/out", "jpeg", quality)
    got = scanned(spark, tmp_path / "out")
    error = {k: np.abs(got[k] - np.clip(v, 0, 1)).mean() for k, v in want.items()}
    most = {-3: 0.2, 1: 0.2, 50: 0.05, 95: 0.015, 400: 0.01}[quality]
    assert all(e < most for e in error.values()), error


def test_jpeg_of_noise_and_flats():
    r = np.random.default_rng(0)
    for rgb in (r.integers(0, 256, (17, 9, 3)), np.zeros((8, 8, 3), int), np.full((1, 1, 3), 255)):
        raw = jpeg.jpeg(rgb, 90)
        assert raw[:2] == b"\xff\xd8" and raw[-2:] == b"\xff\xd9"
    assert sorted(jpeg.ZIGZAG.tolist()) == list(range(64)) and jpeg.ZIGZAG[:6].tolist() == [0, 1, 8, 16, 9, 2]
    assert len(jpeg.codes(jpeg.DC_COUNTS, jpeg.DC_VALUES)) == 12


def test_a_repeated_task_leaves_no_second_file(tmp_path, monkeypatch):
    """Two attempts of one task write; the driver commits one of them."""
    class Task:
        attempt = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Task.attempt += 1
            return Task.attempt

    monkeypatch.setattr(ff.TaskContext, "get", staticmethod(Task))
    writer = ff.NamedFilesWriter(f"file://{tmp_path}/out", False)
    rows = [{"name": "a.bin", "content": b"one"}, {"name": "b.bin", "content": None}]
    lost, kept = writer.write(iter(rows[:1])), writer.write(iter(rows))
    assert lost.folder != kept.folder and not (tmp_path / "out" / "a.bin").exists()
    other = ff.NamedFilesWriter(f"file://{tmp_path}/out", False)  # another job at the same time
    more = other.write(iter([{"name": "c.bin", "content": b"three"}]))
    writer.commit([kept, None])
    assert names(tmp_path / "out") == ["_temporary", "a.bin", "b.bin"] and (tmp_path / "out" / "b.bin").read_bytes() == b""
    other.commit([more])
    assert names(tmp_path / "out") == ["a.bin", "b.bin", "c.bin"]
    failed = ff.NamedFilesWriter(f"file://{tmp_path}/out", True)
    failed.abort([failed.write(iter(rows))])
    assert names(tmp_path / "out") == ["a.bin", "b.bin", "c.bin"]


def test_bad_rows_leave_nothing(spark, tmp_path):
    for bad in ([("a.bin", b"1"), ("a.bin", b"2")], [("../up.bin", b"1")], [("", b"1")], [(None, b"1")]):
        with pytest.raises(PySparkException):
            ff.save_files(spark.createDataFrame([("ok.bin", b"0"), *bad], "name string, content binary").repartition(2), f"file://{tmp_path}/out")
        assert not (tmp_path / "out").exists() or not [n for n in names(tmp_path / "out") if n.endswith(".bin")]
    ff.save_files(spark.createDataFrame([], "name string, content binary"), f"file://{tmp_path}/none")


def test_training_files_come_back(spark, tmp_path):
    p = table(spark, shapes(9, 7), 1).unionByName(table(spark, shapes(12, 5, fine=2), 2))
    p = p.withColumns({"path": F.concat(F.lit("p"), "image_id"), "name": F.lit("scan"), "damage": F.col("x") % 3 == 0, "known": F.col("y") % 2 == 0})
    content = tf.encode_pairs(p)
    folder = f"file://{tmp_path}/pairs"
    ff.save_files(content.select(F.concat("path", F.lit(".bin")).alias("name"), "content"), folder)
    read = lambda **o: spark.read.format("pair_files").options(**o).load(folder)
    columns = ["y", "x", "width", "height", "r", "g", "b", "damage", "known"]
    want = sorted(map(tuple, tf.decode_pairs(content).select(*columns).collect()))
    assert sorted(map(tuple, read().select(*columns).collect())) == want and len(want) == 123
    assert read(partition_mb="0").rdd.getNumPartitions() == 2 and read().rdd.getNumPartitions() == 1
    assert read(partition_mb="0").select(F.countDistinct("path")).first()[0] == 2
    # a broken file raises, or is left out
    (tmp_path / "pairs" / "broken.bin").write_bytes(b"no pair")
    (tmp_path / "pairs" / "other.txt").write_bytes(b"no pair")
    with pytest.raises(PySparkException, match="no training pair"):
        read().count()
    assert sorted(map(tuple, read(skip="true").select(*columns).collect())) == want
    with pytest.raises(PySparkException):
        spark.read.format("replay_files").option("path", f"file://{tmp_path}/missing").load().count()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("replay_files").option("path", str(tmp_path / "empty")).load().count() == 0


def test_partitions_are_small_by_default_but_not_many(tmp_path):
    def planned(sizes, **options):
        for old in tmp_path.iterdir():
            old.unlink()
        for k, size in enumerate(sizes):
            with open(tmp_path / f"{k:04d}.bin", "wb") as f:
                f.truncate(size)
        parts = ff.TrainingReader({"path": str(tmp_path)} | options, tf.pair_rows, tf.PAIR_ROWS).partitions()
        assert [p for part in parts for p in part.paths] == [str(tmp_path / f"{k:04d}.bin") for k in range(len(sizes))]
        return [len(p.paths) for p in parts]

    assert planned([16_400] * 600) == [60] * 10  # 64 x 64 pixels each: one task for all of them before
    assert planned([400_000_000, 1000, 1000]) == [1, 2]
    assert max(planned([2_000_000] * 512)) == 2 and max(planned([8_000_000] * 1024)) == 2  # 4 MB, and never more than 16
    assert planned([16_400] * 600, partition_mb="64") == [600]
