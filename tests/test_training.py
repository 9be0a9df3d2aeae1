"""Training operators that SQL can't express, against plain NumPy and round trips."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from tests.test_kernels import gaussian_plane

from emulsa.operators import alignment as al
from emulsa.operators import library as lb
from emulsa.plans import training
from emulsa.sources import rasters as rt
from emulsa.sources import training_files as tf


def shapes(width, height, x0=0.0, y0=0.0, sx=1.0, sy=1.0, fine=1):
    """Smooth shapes in closed form over the part of the unit square that (x0, y0, sx, sy) says."""
    v, u = np.meshgrid(y0 + sy * (np.arange(height) + 0.5) / height, x0 + sx * (np.arange(width) + 0.5) / width, indexing="ij")
    lum = 0.5 + 0.2 * np.sin(fine * (9 * u + 4 * v + u * v)) * np.cos(fine * (7 * v - 2 * u)) + 0.2 * np.exp(-40 * ((u - 0.4) ** 2 + (v - 0.6) ** 2))
    return np.stack([lum, 0.9 * lum, 0.8 * lum + 0.05 * u], -1)


def table(spark, planes, image=1, **more):
    h, w = planes.shape[:2]
    y, x = (a.ravel() for a in np.indices((h, w)))
    pdf = pd.DataFrame({"image_id": image, "y": y, "x": x, "width": w, "height": h} | {c: planes[..., k].ravel() for k, c in enumerate("rgb")} | {k: v.ravel() for k, v in more.items()})
    return spark.createDataFrame(pdf).withColumns({c: F.col(c).cast("int") for c in ("y", "x", "width", "height")})


def test_alignment_finds_the_cut_out_part(spark):
    scan, part = shapes(200, 150, fine=3), shapes(150, 100, 0.05, 0.1, 0.9, 0.8, fine=3)
    got = al.align(table(spark, scan), table(spark, part)).first()
    assert got.score > 0.95
    assert np.allclose([got.scale_x, got.scale_y, got.offset_x, got.offset_y], [0.9, 0.8, 0.05, 0.1], atol=0.012)
    assert (got.width, got.height, got.restored_width, got.restored_height) == (200, 150, 150, 100)
    assert al.accepted(spark.createDataFrame([(1, 0.3), (2, 0.29)], "image_id int, score double")).count() == 1


def label_by_hand(scan, target, drawn):
    """Damage of a scan and its aligned target of the same size, with colours fitted on the drawn places."""
    h, w = scan.shape[:2]

    def terms(p):
        r, g, b = p[..., 0], p[..., 1], p[..., 2]
        return np.stack([np.ones_like(r), r, g, b, r * r, g * g, b * b, r * g, r * b, g * b], -1)

    x, t = terms(scan).reshape(-1, 10)[drawn], target.reshape(-1, 3)[drawn]
    use = np.ones(len(x), bool)
    for _ in range(3):
        fit = np.linalg.solve(x[use].T @ x[use] + 1e-6 * np.eye(10), x[use].T @ t[use])
        error = np.abs(x @ fit - t).mean(1)
        use = error < np.sort(error)[int(0.6 * (len(x) - 1))]
    mapped = np.clip(terms(scan) @ fit, 0, 1)
    residual = np.abs(gaussian_plane(mapped, 1.5) - gaussian_plane(target, 1.5)).mean(-1)
    lum = np.pad(target @ np.array([0.2126, 0.7152, 0.0722]), 3, mode="edge")
    box = lambda p: np.lib.stride_tricks.sliding_window_view(p, (7, 7)).mean((2, 3))
    texture = np.sqrt(np.maximum(box(lum * lum) - box(lum) ** 2, 0))

    def cross(on, grow):
        p = np.pad(on, 1)
        near = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
        return np.logical_or.reduce(near) if grow else np.logical_and.reduce(near)

    on = residual > np.maximum(0.10, 1.5 * texture)
    for grow in (False, True, True, True, False, False):
        on = cross(on, grow)
    return on


def test_ground_truth_by_hand(spark):
    target = shapes(48, 40)
    scan = 0.1 + 0.75 * target
    scan[10:17, 20:27] = 0.97
    at = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 0.0, 48, 40, 48, 40)], "image_id long, scale_x double, scale_y double, offset_x double, offset_y double, width int, height int, restored_width int, restored_height int")
    got = al.ground_truth(table(spark, scan), table(spark, target), at).toPandas().sort_values(["y", "x"])
    known = got.known.to_numpy().reshape(40, 48)
    assert known[2:-2, 2:-2].all() and not known[:2].any() and not known[:, -2:].any()
    places = table(spark, scan).where("y between 2 and 37 and x between 2 and 45")
    drawn = al.with_replacement(places).toPandas()
    drawn = np.repeat((drawn.y * 48 + drawn.x).to_numpy(), drawn.times)
    want = label_by_hand(scan, target, drawn)
    assert np.array_equal(got.damage.to_numpy().reshape(40, 48), want)
    assert want[12:15, 22:25].all() and want.sum() < 150
    # too small an overlap gives no row
    assert al.ground_truth(table(spark, scan[:20, :30]), table(spark, target[:20, :30]), at.withColumns({"width": F.lit(30), "height": F.lit(20), "restored_width": F.lit(30), "restored_height": F.lit(20)})).count() == 0


def test_replay_comes_back_in_half_precision(spark, sf):
    rows = training.replay_rows(spark, sf).withColumn("path", F.lit("replay"))
    got = tf.decode_replay(tf.encode_replay(rows, 5)).toPandas()
    v = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = sorted((tuple(np.array(e[:34], np.float16).astype(np.float32).tolist()), bool(n % 2), float(1 + i % 4)) for e, n, i in zip(v.embedding, v.label, v.vec_id, strict=True))
    assert sorted(zip((tuple(f) for f in got.features), got.label, got.weight, strict=True)) == want
    assert set(got.pairs) == {5} and sorted(got.row_id) == list(range(len(v)))
    parts = tf.decode_replay(tf.encode_replay(rows, 5, 4)).toPandas()
    assert sorted(zip((tuple(f) for f in parts.features), parts.label, parts.weight, strict=True)) == want
    assert set(parts.path) == {f"replay-{k}" for k in range(4)} and all(sorted(g.row_id) == list(range(len(g))) for _, g in parts.groupby("path"))


def files(spark, *contents):
    return spark.createDataFrame([(f"f{k}", c) for k, c in enumerate(contents)], "path string, content binary")


def test_bad_files_raise_or_are_left_out(spark):
    name = "ä" * 100  # a name whose length takes two bytes
    good = struct.pack("<ii", tf.PAIR_MARK, 1) + tf.prefixed(name) + struct.pack("<ii", 2, 1) + bytes([255, 0, 51, 3, 0, 255, 0, 1])
    bad = [b"", b"abcdefgh", good[:-1], good[:9], struct.pack("<ii", tf.PAIR_MARK, 2) + good[8:], None]
    rows = tf.decode_pairs(files(spark, good, *bad), skip=True).orderBy("x").collect()
    assert [(r.name, r.x, r.r, r.b, r.damage, r.known) for r in rows] == [(name, 0, 1.0, 0.2, True, True), (name, 1, 0.0, 0.0, True, False)]
    for content in bad:
        with pytest.raises(PythonException):
            tf.decode_pairs(files(spark, content)).collect()
    head = lambda n, width: struct.pack("<iiiii", tf.REPLAY_MARK, 1, n, width, 1)
    assert tf.decode_replay(files(spark, head(0, 33), head(1, 34), b"x", head(0, 34)), skip=True).count() == 0
    with pytest.raises(PythonException):
        tf.decode_replay(files(spark, head(0, 33))).collect()


def test_corrupt_documents_are_not_listed(spark):
    docs = spark.createDataFrame([("a", '{"id": "a", "added_utc": "2024-05-01T00:00:00.000000"}'), ("b", "{"), ("c", None), ("d", '{"id": "d", "added_utc": "2023-05-01T00:00:00.000000"}')], "id string, json string")
    assert [r.id for r in lb.listed(docs, docs.select("id")).collect()] == ["d", "a"]
    assert [r.id for r in lb.listed(docs, docs.where("id = 'a'")).collect()] == ["a"]
    paths = spark.createDataFrame([("/a/b.c/x.y.png",), ("C:\\s\\n",), ("",)], "p string")
    assert [tuple(r) for r in paths.select(lb.file_name("p"), lb.file_stem("p")).collect()] == [("x.y.png", "x.y"), ("n", "n"), ("", "")]


def test_image_files_come_back(spark, tmp_path):
    p = rt.drawn_raster(spark)
    (tmp_path / "a.png").write_bytes(bytes(rt.encode_images(p).first().content))
    (tmp_path / "b.txt").write_text("no image")
    got = rt.image_files(spark, str(tmp_path)).select("y", "x", "width", "height", "r", "g", "b").toPandas().sort_values(["y", "x"])
    want = p.toPandas().sort_values(["y", "x"])
    assert (got.width.iloc[0], got.height.iloc[0]) == (48, 40)
    assert np.allclose(got[["r", "g", "b"]], np.round(want[["r", "g", "b"]].clip(0, 1) * 255) / 255, atol=1e-9)
