"""Operators without SQL: against NumPy on whole small tables."""

import numpy as np

from emulsa.operators import damage as dm
from emulsa.operators import faces as fc
from emulsa.operators import learning as ln
from emulsa.operators import neighbourhood as nb
from emulsa.plans import catalogue, restoration
from emulsa.sources.rasters import drawn_raster


def test_suppression_keeps_what_greedy_order_keeps(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k % 3), *[float(v) for v in rng.uniform(0, 40, 2)], *[float(v) for v in rng.uniform(4, 16, 2)], float(rng.random())) for k in range(120)]
    got = {tuple(r) for r in fc.suppress(spark.createDataFrame(rows, "image_id long, x double, y double, width double, height double, score double")).collect()}
    want = set()
    for image in range(3):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[5], r[1], r[2])):
            def overlap(o, r=r):
                w, h = min(o[1] + o[3], r[1] + r[3]) - max(o[1], r[1]), min(o[2] + o[4], r[2] + r[4]) - max(o[2], r[2])
                both = max(w, 0) * max(h, 0)
                return both / (o[3] * o[4] + r[3] * r[4] - both)

            if all(overlap(o) <= 0.3 for o in kept):
                kept.append(r)
        want |= set(kept)
    assert got == want


def plane(df, column):
    p = df.select("y", "x", column).toPandas()
    out = np.zeros((p.y.max() + 1, p.x.max() + 1))
    out[p.y, p.x] = p[column]
    return out


def test_gaussian_of_wide_and_narrow_planes(spark):
    """Reflected borders, also where the radius exceeds the plane; a sigma by column is the same as a constant."""
    df = drawn_raster(spark).where("y < 4").withColumn("height", catalogue.F.lit(4))
    for sigma in (0.7, 1.9):
        r = max(1, round(4 * sigma))
        w = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
        w /= w.sum()
        want = plane(df, "r")
        for axis in (1, 0):
            n = want.shape[axis]
            at = np.arange(n)[:, None] + np.arange(-r, r + 1)
            at = at % (2 * n - 2)
            at = np.where(at >= n, 2 * n - 2 - at, at)
            want = np.moveaxis(np.moveaxis(want, axis, -1)[..., at] @ w, -1, axis)
        assert np.allclose(plane(nb.gaussian(df, {"soft": "r"}, sigma), "soft"), want)
        assert np.allclose(plane(nb.gaussian(df, {"soft": "r"}, catalogue.F.lit(sigma), 2.5), "soft"), want)


def test_learned_detector_is_its_parts(spark):
    df, network = drawn_raster(spark), catalogue.detector_network()
    wide, names = ln.features(df)
    p = wide.select("y", "x", *names).toPandas().sort_values(["y", "x"])
    raw = network.predict(p[names].to_numpy()).reshape(p.y.max() + 1, -1)
    padded = np.pad(raw, 1, mode="edge")
    want = sum(padded[i : i + raw.shape[0], j : j + raw.shape[1]] for i in range(3) for j in range(3)) / 9
    got = ln.learned_detector(df, network)
    assert np.allclose(plane(got, "raw"), want)
    assert len(names) == 34 and 0 <= plane(got, "probability").min() <= plane(got, "probability").max() <= 1


def test_faces_are_locked_in_a_run(spark):
    m = catalogue.F
    df = drawn_raster(spark).withColumns({"probability": m.lit(0.7), "damage_type": m.lit(dm.TYPES[1]), "protected": m.lit(False)})
    faces = spark.createDataFrame([(1_000_000, 10.0, 10.0, 8.0, 8.0)], "image_id long, x double, y double, width double, height double")
    got = restoration.restore(df, dm.Settings(), faces=faces)
    p = got.select("y", "x", "probability").toPandas().set_index(["y", "x"]).probability
    assert p[14, 14] == 0 and p[0, 0] == 0.7
    q = restoration.restore(df, dm.Settings(lock_faces=False), faces=faces).select("y", "x", "probability").toPandas()
    assert (q.probability == 0.7).all()
