"""Diffusion, components, tiled fills, grain and whole runs against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emulsa.operators import damage as dm
from emulsa.operators import fill as fl
from emulsa.operators import kernels as kn
from emulsa.plans import restoration, training


def table(spark, planes, image=1, **more):
    h, w = planes.shape[:2]
    y, x = (a.ravel() for a in np.indices((h, w)))
    pdf = pd.DataFrame({"image_id": image, "y": y, "x": x, "width": w, "height": h} | {c: planes[..., k].ravel() for k, c in enumerate("rgb")} | {k: v.ravel() for k, v in more.items()})
    return spark.createDataFrame(pdf).selectExpr("image_id", "cast(y as int) as y", "cast(x as int) as x", "cast(width as int) as width", "cast(height as int) as height", *[c for c in pdf.columns if c not in ("image_id", "y", "x", "width", "height")])


def planes_of(df, shape, cols="rgb"):
    d = (df.toPandas() if hasattr(df, "toPandas") else df).sort_values(["y", "x"])
    return np.stack([d[c].to_numpy() for c in cols], -1).reshape(*shape, len(cols))


def gaussian_plane(plane, sigma):
    r = max(1, round(4 * sigma))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        pad = [(0, 0)] * plane.ndim
        pad[axis] = (r, r)
        wide = np.pad(plane, pad, mode="reflect" if plane.shape[axis] > r else "symmetric")
        plane = sum(k[i] * np.take(wide, np.arange(i, i + plane.shape[axis]), axis) for i in range(2 * r + 1))
    return plane


def plain_diffusion(planes, hole, sweeps):
    """Gauss-Seidel in reading order, one pixel after the other."""
    out, (h, w) = planes.copy(), hole.shape
    for y, x in zip(*np.nonzero(hole), strict=True):
        near = [planes[j, i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if not hole[j, i]]
        if near:
            out[y, x] = np.mean(near, 0)
    for _ in range(sweeps):
        for y, x in zip(*np.nonzero(hole), strict=True):
            out[y, x] = (out[max(y - 1, 0), x] + out[min(y + 1, h - 1), x] + out[y, max(x - 1, 0)] + out[y, min(x + 1, w - 1)]) / 4
    return out


def picture(h, w, seed=0):
    return np.random.default_rng(seed).uniform(size=(h, w, 3))


def holes(h, w, share=0.35, seed=1):
    """Specks, a blotch at the border, a line, and holes that touch only across corners."""
    hole = np.random.default_rng(seed).uniform(size=(h, w)) < share
    hole[: h // 3, : w // 4] = True
    hole[h // 2, :] = True
    return hole


@pytest.mark.parametrize("bundle", [3, 20_000])
def test_inpaint(spark, monkeypatch, bundle):
    monkeypatch.setattr(kn, "SWEEPS", 250)
    images = {1: (picture(13, 17), holes(13, 17)), 2: (picture(9, 6, 3), np.ones((9, 6), bool)), 3: (picture(5, 8, 4), np.zeros((5, 8), bool))}
    df = None
    for k, (p, h) in images.items():
        one = table(spark, p, k, hole=h, a=np.full(h.shape, 0.5), note=np.full(h.shape, "x"))
        df = one if df is None else df.unionByName(one)
    got = kn.inpaint(df, strength=0.8, bundle=bundle)
    assert got.columns == [c for c in df.columns if c != "hole"] and got.count() == df.count()
    got = got.toPandas()
    for k, (p, h) in images.items():
        want = p + (plain_diffusion(p, h, 250) - p) * 0.8 * h[..., None]
        assert np.allclose(planes_of(got[got.image_id == k], h.shape), want)
    assert set(got.a) == {0.5} and kn.inpaint(df, strength=0).count() == df.count()
    assert kn.inpaint(df.where("false")).count() == 0


@pytest.mark.parametrize("tile", [4, 7, 1024])
def test_components_over_tiles(spark, tile):
    """Labels that cross many tiles are those of the whole plane."""
    spiral = np.zeros((23, 29), bool)
    y, x, dy, dx, steps = 0, 0, 0, 1, 400
    while steps:
        spiral[y, x] = True
        j, i = y + 2 * dy, x + 2 * dx
        ahead = 0 <= y + dy < 23 and 0 <= x + dx < 29 and not (0 <= j < 23 and 0 <= i < 29 and spiral[j, i])
        if not ahead:
            dy, dx = dx, -dy
            if not (0 <= y + 2 * dy < 23 and 0 <= x + 2 * dx < 29) or spiral[y + 2 * dy, x + 2 * dx]:
                break
        y, x, steps = y + dy, x + dx, steps - 1
    planes = {1: spiral, 2: np.random.default_rng(2).uniform(size=(23, 29)) < 0.6, 3: np.ones((5, 90), bool), 4: np.zeros((3, 3), bool)}
    df = None
    for k, on in planes.items():
        one = table(spark, np.zeros((*on.shape, 3)), k, on=on)
        df = one if df is None else df.unionByName(one)
    got = kn.components(df, "on", tile).toPandas()
    for k, on in planes.items():
        want = kn.label_components(on)
        mine = got[got.image_id == k]
        assert len(mine) == on.sum() and (want[mine.y, mine.x] == mine.component).all()


# --- tiled fill ---------------------------------------------------------------------------------------
def matrix(n, m, cubic=False):
    """(m, n): area means where it shrinks, else linear or cubic taps."""
    out = np.zeros((m, n))
    if m <= n and not cubic:
        for o in range(m):
            a, b = o * n / m, (o + 1) * n / m
            for k in range(n):
                out[o, k] = max(0, min(k + 1, b) - max(k, a)) / (n / m)
        return out
    keys = lambda d: np.where(d <= 1, (1.25 * d - 2.25) * d * d + 1, np.where(d < 2, ((-0.75 * d + 3.75) * d - 6) * d + 3, 0))
    for o in range(m):
        f = (o + 0.5) * n / m - 0.5
        low = int(np.floor(f))
        for k in range(low - 1, low + 3):
            d = abs(f - k)
            out[o, min(max(k, 0), n - 1)] += keys(d) if cubic else max(0, 1 - d)
    return out


def both_axes(plane, w, h, cubic=False):
    if plane.shape[:2] == (h, w):
        return plane
    if not cubic and (w > plane.shape[1] or h > plane.shape[0]):
        linear = lambda n, m: matrix(n, m) if m > n else _linear(n, m)
        return np.einsum("oy,yxc,px->opc", linear(plane.shape[0], h), plane, linear(plane.shape[1], w))
    return np.einsum("oy,yxc,px->opc", matrix(plane.shape[0], h, cubic), plane, matrix(plane.shape[1], w, cubic))


def _linear(n, m):
    out = np.zeros((m, n))
    for o in range(m):
        f = (o + 0.5) * n / m - 0.5
        low = int(np.floor(f))
        for k in (low, low + 1):
            out[o, min(max(k, 0), n - 1)] += 1 - abs(f - k)
    return out


def plain_fill(p, hole, probability, protected, model, tile, overlap, long_side, strength):
    h, w = hole.shape
    grown = np.zeros_like(hole)
    for y, x in zip(*np.nonzero(hole), strict=True):
        grown[max(0, y - 6) : y + 7, max(0, x - 6) : x + 7] = True
    stays = protected | (~hole & (probability < 0.15))
    fill = (grown & ~stays).astype(float)
    scale = min(1, long_side / max(w, h))
    ww, wh = max(tile, round(w * scale)), max(tile, round(h * scale))
    work = both_axes(np.dstack([p, fill]), ww, wh)
    planes, mask = work[..., 2::-1].transpose(2, 0, 1).copy(), work[..., 3] > 0.01
    starts = lambda n: [*range(0, n - tile, tile - overlap), n - tile]
    for y in starts(wh):
        for x in starts(ww):
            part = mask[y : y + tile, x : x + tile]
            if part.any():
                got = model(planes[:, y : y + tile, x : x + tile], part.astype(float))
                for c in range(3):
                    planes[c, y : y + tile, x : x + tile][part] = np.clip(got[c][part] / 255, 0, 1)
                part[:] = False
    full = both_axes(planes.transpose(1, 2, 0)[..., ::-1], w, h, cubic=True)
    a = np.where(stays, 0, np.maximum(gaussian_plane(fill, 1.5), fill)) * strength
    return np.where(a[..., None] > 0, np.clip(p + (np.clip(full, 0, 1) - p) * a[..., None], 0, 1), p)


class Failing:
    def __call__(self):
        raise RuntimeError("no weights")


def test_tiled_fill(spark):
    """Images that shrink, grow to a tile and keep their size, in one run; a failing model falls back."""
    images, df = {}, None
    for k, (h, w) in {1: (60, 44), 2: (20, 36), 3: (33, 40), 4: (30, 30)}.items():
        r = np.random.default_rng(k)
        hole = np.zeros((h, w), bool)
        if k < 4:
            hole[5:12, 6:10] = hole[h - 4 :, w // 2] = True
        images[k] = (picture(h, w, k), hole, r.uniform(size=(h, w)), r.uniform(size=(h, w)) < 0.1)
        one = table(spark, images[k][0], k, hole=hole, probability=images[k][2], protected=images[k][3])
        df = one if df is None else df.unionByName(one)
    got = fl.tiled_fill(df, training.MeanFill(), tile=32, overlap=8, long_side=40, strength=0.9).toPandas()
    assert set(got.note) == {""} and len(got) == df.count()
    for k, (p, hole, probability, protected) in images.items():
        want = plain_fill(p, hole, probability, protected, training.MeanFill()(), 32, 8, 40, 0.9)
        mine = planes_of(got[got.image_id == k], hole.shape)
        assert np.allclose(mine, want), k
        assert np.array_equal(mine[protected], p[protected]) and (k == 4) == np.array_equal(mine, p)
    plain = kn.inpaint(df.select("image_id", "y", "x", "width", "height", "r", "g", "b", "hole"), "hole").toPandas()
    for factory, note in ((Failing(), "fallback: no weights"), (None, "no model")):
        got = fl.tiled_fill(df, factory, tile=32, overlap=8, long_side=40).toPandas()
        assert set(got[got.image_id < 4].note) == {note}
        for k in images:
            assert np.allclose(planes_of(got[got.image_id == k], images[k][1].shape), planes_of(plain[plain.image_id == k], images[k][1].shape))
    assert np.allclose(planes_of(fl.tiled_fill(df.where("image_id = 1"), None, strength=0), (60, 44)), images[1][0])


# --- grain and runs -----------------------------------------------------------------------------------
def masked(spark, side=96, sigma=0.03):
    r = np.random.default_rng(7)
    p = np.clip(0.5 + r.normal(0, sigma, (side, side, 1)) + np.zeros(3), 0, 1)
    probability = np.zeros((side, side))
    probability[20:60, 20:60] = 0.9
    kind = np.where(probability > 0, dm.TYPES[1], dm.TYPES[0])
    return table(spark, p, 1, probability=probability, damage_type=kind, protected=np.zeros((side, side), bool), a=np.ones((side, side))), p, probability > 0.5


def test_grain_match(spark):
    """Pixels off the rebuilt area stay as they are; on it the noise has the picture's own deviation."""
    df, p, rebuilt = masked(spark)
    flat = df.withColumns({c: F.when(F.col("probability") > 0, 0.5).otherwise(F.col(c)) for c in "rgb"})
    got = planes_of(dm.grain_match(flat, df), rebuilt.shape)
    assert np.array_equal(got[~rebuilt], p[~rebuilt])
    lum = p @ [0.2126, 0.7152, 0.0722]
    inner = lum[1:-1, 1:-1] - (lum[:-2, 1:-1] + lum[2:, 1:-1] + lum[1:-1, :-2] + lum[1:-1, 2:]) / 4
    sigma = np.sqrt((inner[~rebuilt[1:-1, 1:-1]] ** 2).mean())
    noise = got[rebuilt] - 0.5
    assert abs(noise.std() / sigma - 1) < 0.05 and abs(noise.mean()) < 0.1 * sigma
    assert np.array_equal(got, planes_of(dm.grain_match(flat.repartition(3), df), rebuilt.shape))
    still = flat.withColumns({c: F.lit(0.5) for c in "rgb"})
    assert np.array_equal(planes_of(dm.grain_match(still, still), rebuilt.shape), np.full((*rebuilt.shape, 3), 0.5))


def test_restoration_is_its_stages(spark):
    """Toned pixels, filled by plain diffusion, grained, sharpened; strict and failed, the toned ones go on."""
    df, _, rebuilt = masked(spark, 48)
    s = dm.Settings()
    toned = dm.color_restore(df, s.color)
    p = planes_of(toned, rebuilt.shape)
    wide = toned.toPandas().sort_values(["y", "x"]).reset_index(drop=True)

    def finished(planes):
        pdf = wide.copy()
        pdf[["r", "g", "b"]] = planes.reshape(-1, 3)
        return planes_of(dm.unsharp(dm.grain_match(spark.createDataFrame(pdf, toned.schema), df), s.sharpening), rebuilt.shape)

    filled = p + (plain_diffusion(p, rebuilt, kn.SWEEPS) - p) * s.reconstruction * rebuilt[..., None]
    assert np.allclose(planes_of(restoration.restore(df, s), rebuilt.shape), finished(filled))
    strict = dm.Settings(strict_guard=True)
    assert np.allclose(planes_of(restoration.restore(df, strict), rebuilt.shape), finished(p))
    report = {r.stage: r for r in restoration.report(df, strict).collect()}
    share = rebuilt.sum() / rebuilt.size
    assert len(report) == 6 and not report["IdentityGuard"].applied and f"{100 * share:.2f}%" in report["IdentityGuard"].message and "kept the toned" in report["IdentityGuard"].message
    assert "warning" in {r.stage: r.message for r in restoration.report(df, s).collect()}["IdentityGuard"]
    small = df.withColumn("probability", F.when(F.expr("y < 3 and x < 3"), 0.9).otherwise(0.0))
    rows = {r.stage: r for r in restoration.report(small, strict).collect()}
    assert rows["IdentityGuard"].applied and "passed" in rows["IdentityGuard"].message
    sigma = dm.grain_sigma(small).first().sigma
    assert f"{sigma:.4f}" in rows["Grain"].message
    with pytest.raises(NotImplementedError):
        restoration.restore(df, dm.Settings(enhance=True))


def test_stages_can_be_exchanged(spark):
    """A model's fill, another guard, an enhancer and a detector take their places in a run."""
    df, p, rebuilt = masked(spark, 40)
    s = dm.Settings(grain=False, sharpening=0.0, color=0.0, enhance=True)
    seen = []
    stages = restoration.Stages(fill=restoration.tiled(training.MeanFill()), enhance=lambda d: seen.append(1) or d.withColumn("r", F.col("r") / 2), detect=lambda d, s: d.withColumn("probability", F.when(F.expr("y between 20 and 29 and x between 20 and 29"), 0.9).otherwise(0.0)))
    got = planes_of(restoration.restore(df, s, stages), rebuilt.shape)
    detected = df.withColumn("probability", F.when(F.expr("y between 20 and 29 and x between 20 and 29"), 0.9).otherwise(0.0))
    want = planes_of(fl.tiled_fill(detected.withColumn("hole", F.col("probability") > 0), training.MeanFill(), strength=s.reconstruction), rebuilt.shape) * [0.5, 1, 1]
    assert np.allclose(got, want) and seen == [1]
    never = restoration.Stages(guard=lambda d, s: d.groupBy("image_id").agg(F.lit(1.0).alias("deviation"), F.lit(False).alias("passed")))
    kept = planes_of(restoration.restore(df, dm.Settings(grain=False, sharpening=0.0, color=0.0, strict_guard=True), never), rebuilt.shape)
    assert np.allclose(kept, p)
