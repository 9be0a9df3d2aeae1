"""Operators that treat every image at its own size, against NumPy."""

import numpy as np
import pytest
from tests.test_training import shapes, table

from emulsa.operators import alignment as al
from emulsa.operators import faces as fc
from emulsa.operators import learning as ln
from emulsa.operators import resample as rs
from emulsa.operators import sessions
from emulsa.plans import catalogue


def area_matrix(n, m):
    edges = np.arange(m + 1) * n / m
    k = np.arange(n)
    return np.clip(np.minimum(k + 1, edges[1:, None]) - np.maximum(k, edges[:-1, None]), 0, None) / (n / m)


def linear_matrix(n, m):
    out, f = np.zeros((m, n)), (np.arange(m) + 0.5) * n / m - 0.5
    low = np.floor(f).astype(int)
    for o in range(m):
        out[o, np.clip(low[o], 0, n - 1)] += 1 - (f[o] - low[o])
        out[o, np.clip(low[o] + 1, 0, n - 1)] += f[o] - low[o]
    return out


def resized(plane, w, h):
    one = area_matrix if w <= plane.shape[1] and h <= plane.shape[0] else linear_matrix
    return one(plane.shape[0], h) @ plane @ one(plane.shape[1], w).T


def sides(w, h, long_side, grow=False):
    scale = long_side / max(w, h) if grow else min(1, long_side / max(w, h))
    return max(1, round(w * scale)), max(1, round(h * scale))


def plane(df, image, c):
    d = df[df.image_id == image].sort_values(["y", "x"])
    h, w = int(d.y.max()) + 1, int(d.x.max()) + 1
    assert len(d) == w * h and set(d.width) == {w} and set(d.height) == {h}
    return d[c].to_numpy().reshape(h, w)


@pytest.fixture(scope="module")
def three(spark):
    """Images of 60 x 40, 20 x 30 and 33 x 47 in one table."""
    images = {1: shapes(60, 40), 2: shapes(20, 30, fine=3), 3: shapes(33, 47, fine=5)}
    first, *rest = [table(spark, p, k) for k, p in images.items()]
    for r in rest:
        first = first.unionByName(r)
    return first, images


def test_resize_each(spark, three):
    df, images = three
    to = {1: (25, 17), 2: (41, 52), 3: (33, 47)}
    sizes = spark.createDataFrame([(k, images[k].shape[1], images[k].shape[0], *v) for k, v in to.items()], "image_id long, width int, height int, to_width int, to_height int")
    got = rs.resize_each(df, ["r", "b"], sizes).toPandas()
    for k, (w, h) in to.items():
        for c, i in (("r", 0), ("b", 2)):
            assert np.allclose(plane(got, k, c), resized(images[k][..., i], w, h))
    assert len(got) == sum(w * h for w, h in to.values())
    assert rs.resize_each(df.where("false"), ["r"], sizes).count() == 0


def raw_by_spark_at_one_size(spark, planes, network):
    return plane(ln.learned_raw(table(spark, planes), network).toPandas(), 1, "raw")


def test_detector_at_size(spark, three, tmp_path):
    """Two images shrink, one keeps its size; each is as if it were alone."""
    df, images = three
    network = catalogue.detector_network()
    got = ln.as_mask(ln.detected_raw(df, network, 36), network, 0.3).toPandas()
    for k, p in images.items():
        w, h = sides(p.shape[1], p.shape[0], 36)
        small = np.stack([resized(p[..., i], w, h) for i in range(3)], -1) if (w, h) != p.shape[1::-1] else p
        raw = raw_by_spark_at_one_size(spark, small, network)
        raw = resized(raw, p.shape[1], p.shape[0]) if (w, h) != p.shape[1::-1] else raw
        assert np.allclose(plane(got, k, "raw"), raw)
        logit = lambda v: np.log(np.clip(v, 1e-6, 1 - 1e-6) / (1 - np.clip(v, 1e-6, 1 - 1e-6)))
        probability = 1 / (1 + np.exp(-(logit(raw) + 4 * (0.3 - 0.4))))
        assert np.allclose(plane(got, k, "probability"), probability)
        assert (plane(got, k, "damage_type") == np.where(probability > 0.05, ln.SPECKLE, "None")).all()
    # the cache computes an image once, whatever its id
    cache = ln.RawCache(f"file://{tmp_path}", network, 36)
    for found in (cache.raw(df.where("image_id < 3")), cache.raw(df), cache.raw(df)):
        found = found.toPandas()
        assert all(np.allclose(plane(found, k, "raw"), plane(got, k, "raw")) for k in set(found.image_id))
    assert cache.known(spark).select("digest").distinct().count() == 3
    again = cache.raw(df.where("image_id = 2").selectExpr("image_id + 7 as image_id", "y", "x", "width", "height", "r", "g", "b")).toPandas()
    assert np.allclose(plane(again, 9, "raw"), plane(got, 2, "raw")) and cache.known(spark).count() == sum(p.shape[0] * p.shape[1] for p in images.values())


def test_ground_truth_at_size(spark):
    """Scans of two sizes in one run: the labels are those of the fine analysis, voted down."""
    scans, targets, at = {}, {}, []
    for k, (w, h) in {1: (120, 90), 2: (50, 64)}.items():
        target = shapes(w, h, fine=k)
        scan = 0.1 + 0.75 * target
        scan[20:36, 24:40] = 0.97
        scans[k], targets[k] = scan, target
        at.append((k, 1.0, 1.0, 0.0, 0.0, w, h, w, h))
    schema = "image_id long, scale_x double, scale_y double, offset_x double, offset_y double, width int, height int, restored_width int, restored_height int"
    union = lambda d: table(spark, d[1], 1).unionByName(table(spark, d[2], 2))
    got = al.ground_truth_at_size(union(scans), union(targets), spark.createDataFrame(at, schema), 32).toPandas()
    for k, scan in scans.items():
        h, w = scan.shape[:2]
        (ww, wh), (fw, fh) = sides(w, h, 32), sides(w, h, 64)
        fine = np.stack([resized(scan[..., i], fw, fh) for i in range(3)], -1) if (fw, fh) != (w, h) else scan
        flags = al.ground_truth(table(spark, fine, k), table(spark, targets[k], k), spark.createDataFrame([(k, 1.0, 1.0, 0.0, 0.0, fw, fh, w, h)], schema)).toPandas()
        for c, most in (("damage", 0.5), ("known", 0.999)):
            assert np.array_equal(plane(got, k, c), resized(plane(flags, k, c).astype(float), ww, wh) > most)
        assert np.allclose(plane(got, k, "g"), resized(scan[..., 1], ww, wh))
        damage = plane(got, k, "damage")
        assert damage[int(28 * wh / h), int(32 * ww / w)] and damage.mean() < 0.2


# --- faces --------------------------------------------------------------------------------------------
def plain_faces(planes, model, long_sides, tile, overlap, above):
    h, w = planes.shape[:2]
    found = []
    for side in long_sides:
        scale = side / max(w, h)
        sw, sh = sides(w, h, side, grow=True)
        small = [resized(planes[..., c] * 255, sw, sh) if (sw, sh) != (w, h) else planes[..., c] * 255 for c in range(3)]

        def starts(n):
            out = list(range(0, max(n - tile, 0) + 1, tile - overlap))
            return out if out[-1] == max(n - tile, 0) else [*out, n - tile]

        for ty in starts(sh):
            for tx in starts(sw):
                part = np.zeros((3, tile, tile))
                for k, c in enumerate((2, 1, 0)):
                    cut = small[c][ty : ty + tile, tx : tx + tile]
                    part[k, : cut.shape[0], : cut.shape[1]] = cut
                out = model(part.astype(np.float32))
                for stride in (8, 16, 32):
                    n = tile // stride
                    for i in range(n * n):
                        score = np.sqrt(np.clip(out[f"cls_{stride}"][i], 0, 1) * np.clip(out[f"obj_{stride}"][i], 0, 1))
                        if score > above:
                            b = out[f"bbox_{stride}"][4 * i : 4 * i + 4]
                            cx, cy, bw, bh = (i % n + b[0]) * stride, (i // n + b[1]) * stride, np.exp(b[2]) * stride, np.exp(b[3]) * stride
                            found.append(((cx - bw / 2 + tx) / scale, (cy - bh / 2 + ty) / scale, bw / scale, bh / scale, score))
    kept = []

    def iou(a, b):
        both = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    for f in sorted(found, key=lambda f: (-f[4], f[0], f[1])):
        if all(iou(f, k) <= 0.3 for k in kept):
            kept.append(f)
    return kept, len(found)


def test_faces_over_tiles(spark):
    """A picture larger than a tile, one that grows and a narrow one: boxes of both sizes, suppressed across tiles."""
    lit = lambda w, h, spots: np.repeat((0.2 + sum((0.75 * np.exp(-((np.arange(w) - x) ** 2 + (np.arange(h)[:, None] - y) ** 2) / (2.0 * r * r)) for x, y, r in spots), np.zeros((h, w))))[..., None], 3, 2) * [1, 0.9, 0.95]
    images = {1: lit(250, 180, [(60, 50, 12), (129, 90, 9), (220, 150, 20)]), 2: lit(40, 60, [(20, 20, 8)]), 3: lit(7, 90, [(3, 70, 6)]), 4: lit(30, 30, [])}
    df = table(spark, images[1], 1)
    for k in (2, 3, 4):
        df = df.unionByName(table(spark, images[k], k))
    got = fc.detect(df, catalogue.BrightCells(), sides=(96, 192), tile=96, overlap=32, above=0.7).toPandas()
    for k, p in images.items():
        want, all_of = plain_faces(p, catalogue.BrightCells()(), (96, 192), 96, 32, 0.7)
        mine = sorted(map(tuple, got[got.image_id == k][["x", "y", "width", "height", "score"]].to_numpy()))
        assert np.allclose(mine, sorted(want), atol=1e-4) if want else not mine
        assert bool(want) == (k < 4) and (k != 1 or all_of > len(want))


def test_session_is_made_once_a_worker():
    made = []
    for _ in range(3):
        sessions.session("a", lambda: made.append(1) or (lambda planes: {}))
    sessions.session("b", lambda: made.append(1) or (lambda planes: {}))
    assert len(made) == 2
