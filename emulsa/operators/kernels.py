"""Operators whose steps depend on each other within an image: components by tiles, diffusion by bundles of components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.plans.stages import written

SWEEPS = 250
#: Side of the tiles that are labelled apart, and hole pixels that one task fills together.
TILE, BUNDLE = 1024, 20_000


def label_components(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean plane, -1 off: the least index of each, by sweeping minima until stable."""
    h, w = mask.shape
    index = np.where(mask, np.arange(h * w).reshape(h, w), -1)
    label = index.copy()
    while True:
        new = label.copy()
        for a, b in (((slice(1, None), slice(None)), (slice(None, -1), slice(None))), ((slice(None), slice(1, None)), (slice(None), slice(None, -1)))):
            on = mask[a] & mask[b]
            least = np.minimum(new[a], new[b])
            new[a] = np.where(on, least, new[a])
            new[b] = np.where(on, np.minimum(new[b], least), new[b])
        flat = new.ravel()
        on = flat >= 0
        flat[on] = flat[flat[on]]  # halve the paths
        new = flat.reshape(h, w)
        if (new == label).all():
            return label
        label = new


def _tile_labels(on: DataFrame, tile: int) -> DataFrame:
    """image_id, y, x, width and node: the least place of the pixel's component within its tile."""

    def run(group: pa.Table) -> pa.Table:
        y, x, width = (group[c].to_numpy() for c in ("y", "x", "width"))
        y0, x0 = int(y[0]) // tile * tile, int(x[0]) // tile * tile
        plane = np.zeros((int(y.max()) - y0 + 1, int(x.max()) - x0 + 1), bool)
        plane[y - y0, x - x0] = True
        least = label_components(plane)[y - y0, x - x0]
        node = (least // plane.shape[1] + y0) * width.astype(np.int64) + least % plane.shape[1] + x0
        return group.select(["image_id", "y", "x", "width"]).append_column("node", pa.array(node, pa.int64()))

    tiles = [F.floor(F.col(c) / tile).alias(f"_t{c}") for c in "yx"]
    return on.groupBy("image_id", *tiles).applyInArrow(run, "image_id long, y int, x int, width int, node long")


def _roots(edges: DataFrame) -> DataFrame:
    """image_id, node and root, the least node that it is tied to, by passing minima on and halving paths until nothing changes."""
    both = written(edges.select("image_id", "a", "b").union(edges.select("image_id", "b", "a")).distinct())
    roots, before = both.select("image_id", F.col("a").alias("node"), F.col("a").alias("root")).distinct(), None
    while True:
        other = roots.select("image_id", F.col("node").alias("b"), F.col("root").alias("near"))
        near = both.join(other, ["image_id", "b"]).groupBy("image_id", F.col("a").alias("node")).agg(F.min("near").alias("near"))
        passed = written(roots.join(near, ["image_id", "node"]).select("image_id", "node", F.least("root", "near").alias("root")))
        up = passed.select("image_id", F.col("node").alias("root"), F.col("root").alias("up"))
        roots = written(passed.join(up, ["image_id", "root"]).select("image_id", "node", F.col("up").alias("root")))
        now = roots.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return roots
        before = now


def components(df: DataFrame, flag: str, tile: int = TILE) -> DataFrame:
    """image_id, y, x and component (least y * width + x) of flagged pixels.

    Tiles are labelled apart, so that a task holds a tile and not an image; labels that touch across a border
    are merged.
    """
    on = df.where(flag).select("image_id", *[F.col(c).cast("int").alias(c) for c in ("y", "x", "width")])
    labels = written(_tile_labels(on, tile))
    edges = []
    for c in "xy":
        first = labels.where(F.col(c) % tile == tile - 1).select("image_id", *[(F.col(k) + int(k == c)).alias(k) for k in "yx"], F.col("node").alias("a"))
        edges.append(first.join(labels.where(F.col(c) % tile == 0).select("image_id", "y", "x", F.col("node").alias("b")), ["image_id", "y", "x"]))
    edges = written(edges[0].unionByName(edges[1]).select("image_id", "a", "b").distinct())
    if edges.isEmpty():
        return labels.select("image_id", "y", "x", F.col("node").alias("component"))
    return labels.join(_roots(edges), ["image_id", "node"], "left").select("image_id", "y", "x", F.coalesce("root", "node").alias("component"))


def identity_guard(df: DataFrame, flag: str, most: float = 0.06) -> DataFrame:
    """Whether the largest flagged component is at most ``most`` of the image."""
    size = components(df, flag).groupBy("image_id", "component").count().groupBy("image_id").agg(F.max("count").alias("largest"))
    n = df.groupBy("image_id").agg(F.count("*").alias("n"))
    share = F.coalesce(F.col("largest"), F.lit(0)) / F.col("n")
    return n.join(size, "image_id", "left").select("image_id", share.alias("deviation"), (share <= most).alias("passed"))


def diffuse(y: np.ndarray, x: np.ndarray, part: np.ndarray, values: np.ndarray, hole: np.ndarray, width: int, height: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Values of pixels after the holes among them are filled.

    Each hole starts from its known 8-neighbours' mean and then, in reading order and in place, becomes the
    mean of its four neighbours, again and again; coordinates clamp at the image's border.  Pixels come as a list;
    those of different ``part`` don't see each other, and the pixels that a hole touches are listed.
    """
    place = (part * height + y) * width + x
    order = np.argsort(place)
    at = place[order]

    def other(dy: int, dx: int) -> np.ndarray:
        """Index of every hole's neighbour, -1 where it isn't listed."""
        p, q = hy + dy, hx + dx
        key = (part[holes] * height + p) * width + q
        k = np.minimum(np.searchsorted(at, key), len(at) - 1)
        return np.where((p >= 0) & (p < height) & (q >= 0) & (q < width) & (at[k] == key), order[k], -1)

    holes = np.flatnonzero(hole)
    if not len(holes):
        return values
    hy, hx, out = y[holes], x[holes], values.astype(np.float64).copy()
    total, n = np.zeros((len(holes), values.shape[1])), np.zeros(len(holes))
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            k = other(dy, dx)
            known = (k >= 0) & ~hole[k]
            total[known] += values[k[known]]
            n += known
    out[holes[n > 0]] = total[n > 0] / n[n > 0, None]
    near = [np.where((k := other(dy, dx)) >= 0, k, holes) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    # holes of one anti-diagonal don't touch, and reading order visits what lies above and left first; as parts are
    # apart, each counts its diagonals from its own first one
    first = np.full(int(part.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, part[holes], hy + hx)
    diagonal = hy + hx - first[part[holes]]
    sort = np.argsort(diagonal, kind="stable")
    steps = [(holes[k], [m[k] for m in near]) for k in np.split(sort, np.flatnonzero(np.diff(diagonal[sort])) + 1)]
    for _ in range(sweeps):
        for k, (up, down, left, right) in steps:
            out[k] = (out[up] + out[down] + out[left] + out[right]) / 4
    return out


def inpaint(masked: DataFrame, hole: str = "hole", strength: float = 1.0, bundle: int = BUNDLE) -> DataFrame:
    """Diffusion inpainting of flagged pixels; others, and alpha, stay as they are.

    Components of holes don't see each other, so a task fills a bundle of whole components, of about ``bundle`` hole
    pixels together, from them and their rim; an image is never gathered.  A single larger component is one task.
    """
    if strength <= 0:
        return masked.drop(hole)
    keys = ["image_id", "y", "x"]
    parts = written(components(masked, hole))
    bundles = parts.groupBy("image_id").agg(F.ceil(F.count("*") / bundle).alias("_n"))
    parts = parts.join(bundles, "image_id").withColumn("_bundle", F.pmod(F.xxhash64("component"), F.col("_n")))
    step = lambda c: F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1))
    rim = parts.select("image_id", "_bundle", "component", F.col("y").alias("_y"), F.col("x").alias("_x"), step("y").alias("y")).withColumn("x", step("_x"))
    rim = rim.groupBy("image_id", "_bundle", "component", "y", "x").agg(F.max((F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x"))).alias("own"))
    rim = rim.join(masked.select(*keys, "width", "height", "r", "g", "b", F.col(hole).alias("_hole")), keys)

    def run(group: pa.Table) -> pa.Table:
        own = group["own"].to_numpy(zero_copy_only=False)
        _, part = np.unique(group["component"].to_numpy(), return_inverse=True)
        values = np.stack([group[c].to_numpy() for c in "rgb"], 1)
        # another component's holes, met across a corner, are neither filled here nor known
        use = own | ~group["_hole"].to_numpy(zero_copy_only=False)
        y, x = (group[c].to_numpy().astype(np.int64)[use] for c in "yx")
        filled = diffuse(y, x, part[use], values[use], own[use], group["width"][0].as_py(), group["height"][0].as_py())[own[use]]
        new = values[own] + (filled - values[own]) * strength
        return group.filter(pa.array(own)).select(keys).append_column("_r", pa.array(new[:, 0])).append_column("_g", pa.array(new[:, 1])).append_column("_b", pa.array(new[:, 2]))

    filled = rim.groupBy("image_id", "_bundle").applyInArrow(run, "image_id long, y int, x int, _r double, _g double, _b double")
    out = masked.join(filled, keys, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in "rgb"})
    return out.select(*[c for c in masked.columns if c != hole])
