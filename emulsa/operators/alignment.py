"""Pairs of a damaged scan and its restored version: alignment, warping, ground truth.

An alignment (image_id, scale_x, scale_y, offset_x, offset_y) says where the restored image lies in the
scan's frame, in shares of its width and height.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulsa.functions.pixels import luminance
from emulsa.operators import damage as dm
from emulsa.operators import learning as ln
from emulsa.operators import neighbourhood as nb
from emulsa.operators import resample as rs
from emulsa.plans.stages import written

KEYS = ["image_id", "y", "x"]
#: Search sizes, steps and thresholds: fixed values.
COARSE, SCALES = 96, (0.85, 0.88, 0.91, 0.94, 0.97, 1.0, 1.03)
FINE = ((192, 0.01), (384, 0.004), (768, 0.0015))
LEAST_SCORE, RESIDUAL, TEXTURE = 0.3, 0.10, 1.5
#: At most so many places are drawn for a colour fit.
DRAWS = 300_000

PLANES = "image_id long, side int, width int, height int, full_width int, full_height int, plane array<double>"
PARAMETERS = ["scale_x", "scale_y", "offset_x", "offset_y"]


# --- warp ---------------------------------------------------------------------------------------------
def source_place(o: Column, n_out: Column, n_in: Column, scale: Column, offset: Column) -> Column:
    return ((o + 0.5) / n_out - offset) / scale * n_in - 0.5


def _taps(placed: DataFrame, axis: str, n_out: str, n_in: str, scale: str, offset: str) -> DataFrame:
    """image_id, _o, the source place on the axis and its weight, for the covered output places of one axis."""
    grid = placed.select("image_id", n_out, n_in, scale, offset, F.explode(F.sequence(F.lit(0), F.col(n_out) - 1)).alias("_o"))
    grid = grid.withColumn("_f", source_place(F.col("_o"), F.col(n_out), F.col(n_in), F.col(scale), F.col(offset))).where((F.col("_f") >= 0) & (F.col("_f") <= F.col(n_in) - 1))
    first = F.least(F.floor("_f").cast("int"), F.greatest(F.col(n_in) - 2, F.lit(0)))
    grid = grid.withColumn("_p", first).withColumn("_t", F.col("_f") - F.col("_p"))
    two = F.array(F.struct(F.col("_p").alias("at"), (1 - F.col("_t")).alias("w")), F.struct(F.least(F.col("_p") + 1, F.col(n_in) - 1).alias("at"), F.col("_t").alias("w")))
    return grid.select("image_id", "_o", F.explode(two).alias("_k")).select("image_id", "_o", F.col("_k.at").alias(axis), F.col("_k.w").alias("_w"))


def warp(restored: DataFrame, alignments: DataFrame, cols: list[str]) -> DataFrame:
    """The restored image's columns at the covered pixels of the scan's frame; others have no row.

    alignments also holds width, height (of the scan) and restored_width, restored_height.  The axes are
    separate: each pixel goes to the output rows, then columns, that it is one of the two taps of.
    """
    down = restored.join(_taps(alignments, "y", "height", "restored_height", "scale_y", "offset_y"), ["image_id", "y"])
    down = down.groupBy("image_id", "x", F.col("_o").alias("_y")).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols])
    across = down.join(_taps(alignments, "x", "width", "restored_width", "scale_x", "offset_x"), ["image_id", "x"])
    return across.groupBy("image_id", F.col("_y").alias("y"), F.col("_o").alias("x")).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols])


# --- alignment ----------------------------------------------------------------------------------------
def first_best(df: DataFrame, keys: list[str], score: str, order: list[str], values: list[str]) -> DataFrame:
    """For each key the row of the highest score, the first by order (numbers) where several share it."""
    rank = F.struct(F.col(score), *[-F.col(c) for c in order])
    return df.groupBy(*keys).agg(F.max_by(F.struct(score, *values), rank).alias("_b")).select(*keys, "_b.*")


def gradient_planes(pixels: DataFrame, sides: list[int]) -> DataFrame:
    """For each image and long side, the gradient length of the reduced luminance, as a plane each.

    Spark reduces the images, so that a group holds the pixels of one plane and never an image.
    """
    lum = written(pixels.select(*KEYS, "width", "height", luminance().alias("lum")))
    sizes = written(lum.select("image_id", "width", "height").distinct())
    parts = []
    for side in sides:
        to = [F.greatest(F.lit(8), s) for s in rs.working_size(side)]
        small = rs.resize_each(lum, ["lum"], sizes.withColumns({"to_width": to[0], "to_height": to[1]}))
        parts.append(small.withColumn("side", F.lit(side)))
    full = sizes.select("image_id", F.col("width").alias("full_width"), F.col("height").alias("full_height"))
    whole = reduce(DataFrame.unionByName, parts).join(full, "image_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf.iloc[0]
        small, plane = np.zeros((int(one.height), int(one.width))), np.zeros((int(one.height), int(one.width)))
        small[pdf.y, pdf.x] = pdf.lum
        plane[1:-1, 1:-1] = np.hypot(small[1:-1, 2:] - small[1:-1, :-2], small[2:, 1:-1] - small[:-2, 1:-1])
        return pd.DataFrame([(int(one.image_id), int(one.side), int(one.width), int(one.height), int(one.full_width), int(one.full_height), plane.ravel())], columns=["image_id", "side", "width", "height", "full_width", "full_height", "plane"])

    return whole.groupBy("image_id", "side").applyInPandas(run, PLANES)


def overlap_score(d: np.ndarray, r: np.ndarray, at: np.ndarray) -> float:
    """Normalised correlation of the scan's plane with the placed restored one; -1 below 40 % of the scan."""
    (dh, dw), (rh, rw), (sx, sy, tx, ty) = d.shape, r.shape, at
    fy, fx = ((np.arange(dh) + 0.5) / dh - ty) / sy * rh - 0.5, ((np.arange(dw) + 0.5) / dw - tx) / sx * rw - 0.5
    rows, columns = np.flatnonzero((fy >= 0) & (fy <= rh - 1)), np.flatnonzero((fx >= 0) & (fx <= rw - 1))
    n = len(rows) * len(columns)
    if n < 0.4 * d.size:
        return -1.0
    y, x = np.minimum(fy[rows].astype(int), rh - 2), np.minimum(fx[columns].astype(int), rw - 2)
    wy, wx = (fy[rows] - y)[:, None], fx[columns] - x
    lines = r[y] * (1 - wy) + r[y + 1] * wy
    b, a = lines[:, x] * (1 - wx) + lines[:, x + 1] * wx, d[np.ix_(rows, columns)]
    cov, va, vb = (a * b).sum() - a.sum() * b.sum() / n, (a * a).sum() - a.sum() ** 2 / n, (b * b).sum() - b.sum() ** 2 / n
    return float(cov / np.sqrt(va * vb + 1e-12))


def _plane(row, prefix: str) -> np.ndarray:
    return np.asarray(row[f"{prefix}_plane"]).reshape(row[f"{prefix}_height"], row[f"{prefix}_width"])


def align(damaged: DataFrame, restored: DataFrame) -> DataFrame:
    """image_id, the four parameters and score of each pair, and the sizes that ``warp`` asks for.

    Coarse: a group for each pair tries all scales and shifts.  Fine: coordinate descent on three finer planes.
    """
    sides = [COARSE, *[s for s, _ in FINE]]
    rename = lambda df, p: df.select("image_id", "side", *[F.col(c).alias(f"{p}_{c}") for c in ("width", "height", "full_width", "full_height", "plane")])
    planes = written(rename(gradient_planes(damaged, sides), "d").join(rename(gradient_planes(restored, sides), "r"), ["image_id", "side"]))

    def coarse(pdf: pd.DataFrame) -> pd.DataFrame:
        row, out = pdf.iloc[0], []
        d, r = _plane(row, "d"), _plane(row, "r")
        shape_d, shape_r = row.d_full_width / row.d_full_height, row.r_full_width / row.r_full_height
        for place, scale in enumerate(SCALES):
            sx, sy = (scale, scale * shape_d / shape_r) if shape_r > shape_d else (scale * shape_r / shape_d, scale)
            shifts = [-0.1 + np.arange(int(np.floor((1.2 - s + 1e-9) * n)) + 1) / n for s, n in ((sx, d.shape[1]), (sy, d.shape[0]))]
            tried = np.array([(sx, sy, tx, ty) for tx in shifts[0] for ty in shifts[1]])
            scores = np.array([overlap_score(d, r, t) for t in tried])
            out.append((row.image_id, place, *tried[scores.argmax()], scores.max()))
        return pd.DataFrame(out, columns=["image_id", "place", *PARAMETERS, "score"])

    tries = planes.where(F.col("side") == COARSE).groupBy("image_id").applyInPandas(coarse, "image_id long, place int, scale_x double, scale_y double, offset_x double, offset_y double, score double")
    start = first_best(tries, ["image_id"], "score", ["place"], PARAMETERS).drop("score")

    def fine(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side")
        best, score = pdf[PARAMETERS].iloc[0].to_numpy(float), 0.0
        for (_, first_step), (_, row) in zip(FINE, pdf.iterrows(), strict=True):
            d, r = _plane(row, "d"), _plane(row, "r")
            score, step = overlap_score(d, r, best), first_step
            for _ in range(40):
                before = score
                for move in np.repeat(np.eye(4), 2, axis=0) * np.tile([1, -1], 4)[:, None]:
                    new = overlap_score(d, r, best + step * move)
                    if new > score:
                        best, score = best + step * move, new
                if score == before:
                    step /= 2
                    if step < first_step / 8:
                        break
        one = pdf.iloc[0]
        return pd.DataFrame([(key[0], *best, score, one.d_full_width, one.d_full_height, one.r_full_width, one.r_full_height)])

    sized = "image_id long, scale_x double, scale_y double, offset_x double, offset_y double, score double, width int, height int, restored_width int, restored_height int"
    return planes.where(F.col("side") != COARSE).join(start, "image_id").groupBy("image_id").applyInPandas(fine, sized)


def accepted(alignments: DataFrame) -> DataFrame:
    """Below this correlation the two images are hardly of one photograph."""
    return alignments.where(F.col("score") >= LEAST_SCORE)


# --- ground truth -------------------------------------------------------------------------------------
def with_replacement(df: DataFrame, most: int = DRAWS, seed: int = 0) -> DataFrame:
    """df with ``times``: how often each row is drawn, of as many draws as its image has rows, ``most`` at most.

    Draw k takes the place that a digest of (seed, k) falls on, so that a rerun draws the same rows.
    """
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x")) - 1)
    sizes = df.groupBy("image_id").agg(F.count("*").alias("_n"))
    draws = sizes.select("image_id", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("_n", F.lit(most)) - 1)).alias("_d"))
    digest = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_d").cast("string"))), 1, 8), 16, 10).cast("long")
    picks = draws.select("image_id", F.shiftright(digest * F.col("_n"), 32).cast("int").alias("_k")).groupBy("image_id", "_k").agg(F.count("*").alias("times"))
    return ranked.join(picks, ["image_id", "_k"]).drop("_k")


FIT = "image_id long, tr_fit array<double>, tg_fit array<double>, tb_fit array<double>"


def fitted(rows: DataFrame) -> DataFrame:
    """image_id and ten coefficients for each target, from the normal equations (85 numbers an image)."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        eq = {(r.i, r.j): r.value for r in pdf.itertuples()}
        return pd.DataFrame([(key[0], *[ln.solve(eq, t) for t in ("tr", "tg", "tb")])])

    return ln.normal_equations(rows, ["image_id"]).groupBy("image_id").applyInPandas(run, FIT)


def mapped(fit: str) -> Column:
    return sum((F.expr(e) * F.get(fit, k) for k, e in enumerate(ln.TERMS.values())), F.lit(0.0))


def fit_mapping(known: DataFrame, most: int = DRAWS, passes: int = 3, keep: float = 0.6) -> DataFrame:
    """Colour mapping of each image from r, g, b to tr, tg, tb by trimmed least squares over drawn pixels.

    Each further pass uses the draws whose error is below the one at floor(0.6 (n - 1)) of the last pass.
    Images of fewer than 1000 known pixels overlap too little to learn from and get no row.
    """
    enough = known.groupBy("image_id").count().where("count >= 1000").select("image_id")
    drawn = with_replacement(known.join(enough, "image_id", "left_semi").select(*KEYS, "r", "g", "b", "tr", "tg", "tb"), most)
    drawn = written(drawn.withColumn("_one", F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).drop("_one", "times"))  # each pass reads it twice
    fits = fitted(drawn)
    for _ in range(passes - 1):
        error = sum((F.abs(mapped(f"{t}_fit") - F.col(t)) for t in ("tr", "tg", "tb")), F.lit(0.0)) / 3
        judged = written(drawn.join(fits, "image_id").withColumn("_e", error).drop("tr_fit", "tg_fit", "tb_fit"))
        cut = dm.percentile_floor(judged, "_e", keep).withColumnRenamed("value", "_cut")
        fits = fitted(judged.join(cut, "image_id").where("_e < _cut"))
    return fits


def damage_label(df: DataFrame, residual: str = "residual", texture: str = "texture") -> Column:
    """Covered, and off by more than the picture's own texture there explains."""
    return F.col("valid") & (F.col(residual) > F.greatest(F.lit(RESIDUAL), TEXTURE * F.col(texture)))


def ground_truth(damaged: DataFrame, restored: DataFrame, alignments: DataFrame) -> DataFrame:
    """image_id, y, x, width, height, r, g, b, damage, known of every scan whose colours could be fitted.

    Pixels are at the size of the analysis; ``ground_truth_at_size`` brings larger scans there.
    """
    targets = {"tr": "r", "tg": "g", "tb": "b"}
    placed = warp(restored, alignments, ["r", "g", "b"]).select(*KEYS, *[F.col(c).alias(t) for t, c in targets.items()])
    scans = damaged.join(alignments.select("image_id"), "image_id", "left_semi").select(*KEYS, "width", "height", "r", "g", "b")
    both = scans.join(placed, KEYS, "left").withColumn("valid", F.col("tr").isNotNull()).fillna(0.0, list(targets))
    both = written(nb.cross(both, "valid", "known", False, 2))  # the fit reads it several times, and so do the labels
    fits = fit_mapping(both.where("known"))
    both = both.join(fits, "image_id")
    both = both.withColumns({f"m{t}": F.least(F.greatest(mapped(f"{t}_fit"), F.lit(0.0)), F.lit(1.0)) for t in targets}).drop(*[f"{t}_fit" for t in targets])
    both = both.withColumn("lum", luminance("tr", "tg", "tb")).withColumn("lum_sq", F.col("lum") * F.col("lum"))
    both = nb.gaussian(both, {f"s{t}": t for t in targets} | {f"sm{t}": f"m{t}" for t in targets}, 1.5)
    both = nb.box_mean(both, {"m_lum": "lum", "m_lum_sq": "lum_sq"}, 3)
    both = both.withColumn("residual", sum((F.abs(F.col(f"sm{t}") - F.col(f"s{t}")) for t in targets), F.lit(0.0)) / 3)
    both = both.withColumn("texture", F.sqrt(F.greatest(F.col("m_lum_sq") - F.col("m_lum") * F.col("m_lum"), F.lit(0.0))))
    both = nb.open_close(both.withColumn("labelled", damage_label(both)), "labelled", "damage")
    return both.select(*KEYS, "width", "height", "r", "g", "b", "damage", "known")


def ground_truth_at_size(damaged: DataFrame, restored: DataFrame, alignments: DataFrame, long_side: int = ln.WORKING_SIDE) -> DataFrame:
    """``ground_truth`` of scans of any size, analysed at twice the working size and voted down to it.

    A pixel is damaged if more than half of its area is, and known if all of it is (0.999).
    """
    sizes = written(damaged.select("image_id", "width", "height").distinct())
    work = dict(zip(("to_width", "to_height"), rs.working_size(long_side), strict=True))
    there = sizes.withColumns(work)
    fine_scale = F.least(F.lit(1.0), 2.0 * F.greatest("to_width", "to_height") / F.greatest("width", "height"))
    fine = there.select("image_id", "width", "height", *[F.greatest(F.lit(1), F.bround(F.col(n) * fine_scale).cast("int")).alias(f"to_{n}") for n in ("width", "height")])
    placed = alignments.drop("width", "height").join(fine.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height")), "image_id")
    flags = written(ground_truth(rs.resize_each(damaged, ["r", "g", "b"], fine), restored, placed))
    down = fine.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height")).join(there.select("image_id", "to_width", "to_height"), "image_id")
    found = flags.withColumns({c: F.col(c).cast("double") for c in ("damage", "known")})
    found = rs.resize_each(found, ["damage", "known"], down.join(flags.select("image_id").distinct(), "image_id", "left_semi"))
    votes = found.select(*KEYS, (F.col("damage") > 0.5).alias("damage"), (F.col("known") > 0.999).alias("known"))
    return rs.resize_each(damaged, ["r", "g", "b"], there).join(votes, KEYS)


def candidates() -> Column:
    """Pixels that a model may be trained on."""
    return F.col("known") & ~ln.held_out()
