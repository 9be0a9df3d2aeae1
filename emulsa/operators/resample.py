"""Resampling, one axis at a time: each input (area) or output (taps) pixel says what it shares with whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulsa.operators.neighbourhood import AXES


def _area_axis(df: DataFrame, cols: list[str], axis: str, out: int) -> DataFrame:
    other, n = AXES[axis]
    scale = F.col(n) / F.lit(float(out))
    last = F.least(F.lit(out - 1), F.ceil((F.col(axis) + 1) / scale).cast("int") - 1)
    df = df.withColumn("_o", F.explode(F.sequence(F.floor(F.col(axis) / scale).cast("int"), last)))
    share = (F.least(F.col(axis) + 1.0, (F.col("_o") + 1) * scale) - F.greatest(F.col(axis) + 0.0, F.col("_o") * scale)) / scale
    keep = [c for c in ("width", "height") if c != n]
    made = df.groupBy("image_id", other, "_o", *keep).agg(*[F.sum(share * F.col(c)).alias(c) for c in cols])
    return made.withColumnRenamed("_o", axis).withColumn(n, F.lit(out))


def area_resize(df: DataFrame, cols: list[str], width: int, height: int) -> DataFrame:
    return _area_axis(_area_axis(df, cols, "x", width), cols, "y", height)


def _cubic(t: Column) -> list[Column]:
    """Weights of four places by the Keys kernel, a = -0.75."""
    a = -0.75
    inner = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    outer = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    w = [outer(t + 1), inner(t), inner(1 - t)]
    return [*w, F.lit(1.0) - w[0] - w[1] - w[2]]


def _taps_axis(df: DataFrame, cols: list[str], axis: str, out: int, cubic: bool) -> DataFrame:
    other, n = AXES[axis]
    keep = [c for c in ("width", "height") if c != n]
    grid = df.select("image_id", n).distinct().withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(out - 1))))
    f = (F.col("_o") + 0.5) * F.col(n) / F.lit(float(out)) - 0.5
    grid = grid.withColumn("_s", F.floor(f).cast("int")).withColumn("_t", f - F.col("_s"))
    t, s = F.col("_t"), F.col("_s")
    if cubic:
        w = _cubic(t)
        taps = [(s + k - 1, w[k]) for k in range(4)]
    else:
        first = F.when(s < 0, 0).when(s >= F.col(n) - 1, F.col(n) - 1).otherwise(s)
        part = F.when((s < 0) | (s >= F.col(n) - 1), 0.0).otherwise(t)
        taps = [(first, 1 - part), (first + 1, part)]
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.col(n) - 1)
    grid = grid.select("image_id", "_o", F.explode(F.array(*[F.struct(inside(k).cast("int").alias("at"), w.alias("w")) for k, w in taps])).alias("_p")).select("image_id", "_o", F.col("_p.at").alias(axis), F.col("_p.w").alias("_w"))
    made = df.join(grid, ["image_id", axis]).groupBy("image_id", other, "_o", *keep).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols])
    return made.withColumnRenamed("_o", axis).withColumn(n, F.lit(out))


def bilinear(df: DataFrame, cols: list[str], width: int, height: int) -> DataFrame:
    return _taps_axis(_taps_axis(df, cols, "x", width, False), cols, "y", height, False)


def bicubic(df: DataFrame, cols: list[str], width: int, height: int) -> DataFrame:
    """Keys kernel, a = -0.75; not cut to 0..1."""
    return _taps_axis(_taps_axis(df, cols, "x", width, True), cols, "y", height, True)


# --- sizes that differ from image to image ------------------------------------------------------------
def working_size(long_side: int, grow: bool = False) -> tuple[Column, Column]:
    """Width and height at which the longer side is ``long_side``; smaller images stay as they are unless they may grow."""
    scale = F.lit(float(long_side)) / F.greatest("width", "height")
    scale = scale if grow else F.least(F.lit(1.0), scale)
    side = lambda n: F.greatest(F.lit(1), F.bround(F.col(n) * scale).cast("int"))
    return side("width"), side("height")


def _shares(sizes: DataFrame, axis: str, n: str, out: str, grow: str) -> DataFrame:
    """image_id, the output place _o, an input place and its weight: area means where ``area`` holds, else linear or cubic taps."""
    scale, o = F.col(n) / F.col(out).cast("double"), F.col("_o")
    grid = sizes.select("image_id", n, out, "area", F.explode(F.sequence(F.lit(0), F.col(out) - 1)).alias("_o"))
    first = F.floor(o * scale).cast("int")
    last = F.least(F.col(n), F.ceil((o + 1) * scale).cast("int")) - 1
    part = lambda k: (F.least(k + 1.0, (o + 1) * scale) - F.greatest(k + 0.0, o * scale)) / scale
    mean = F.transform(F.sequence(first, F.greatest(first, last)), lambda k: F.struct(k.alias("at"), part(k).alias("w")))
    f = (o + 0.5) * scale - 0.5
    low, t = F.floor(f).cast("int"), f - F.floor(f)
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.col(n) - 1)
    w = _cubic(t) if grow == "cubic" else [F.lit(0.0), 1.0 - t, t, F.lit(0.0)]
    two = F.array(*[F.struct(inside(low + k - 1).alias("at"), w[k].alias("w")) for k in (range(4) if grow == "cubic" else (1, 2))])
    taps = grid.select("image_id", "_o", F.explode(F.when(F.col("area"), mean).otherwise(two)).alias("_p"))
    return taps.select("image_id", "_o", F.col("_p.at").alias(axis), F.col("_p.w").alias("_w"))


def resize_each(df: DataFrame, cols: list[str], sizes: DataFrame, grow: str = "linear") -> DataFrame:
    """Every image at its own new size: sizes has image_id, width, height, to_width, to_height.

    Area means where both axes shrink or stay, else bilinear; with ``grow="cubic"`` bicubic in either case.
    Images that keep their size skip all shuffles.
    Other columns than keys, sizes and ``cols`` go.
    """
    keep = ["image_id", "y", "x", "width", "height"]
    sizes = sizes.select(*[c for c in ("image_id", "width", "height", "to_width", "to_height")])
    same = (F.col("width") == F.col("to_width")) & (F.col("height") == F.col("to_height"))
    plain = df.select(*keep, *cols)
    rest = sizes.where(~same).withColumn("area", F.lit(grow != "cubic") & (F.col("to_width") <= F.col("width")) & (F.col("to_height") <= F.col("height")))
    some = plain.join(rest.select("image_id"), "image_id", "left_semi").select("image_id", "y", "x", *cols)
    across = some.join(_shares(rest, "x", "width", "to_width", grow), ["image_id", "x"])
    across = across.groupBy("image_id", "y", F.col("_o").alias("_x")).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols])
    down = across.join(_shares(rest, "y", "height", "to_height", grow), ["image_id", "y"])
    down = down.groupBy("image_id", F.col("_o").alias("y"), F.col("_x").alias("x")).agg(*[F.sum(F.col("_w") * F.col(c)).alias(c) for c in cols])
    made = down.join(rest.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height")), "image_id").select(*keep, *cols)
    return plain.join(sizes.where(same).select("image_id"), "image_id", "left_semi").unionByName(made)


def tile_starts(length: int, tile: int, overlap: int = 128) -> list[int]:
    if length <= tile:
        return [0]
    starts = list(range(0, length - tile, tile - overlap))
    return [*starts, length - tile]
