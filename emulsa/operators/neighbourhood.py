"""Neighbourhood operators over pixel tables, axis by axis, as windows within rows and columns.

Box sums use running totals, so a window of radius 40 costs no more than one of radius 2.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = {"x": ("y", "width"), "y": ("x", "height")}


def line(axis: str):
    return Window.partitionBy("image_id", AXES[axis][0]).orderBy(axis)


def _box_axis(df: DataFrame, cols: dict[str, str], r: int, axis: str, replicate: bool) -> DataFrame:
    w, n = line(axis), F.col(AXES[axis][1])
    all_of = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumns({f"_{o}_run": F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for o, c in cols.items()})
    total = lambda o: F.last(f"_{o}_run").over(all_of)
    inside = lambda o: F.coalesce(F.lead(f"_{o}_run", r).over(w), total(o)) - F.coalesce(F.lag(f"_{o}_run", r + 1).over(w), F.lit(0.0))
    before, after = F.greatest(F.lit(0), r - F.col(axis)), F.greatest(F.lit(0), F.col(axis) + r - n + 1)
    if replicate:
        made = {o: (inside(o) + before * F.first(c).over(all_of) + after * F.last(c).over(all_of)) / (2 * r + 1) for o, c in cols.items()}
    else:
        made = {o: inside(o) for o in cols}
    return df.withColumns(made).drop(*[f"_{o}_run" for o in cols])


def box_mean(df: DataFrame, cols: dict[str, str], r: int) -> DataFrame:
    """{output: input}; edges are replicated."""
    df = _box_axis(df, {f"_{o}_x": c for o, c in cols.items()}, r, "x", True)
    return _box_axis(df, {o: f"_{o}_x" for o in cols}, r, "y", True).drop(*[f"_{o}_x" for o in cols])


def box_means(df: DataFrame, by_radius: dict[int, dict[str, str]]) -> DataFrame:
    """{radius: {output: input}}; all radii along x first, then all along y, so that two shuffles serve them all."""
    for r, cols in by_radius.items():
        df = _box_axis(df, {f"_{o}_x": c for o, c in cols.items()}, r, "x", True)
    for r, cols in by_radius.items():
        df = _box_axis(df, {o: f"_{o}_x" for o in cols}, r, "y", True)
    return df.drop(*[f"_{o}_x" for cols in by_radius.values() for o in cols])


def local_stats(df: DataFrame, mean: dict[str, str], variance: dict[str, str], r: int) -> DataFrame:
    """Means and variances over windows cut off at the border."""
    return local_stats_of(df, [(mean, variance, r)])


def local_stats_of(df: DataFrame, wanted: list[tuple[dict[str, str], dict[str, str], int]]) -> DataFrame:
    """``local_stats`` for several (mean, variance, radius): all along x first, then all along y."""
    sums = {}
    for mean, variance, r in wanted:
        df = df.withColumns({f"_{o}_v": F.col(c) for o, c in (mean | variance).items()} | {f"_{o}_q": F.col(c) * F.col(c) for o, c in variance.items()})
        sums[r] = [f"_{o}_v" for o in mean | variance] + [f"_{o}_q" for o in variance]
    for r, names in sums.items():
        df = _box_axis(df, {f"{s}x": s for s in names}, r, "x", False)
    for r, names in sums.items():
        df = _box_axis(df, {f"{s}y": f"{s}x" for s in names}, r, "y", False)
    made = {}
    for mean, variance, r in wanted:
        side = lambda p, n, r=r: F.least(F.col(p) + r, F.col(n) - 1) - F.greatest(F.col(p) - r, F.lit(0)) + 1
        n = side("x", "width") * side("y", "height")
        made |= {o: F.col(f"_{o}_vy") / n for o in mean} | {o: F.greatest(F.lit(0.0), F.col(f"_{o}_qy") / n - (F.col(f"_{o}_vy") / n) * (F.col(f"_{o}_vy") / n)) for o in variance}
    return df.withColumns(made).drop(*[s + end for names in sums.values() for s in names for end in ("", "x", "y")])


def at(c: str, axis: str, step: int) -> Column:
    """The value ``step`` pixels on, null outside."""
    return F.lead(c, step).over(line(axis)) if step > 0 else F.lag(c, -step).over(line(axis))


def gradient(c: str, halved: bool = True) -> Column:
    """Length of the +-1 difference.  Halved: each axis 0 at its own border; else 0 on the whole frame."""
    dx, dy = at(c, "x", 1) - at(c, "x", -1), at(c, "y", 1) - at(c, "y", -1)
    if halved:
        dx, dy = F.coalesce(dx / 2, F.lit(0.0)), F.coalesce(dy / 2, F.lit(0.0))
        return F.sqrt(dx * dx + dy * dy)
    return F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def ridge(c: str) -> Column:
    """|4 centre - neighbours|, coordinates clamped, cut to 0..1."""
    near = sum((F.coalesce(at(c, a, s), F.col(c)) for a in "xy" for s in (1, -1)), F.lit(0.0))
    return F.least(F.abs(4 * F.col(c) - near), F.lit(1.0))


def dilate(df: DataFrame, c: str, out: str, r: int) -> DataFrame:
    """Square of side 2r + 1; outside is off."""
    df = df.withColumn("_d", F.max(F.col(c).cast("int")).over(line("x").rowsBetween(-r, r)))
    return df.withColumn(out, F.max("_d").over(line("y").rowsBetween(-r, r)) > 0).drop("_d")


def cross(df: DataFrame, c: str, out: str, grow: bool, times: int = 1) -> DataFrame:
    """Dilation (grow) or erosion by the 4-neighbour cross; outside is off, so erosion eats the border."""
    df = df.withColumn(out, F.col(c))
    for _ in range(times):
        off = F.lit(False)
        near = [F.coalesce(at(out, a, s), off) for a in "xy" for s in (1, -1)]
        value = F.col(out)
        for n in near:
            value = value | n if grow else value & n
        df = df.withColumn(out, value)
    return df


def open_close(df: DataFrame, c: str, out: str) -> DataFrame:
    df = cross(cross(df, c, out, False, 1), out, out, True, 1)
    return cross(cross(df, out, out, True, 2), out, out, False, 2)


def grain_residual(c: str) -> Column:
    """Value less the mean of its four neighbours; null on the frame."""
    return F.col(c) - sum((at(c, a, s) for a in "xy" for s in (1, -1)), F.lit(0.0)) / 4


def gaussian(df: DataFrame, cols: dict[str, str], sigma: float | Column, most: float | None = None) -> DataFrame:
    """Reflected borders (the edge pixel once); radius round(4 sigma) at least 1.

    Sigma may be a column, of one value for an image and at most ``most``.  Each axis is one window: the values up
    to the radius away, of which a tap beyond the border takes the one that it is reflected to.
    """
    r = max(1, round(4 * (sigma if most is None else most)))
    s = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    reach = F.greatest(F.lit(1.0), F.rint(4 * s))
    weight = [F.when(F.lit(abs(k)) <= reach, F.exp(F.lit(-float(k * k)) / (2 * s * s))).otherwise(0.0) for k in range(-r, r + 1)]
    names = [f"_w{k}" for k in range(2 * r + 1)]
    if not isinstance(sigma, Column):
        w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
        weights = [F.lit(v / sum(w)) for v in w]
    else:
        df = df.withColumns(dict(zip(names, weight, strict=True)))
        df = df.withColumn("_w", sum((F.col(n) for n in names), F.lit(0.0)))
        weights = [F.col(n) / F.col("_w") for n in names]
    for axis, (_, n) in AXES.items():
        size = F.col(n)
        period = F.greatest(2 * size - 2, F.lit(1))
        df = df.withColumns({f"_{o}_near": F.array(*[at(c, axis, k) if k else F.col(c) for k in range(-r, r + 1)]) for o, c in cols.items()})

        def tap(o: str, k: int, size=size, period=period, axis=axis) -> Column:
            folded = F.pmod(F.col(axis) + k, period)
            return F.get(f"_{o}_near", r - F.col(axis) + F.when(folded >= size, period - folded).otherwise(folded))

        blurred = {o: sum((w * F.coalesce(tap(o, k), F.lit(0.0)) for k, w in zip(range(-r, r + 1), weights, strict=True)), F.lit(0.0)) for o in cols}
        df = df.withColumns(blurred).drop(*[f"_{o}_near" for o in cols])
        cols = {o: o for o in cols}
    return df.drop("_w", *names)
