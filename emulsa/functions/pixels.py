"""Per-pixel expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(v, lo=0.0, hi=1.0) -> Column:
    return F.least(F.greatest(col(v), F.lit(lo)), F.lit(hi))


def luminance(r="r", g="g", b="b") -> Column:
    """Rec. 709 weights."""
    return F.lit(0.2126) * col(r) + F.lit(0.7152) * col(g) + F.lit(0.0722) * col(b)


def saturation(above: float = 0.0, r="r", g="g", b="b") -> Column:
    """(max - min) / max, 0 where max is not above the given value."""
    most, least = F.greatest(col(r), col(g), col(b)), F.least(col(r), col(g), col(b))
    return F.when(most > above, (most - least) / most).otherwise(F.lit(0.0))


def opponents(r="r", g="g", b="b") -> tuple[Column, Column]:
    return col(r) - col(g), (col(r) + col(g)) / 2 - col(b)


def sigmoid(v) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(v)))


def logit(p) -> Column:
    p = clamp(p, 1e-6, 1 - 1e-6)
    return F.log(p / (F.lit(1.0) - p))


def normalize(v, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lo, hi))
    return F.when(hi <= lo, F.when(col(v) >= hi, 1.0).otherwise(0.0)).otherwise(F.least(F.greatest((col(v) - lo) / (hi - lo), F.lit(0.0)), F.lit(1.0)))


def quantize(v) -> Column:
    """To 0..255, half to even."""
    return clamp(F.bround(clamp(v) * 255), 0.0, 255.0).cast("int")


def safe_divide(a, b) -> Column:
    return F.when(col(b) <= 1e-4, F.lit(1.0)).otherwise(col(a) / col(b))


def lerp(a, b, t) -> Column:
    return col(a) + (col(b) - col(a)) * t


def calibrated(p, sensitivity: float, repair: float = 0.5, model: float = 0.5) -> Column:
    """Moves a model's probability so that its threshold falls on the repair threshold."""
    lg = lambda v: math.log(min(max(v, 1e-6), 1 - 1e-6) / (1 - min(max(v, 1e-6), 1 - 1e-6)))
    return sigmoid(logit(p) + (lg(repair) - lg(model) + 4 * (min(max(sensitivity, 0), 1) - 0.4)))
