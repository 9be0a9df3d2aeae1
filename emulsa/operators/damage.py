"""Damage masks, the rule-based detector, colour restoration, sharpening and grain."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulsa.functions.pixels import clamp, luminance, normalize, safe_divide, saturation
from emulsa.operators import neighbourhood as nb
from emulsa.plans.stages import written

#: Damage classes and those whose content is missing: fixed values.
TYPES = ("None", "WhiteOrBleachedPatch", "YellowingOrColorCast", "StainOrDiscoloration", "CreaseScratchOrTear", "FadedLowContrast", "MetallicOrFoxingSpeckle")
MISSING = ("WhiteOrBleachedPatch", "StainOrDiscoloration", "CreaseScratchOrTear", "MetallicOrFoxingSpeckle")


@dataclass(frozen=True)
class Settings:
    """Knobs of a run and their defaults: fixed values."""

    color: float = 0.75
    reconstruction: float = 1.0
    sensitivity: float = 0.2
    sharpening: float = 0.10
    lock_faces: bool = True
    face_confidence: float = 0.85
    grain: bool = True
    enhance: bool = False
    repair: float = 0.5
    strict_guard: bool = False


def repairable(repair: float = 0.5) -> Column:
    return ~F.col("protected") & (F.col("probability") >= repair)


def reconstructable(repair: float = 0.5) -> Column:
    return repairable(repair) & F.col("damage_type").isin(*MISSING)


def coverage(masks: DataFrame, repair: float = 0.5) -> DataFrame:
    """Percent of pixels to repair and to rebuild, of all pixels, protected ones included."""
    share = lambda c: 100 * F.count_if(c) / F.count("*")
    return masks.groupBy("image_id").agg(share(repairable(repair)).alias("coverage"), share(reconstructable(repair)).alias("reconstructed_coverage"))


def edit(masks: DataFrame, edits: DataFrame) -> DataFrame:
    """Applies edits (image_id, y, x, action, value): set, damaged, intact, protect, unprotect; one a pixel."""
    e = edits.select("image_id", "y", "x", "action", "value")
    m = masks.join(e, ["image_id", "y", "x"], "left")
    p = F.when(F.col("action") == "set", clamp("value")).when(F.col("action") == "damaged", 1.0).when(F.col("action") == "intact", 0.0).otherwise(F.col("probability"))
    locked = F.when(F.col("action") == "protect", True).when(F.col("action") == "unprotect", False).otherwise(F.col("protected"))
    kind = F.when(F.col("action") == "intact", "None").otherwise(F.col("damage_type"))
    return m.withColumns({"probability": p, "protected": locked, "damage_type": kind}).drop("action", "value")


def brush(masks: DataFrame, strokes: DataFrame) -> DataFrame:
    """Adds ``brushed``: whether a stroke (image_id, cx, cy, radius) covers the pixel.

    A stroke lists the pixels of its disk, at most its square, so the join is by pixel.
    """
    offsets = lambda: F.sequence(-F.col("radius"), F.col("radius"))
    disk = strokes.withColumn("dx", F.explode(offsets())).withColumn("dy", F.explode(offsets())).where("dx * dx + dy * dy <= radius * radius")
    disk = disk.select("image_id", (F.col("cy") + F.col("dy")).cast("int").alias("y"), (F.col("cx") + F.col("dx")).cast("int").alias("x")).distinct().withColumn("brushed", F.lit(True))
    return masks.join(disk, ["image_id", "y", "x"], "left").withColumn("brushed", F.coalesce("brushed", F.lit(False)))


#: Bins of a selection's histogram.
BINS = 4096


def percentile_floor(df: DataFrame, column: str, p: float, keys=("image_id",)) -> DataFrame:
    """keys and ``value``: the element at index floor(p (n - 1)) of the ascending values, which are finite.

    Exact and without sorting them: a histogram, combined before its shuffle, shows the bin that holds the element, and
    only the distinct values of this bin are put in order.  df is read three times.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(column).cast("double").alias("_v"))
    bounds = values.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("_v").alias("_n"))
    span = F.col("_hi") - F.col("_lo")
    at = F.when(span > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / span * BINS))).otherwise(0)
    binned = values.join(bounds, keys).withColumn("_bin", at)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    wanted = F.floor(F.lit(p) * (F.col("_n") - 1)) + 1
    running = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_bin"))  # BINS rows at most
    bins = counts.withColumn("_to", running).where((F.col("_to") >= wanted) & (F.col("_to") - F.col("_c") < wanted))
    inside = binned.join(bins.select(*keys, "_bin", (wanted - F.col("_to") + F.col("_c")).alias("_k")), [*keys, "_bin"])
    distinct = inside.groupBy(*keys, "_v").agg(F.count("*").alias("_c"), F.first("_k").alias("_k"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v"))
    found = distinct.withColumn("_to", upto).where((F.col("_to") >= F.col("_k")) & (F.col("_to") - F.col("_c") < F.col("_k")))
    return found.select(*keys, F.col("_v").alias("value"))


def rule_detector(pixels: DataFrame, sensitivity: float = 0.2) -> DataFrame:
    """Adds probability and damage_type by the first rule that fits: patch, line, speckle, faded."""
    s = min(max(sensitivity, 0.0), 1.0)
    floor, low, line_at = 0.90 - 0.15 * s, 0.0015 + 0.0035 * s, 0.35 - 0.20 * s
    faded = 0.6 * low
    df = pixels.withColumns({"lum": luminance(), "sat": saturation()})
    df = df.withColumn("ridge", nb.ridge("lum"))
    df = nb.local_stats_of(df, [({}, {"var3": "lum"}, 3), ({"lum20": "lum", "sat20": "sat"}, {}, 20)])
    zero = F.lit(0.0)
    df = df.withColumn("anomaly", F.greatest(zero, F.col("lum") - F.col("lum20")) * F.greatest(zero, F.col("sat20") - F.col("sat")) * F.sqrt("var3"))
    df = written(df)  # the selection reads it again
    at = percentile_floor(df, "anomaly", 1 - (0.03 + 0.07 * s)).withColumnRenamed("value", "anomaly_at")
    df = df.join(at, "image_id")  # one row for each image
    lum, var, a, t = F.col("lum"), F.col("var3"), F.col("anomaly"), F.col("anomaly_at")
    white, crease, speckle = (lum >= floor) & (var <= low), F.col("ridge") >= line_at, (t > 0) & (a >= t)
    faded_p = 0.6 * normalize(F.lit(faded) - var, 0.0, faded)
    pale = (var <= faded) & (lum > 0.15) & (lum < 0.85) & (faded_p > 0)
    probability = F.when(white, (normalize(lum, floor, 1.0) + normalize(F.lit(low) - var, 0.0, low)) / 2).when(crease, normalize("ridge", line_at, 1.0)).when(speckle, normalize(a, t, 5 * t)).when(pale, faded_p).otherwise(0.0)
    kind = F.when(white, TYPES[1]).when(crease, TYPES[4]).when(speckle, TYPES[6]).when(pale, TYPES[5]).otherwise(TYPES[0])
    return df.withColumns({"probability": probability, "damage_type": kind})


def color_stats(masked: DataFrame) -> DataFrame:
    """One row for each image over its undamaged pixels, or all where those are too few."""
    size = masked.groupBy("image_id").agg((F.count_if(F.col("probability") < 0.5) < F.greatest(F.lit(1000.0), F.count("*") / 100)).alias("use_all"))
    ref = masked.join(size, "image_id").where(F.col("use_all") | (F.col("probability") < 0.5)).withColumns({"lum": luminance(), "sat": saturation(1e-4)})
    stats = ref.groupBy("image_id").agg(F.avg("r").alias("avg_r"), F.avg("g").alias("avg_g"), F.avg("b").alias("avg_b"), F.percentile("lum", 0.01).alias("p01"), F.percentile("lum", 0.99).alias("p99"), F.avg("sat").alias("mean_s"), F.count("*").alias("n"))
    return stats.withColumn("avg_l", luminance("avg_r", "avg_g", "avg_b"))


def color_restore(masked: DataFrame, strength: float = 0.75) -> DataFrame:
    """Cast, contrast, brightness and saturation, each only where the statistics ask for it.

    An average luminance of exactly 1 has no logarithmic target; its gamma is the cap.
    """
    t = min(max(strength, 0.0), 1.0)
    if t == 0:
        return masked
    s = color_stats(masked)
    ratio = {c: safe_divide("avg_l", f"avg_{c}") for c in "rgb"}
    cast = F.greatest(*[F.abs(v - 1) for v in ratio.values()]) > 0.12
    stretch = (F.col("p01") > 0.06) | (F.col("p99") < 0.92)
    lo, hi = F.when(stretch, F.col("p01") * t).otherwise(0.0), F.when(stretch, 1 + (F.col("p99") - 1) * t).otherwise(1.0)
    target = F.when(F.col("avg_l") >= 1, 1.08).otherwise(F.least(F.lit(math.log(0.5)) / F.log("avg_l"), F.lit(1.08)))
    gamma = F.when(F.col("avg_l") > 0.5, 1 + (target - 1) * t).otherwise(1.0)
    boost = F.when(F.col("mean_s") < 0.22, 1 + (clamp(F.lit(0.28) / F.greatest("mean_s", F.lit(0.001)), 1.0, 1.2) - 1) * t).otherwise(1.0)
    plan = s.select("image_id", *[F.when(cast, clamp(1 + (v - 1) * (t / 2), 0.7, 1.4)).otherwise(1.0).alias(f"gain_{c}") for c, v in ratio.items()], lo.alias("lo"), F.when(stretch, F.greatest(hi - lo, F.lit(0.05))).otherwise(1.0).alias("span"), gamma.alias("gamma"), boost.alias("boost"))
    df = masked.join(plan, "image_id").withColumns({c: F.pow(clamp((F.col(c) * F.col(f"gain_{c}") - F.col("lo")) / F.col("span")), F.col("gamma")) for c in "rgb"})
    df = df.withColumn("_l", luminance())
    return df.withColumns({c: clamp(F.col("_l") + (F.col(c) - F.col("_l")) * F.col("boost")) for c in "rgb"}).drop("_l", "lo", "span", "gamma", "boost", *[f"gain_{c}" for c in "rgb"])


def unsharp(masked: DataFrame, amount: float) -> DataFrame:
    """The same bounded luminance detail is added to each channel of unprotected pixels; the radius follows each image's size."""
    if amount <= 0:
        return masked
    sigma = clamp(F.greatest("width", "height") / 2500, 0.7, 2.5)
    df = nb.gaussian(masked.withColumn("_l", luminance()), {"_soft": "_l"}, sigma, 2.5)
    detail = F.col("_l") - F.col("_soft")
    delta = F.when(F.col("protected") | (F.abs(detail) < 1 / 255), 0.0).otherwise(clamp(detail * amount, -0.4 * amount, 0.4 * amount))
    return df.withColumn("_d", delta).withColumns({c: clamp(F.col(c) + F.col("_d")) for c in "rgb"}).drop("_l", "_soft", "_d")


def grain_sigma(masked: DataFrame, repair: float = 0.5) -> DataFrame:
    """Root mean square of the grain residual of luminance inside the frame, off rebuilt pixels."""
    df = masked.withColumn("lum", luminance()).withColumn("res", nb.grain_residual("lum")).where(~reconstructable(repair))
    return df.groupBy("image_id").agg(F.coalesce(F.sqrt(F.avg(F.col("res") * F.col("res"))), F.lit(0.0)).alias("sigma"))


def grain_match(masked: DataFrame, source: DataFrame, seed: int = 1, repair: float = 0.5) -> DataFrame:
    """Gaussian noise of the source's grain on rebuilt pixels, from hashes of the pixel's place."""
    df = masked.join(grain_sigma(source, repair), "image_id")

    def noise(c: str) -> Column:
        u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), "image_id", "y", "x", F.lit(c), F.lit(k)), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
        return F.sqrt(-2 * F.log(u(0))) * F.cos(2 * math.pi * u(1)) * F.col("sigma")

    on = reconstructable(repair) & (F.col("sigma") > 0.0005)
    return df.withColumns({c: F.when(on, clamp(F.col(c) + noise(c))).otherwise(F.col(c)) for c in "rgb"}).drop("sigma")


def heat_map(masks: DataFrame) -> DataFrame:
    """Display colours: red with alpha by probability, blue where protected."""
    p = F.bround(F.col("probability") * 200).cast("int")
    return masks.select("image_id", "y", "x", F.when(F.col("protected"), 0).when(F.col("probability") > 0, 255).otherwise(0).alias("red"), F.when(F.col("protected"), 255).otherwise(0).alias("blue"), F.when(F.col("protected"), 120).otherwise(p).alias("alpha"))
