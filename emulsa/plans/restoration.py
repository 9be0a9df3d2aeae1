"""The restoration pipeline: colour, reconstruction, identity guard, grain, optional enhancement, sharpening."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.operators import damage as dm
from emulsa.operators import faces as fc
from emulsa.operators import fill as fl
from emulsa.operators import kernels as kn
from emulsa.plans.stages import written

Stage = Callable[[DataFrame, dm.Settings], DataFrame]


def no_enhancer(pixels: DataFrame) -> DataFrame:
    """Stands where no face enhancer was given: asking for one is an error, not a silent nothing."""
    raise NotImplementedError("no face enhancer is built in; give one, or leave enhance off")


def tone(masked: DataFrame, s: dm.Settings) -> DataFrame:
    return dm.color_restore(masked, s.color)


def fill(toned: DataFrame, s: dm.Settings) -> DataFrame:
    return kn.inpaint(toned.withColumn("hole", dm.reconstructable(s.repair)), "hole", s.reconstruction)


def tiled(factory: Callable[[], fl.Model] | None) -> Stage:
    """A stage that fills by a model over tiles."""

    def run(toned: DataFrame, s: dm.Settings) -> DataFrame:
        made = fl.tiled_fill(toned.withColumn("hole", dm.reconstructable(s.repair)), factory, strength=s.reconstruction)
        made = made.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in "rgb"])
        return toned.join(made, ["image_id", "y", "x"]).select(*[F.col(f"_{c}").alias(c) if c in ("r", "g", "b") else F.col(c) for c in toned.columns])

    return run


def guard(masked: DataFrame, s: dm.Settings) -> DataFrame:
    return kn.identity_guard(masked.withColumn("hole", dm.reconstructable(s.repair)), "hole")


def grain(filled: DataFrame, masked: DataFrame, s: dm.Settings) -> DataFrame:
    return dm.grain_match(filled, masked, repair=s.repair)


def sharpen(pixels: DataFrame, s: dm.Settings) -> DataFrame:
    return dm.unsharp(pixels, s.sharpening)


@dataclass(frozen=True)
class Stages:
    """The exchangeable parts of a run; each takes and gives pixel tables, the guard gives (image_id, deviation, passed).

    ``detect`` adds probability and damage_type to pixels; without it they come with the mask.
    """

    tone: Stage = tone
    fill: Stage = fill
    guard: Stage = guard
    grain: Callable[[DataFrame, DataFrame, dm.Settings], DataFrame] = grain
    enhance: Callable[[DataFrame], DataFrame] = no_enhancer
    sharpen: Stage = sharpen
    detect: Stage | None = None


def restore(masked: DataFrame, s: dm.Settings, stages: Stages = Stages(), faces: DataFrame | None = None) -> DataFrame:
    """Pixels after all stages; with a strict guard, images that fail it keep their toned, unfilled pixels.

    With faces (boxes: image_id, x, y, width, height) and ``lock_faces``, less certain damage on them is cleared first.
    """
    if stages.detect is not None:
        masked = written(stages.detect(masked, s))
    if s.lock_faces and faces is not None:
        masked = fc.lock(masked, faces, s.face_confidence, s.repair).drop("cleared")
    toned = written(stages.tone(masked, s))  # read by the fill and the guard
    filled = stages.fill(toned, s)
    if s.strict_guard:
        passed = stages.guard(masked, s)
        old = toned.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in "rgb"])
        filled = filled.join(passed.select("image_id", "passed"), "image_id").join(old, ["image_id", "y", "x"])
        filled = filled.withColumns({c: F.when(F.col("passed"), F.col(c)).otherwise(F.col(f"_{c}")) for c in "rgb"}).drop("passed", "_r", "_g", "_b")
    filled = written(filled)  # the fill is not repeated for what reads it next
    grained = stages.grain(filled, masked, s) if s.grain else filled
    if s.enhance:
        grained = stages.enhance(grained)
    return stages.sharpen(grained, s)


def audit(masked: DataFrame, s: dm.Settings) -> DataFrame:
    """Six rows for each image: what each stage did."""
    c = dm.coverage(masked, s.repair)
    text = lambda v: F.format_string("%.2f", F.col(v))
    stages = [
        ("Color", s.color > 0, F.lit(f"strength {round(100 * s.color)}%")),
        ("Reconstruct", s.reconstruction > 0, F.concat(F.lit("damage "), text("coverage"), F.lit("%, rebuilt "), text("reconstructed_coverage"), F.lit("%"))),
        ("IdentityGuard", True, F.lit("strict" if s.strict_guard else "advisory")),
        ("Grain", s.grain, F.lit("matched" if s.grain else "off")),
        ("Enhance", s.enhance, F.lit("on" if s.enhance else "off")),
        ("Sharpen", s.sharpening > 0, F.lit(f"amount {round(100 * s.sharpening)}%")),
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("seq"), F.lit(n).alias("stage"), F.lit(bool(a)).alias("applied"), m.alias("message")) for k, (n, a, m) in enumerate(stages)]))
    return c.select("image_id", rows.alias("a")).select("image_id", "a.*")


def report(masked: DataFrame, s: dm.Settings) -> DataFrame:
    """``audit`` with what the run itself found: the guard's verdict, the measured grain, and which tones were corrected."""
    checked = guard(masked, s).select("image_id", "deviation", "passed")
    sigma, tones = dm.grain_sigma(masked, s.repair), dm.color_stats(masked).select("image_id", "avg_l", "p01", "p99", "mean_s")
    rows = audit(masked, s).join(checked, "image_id").join(sigma, "image_id", "left").join(tones, "image_id", "left")
    largest = F.concat(F.lit("largest rebuilt area "), F.format_string("%.2f%%", 100 * F.col("deviation")))
    failed = "strict: kept the toned image" if s.strict_guard else "warning only"
    verdict = F.concat(largest, F.when(F.col("passed"), F.lit(", passed")).otherwise(F.lit(f", {failed}")))
    tone = F.concat(F.col("message"), F.format_string(", luminance %.2f from %.2f to %.2f, saturation %.2f", "avg_l", "p01", "p99", "mean_s"))
    grain = F.concat(F.col("message"), F.format_string(", sigma %.4f", F.coalesce("sigma", F.lit(0.0))))
    said = F.when(F.col("stage") == "IdentityGuard", verdict).when(F.col("applied") & (F.col("stage") == "Grain"), grain).when(F.col("applied") & (F.col("stage") == "Color"), tone).otherwise(F.col("message"))
    done = F.when(F.col("stage") == "IdentityGuard", F.col("passed")).when(F.col("stage") == "Grain", F.col("applied") & (F.coalesce("sigma", F.lit(0.0)) > 0.0005)).otherwise(F.col("applied"))
    return rows.select("image_id", "seq", "stage", done.alias("applied"), said.alias("message"))
