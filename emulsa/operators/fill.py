"""Fill of holes by a model over tiles, at a working size of each image's own.

Shrinking, growing back and feathering are joins and windows over all pixels; only the tiles of one image, at
the working size and so of at most ``LONG_SIDE`` (or a tile) a side, are one group, as each sees what those before it filled.
A model is loaded once in a worker.  An image whose model is missing or fails is filled by diffusion instead, and says so.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulsa.functions.pixels import clamp, lerp
from emulsa.operators import kernels as kn
from emulsa.operators import neighbourhood as nb
from emulsa.operators import resample as rs
from emulsa.operators.sessions import onnx, session
from emulsa.plans.stages import written

#: Tile, overlap, longer side of the work, growth and seam of the holes, below which probability pixels outside stay: fixed values.
TILE, OVERLAP, LONG_SIDE, GROWTH, SEAM, LOCKED = 512, 128, 1536, 6, 1.5, 0.15

#: Planes (3, tile, tile) in blue, green, red of 0..1 and a mask (tile, tile) to planes of 0..255.
Model = Callable[[np.ndarray, np.ndarray], np.ndarray]
KEYS = ["image_id", "y", "x"]


@dataclass(frozen=True)
class OnnxFill:
    """Makes a model of a file sent by ``SparkContext.addFile``, whose inputs are the picture and the mask, in this order."""

    file_name: str

    def __call__(self) -> Model:
        run = onnx(self.file_name)
        image, mask = (i.name for i in run.get_inputs()[:2])
        return lambda planes, holes: run.run(None, {image: planes[None].astype(np.float32), mask: holes[None, None].astype(np.float32)})[0][0]


def locked(hole: str = "hole") -> Column:
    """Pixels that a fill must not touch."""
    return F.col("protected") | (~F.col(hole) & (F.col("probability") < LOCKED))


def fill_tiles(work: np.ndarray, mask: np.ndarray, model: Model, tile: int, overlap: int) -> np.ndarray:
    """Fills (3, h, w) planes of blue, green, red in reading order of the tiles; later tiles see earlier fills."""
    work, mask = work.copy(), mask.copy()
    for y in rs.tile_starts(work.shape[1], tile, overlap):
        for x in rs.tile_starts(work.shape[2], tile, overlap):
            at = (slice(y, y + tile), slice(x, x + tile))
            if mask[at].any():
                got = np.clip(np.asarray(model(work[:, *at], mask[at].astype(float)), float) / 255, 0, 1)
                work[:, *at] = np.where(mask[at], got, work[:, *at])
                mask[at] = False
    return work


def tiled_fill(masked: DataFrame, factory: Callable[[], Model] | None, hole: str = "hole", tile: int = TILE, overlap: int = OVERLAP, long_side: int = LONG_SIDE, strength: float = 1.0) -> DataFrame:
    """image_id, y, x, r, g, b and ``note`` (empty, or why diffusion was used)."""
    own = [*KEYS, "width", "height", "r", "g", "b", hole, "probability", "protected"]
    df = masked.select(*own)
    if strength <= 0:
        return df.select(*KEYS, "r", "g", "b", F.lit("").alias("note"))
    if factory is None:
        return kn.inpaint(df, hole, strength).select(*KEYS, "r", "g", "b", F.lit("no model").alias("note"))
    key = uuid.uuid4().hex
    df = nb.dilate(df, hole, "_grown", GROWTH).withColumn("_locked", locked(hole))
    df = written(df.withColumn("_fill", (F.col("_grown") & ~F.col("_locked")).cast("double")).drop("_grown"))
    some = written(df.groupBy("image_id", "width", "height").agg(F.max("_fill").alias("_any")).where("_any > 0"))
    sides = [F.greatest(F.lit(tile), s) for s in rs.working_size(long_side)]
    there = some.select("image_id", "width", "height", sides[0].alias("to_width"), sides[1].alias("to_height"))
    back = there.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height"), F.col("width").alias("to_width"), F.col("height").alias("to_height"))
    work = rs.resize_each(df, ["r", "g", "b", "_fill"], there)

    def run(group: pa.Table) -> pa.Table:
        y, x = group["y"].to_numpy(), group["x"].to_numpy()
        shape = (group["height"][0].as_py(), group["width"][0].as_py())
        planes, mask = np.zeros((3, *shape)), np.zeros(shape, bool)
        for k, c in enumerate("bgr"):
            planes[k, y, x] = group[c].to_numpy()
        mask[y, x] = group["_fill"].to_numpy() > 0.01
        note = ""
        try:
            planes = fill_tiles(planes, mask, session(key, factory), tile, overlap)
        except Exception as error:  # whatever a model raises, the image is filled
            note = f"fallback: {error}"
        out = group.select([*KEYS, "width", "height"])
        for k, c in enumerate("bgr"):
            out = out.append_column(c, pa.array(planes[k, y, x]))
        return out.append_column("note", pa.array([note] * len(y), pa.string()))

    schema = "image_id long, y int, x int, width int, height int, b double, g double, r double, note string"
    made = written(work.groupBy("image_id").applyInArrow(run, schema))
    notes = made.groupBy("image_id").agg(F.max("note").alias("note"))
    full = rs.resize_each(made, ["r", "g", "b"], back, grow="cubic").select(*KEYS, *[F.col(c).alias(f"_{c}") for c in "rgb"])
    # full weight inside the grown holes, a soft seam just outside
    soft = nb.gaussian(df.join(some.select("image_id"), "image_id", "left_semi"), {"_soft": "_fill"}, SEAM)
    alpha = F.when(F.col("_locked"), 0.0).otherwise(F.greatest("_soft", "_fill")) * strength
    both = soft.withColumn("_a", alpha).join(full, KEYS).join(notes, "image_id")
    blend = {c: F.when(F.col("_a") > 0, clamp(lerp(c, clamp(f"_{c}"), F.col("_a")))).otherwise(F.col(c)) for c in "rgb"}
    done = both.where("note = ''").select(*KEYS, *[v.alias(k) for k, v in blend.items()], "note")
    rest = df.join(some.select("image_id"), "image_id", "left_anti").select(*KEYS, "r", "g", "b", F.lit("").alias("note"))
    failed = notes.where("note != ''")
    if failed.isEmpty():
        return done.unionByName(rest)
    plain = kn.inpaint(df.select(*own).join(failed.select("image_id"), "image_id", "left_semi"), hole, strength)
    return done.unionByName(rest).unionByName(plain.join(failed, "image_id").select(*KEYS, "r", "g", "b", "note"))
