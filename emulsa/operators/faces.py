"""Face boxes: decoding, suppression and locking."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emulsa.operators import resample as rs
from emulsa.operators.sessions import onnx, session

MARGIN = 0.15


def decode(cells: DataFrame, tile: int = 640, above: float = 0.6) -> DataFrame:
    """Boxes of detector cells (image_id, stride, idx, cls, obj, bbox) whose score passes."""
    score = F.sqrt(F.least(F.greatest("cls", F.lit(0.0)), F.lit(1.0)) * F.least(F.greatest("obj", F.lit(0.0)), F.lit(1.0)))
    n = (F.lit(tile) / F.col("stride")).cast("int")
    b = lambda k: F.get("bbox", F.lit(k))
    cx, cy = (F.col("idx") % n + b(0)) * F.col("stride"), (F.floor(F.col("idx") / n) + b(1)) * F.col("stride")
    w, h = F.exp(b(2)) * F.col("stride"), F.exp(b(3)) * F.col("stride")
    return cells.withColumn("score", score).where(F.col("score") > above).select("image_id", (cx - w / 2).alias("x"), (cy - h / 2).alias("y"), w.alias("width"), h.alias("height"), "score")


# --- detection over tiles -----------------------------------------------------------------------------
#: Tile, its overlap, the longer sides at which an image is searched, and strides of the outputs: fixed values.
TILE, OVERLAP, SIDES, STRIDES = 640, 128, (640, 1280), (8, 16, 32)
CELLS = "image_id long, tx int, ty int, scale double, stride int, idx int, cls double, obj double, bbox array<double>"

#: Planes (3, tile, tile) in blue, green, red of 0..255 to the named outputs (cls_8, obj_8, bbox_8, ... bbox_32).
RunTile = Callable[[np.ndarray], dict[str, np.ndarray]]


@dataclass(frozen=True)
class OnnxTile:
    """Makes a session of a model file that ``SparkContext.addFile`` has sent to every worker."""

    file_name: str

    def __call__(self) -> RunTile:
        run = onnx(self.file_name)
        name, outputs = run.get_inputs()[0].name, [o.name for o in run.get_outputs()]
        return lambda planes: {k: v.ravel() for k, v in zip(outputs, run.run(None, {name: planes[None].astype(np.float32)}), strict=True)}


def _tiles(n: str, size: str, tile: int, overlap: int) -> Column:
    """Tiles of one axis: start, and first and last input place that its bilinear taps reach."""
    last = F.greatest(F.col(size) - tile, F.lit(0))
    starts = F.array_distinct(F.array_append(F.sequence(F.lit(0), last, F.lit(tile - overlap)), last))
    place = lambda o: (o + 0.5) * F.col(n) / F.col(size) - 0.5
    inside = lambda k: F.least(F.greatest(k, F.lit(0)), F.col(n) - 1).cast("int")
    return F.transform(starts, lambda t: F.struct(t.alias("start"), inside(F.floor(place(t))).alias("first"), inside(F.floor(place(F.least(t + tile, F.col(size)) - 1)) + 1).alias("last")))


def _reaches(axis: str) -> Callable[[Column], Column]:
    return lambda t: (F.col(axis) >= t["first"]) & (F.col(axis) <= t["last"])


def _axis_weights(start: int, n: int, size: int, first: int, count: int, tile: int) -> np.ndarray:
    """(tile, count): linear taps of the tile's places within input places first .. first + count."""
    out = np.zeros((tile, count))
    o = np.arange(min(tile, size - start))
    f = (o + start + 0.5) * n / size - 0.5
    low = np.floor(f).astype(int)
    for at, w in ((low, 1 - (f - low)), (low + 1, f - low)):
        np.add.at(out, (o, np.clip(at, 0, n - 1) - first), w)
    return out


def tile_cells(pixels: DataFrame, factory: Callable[[], RunTile], sides: tuple[int, ...] = SIDES, tile: int = TILE, overlap: int = OVERLAP, above: float = 0.6) -> DataFrame:
    """The model's cells whose score passes, of every tile of every image at every size.

    An image larger than a size is shrunk by Spark first; a smaller one grows inside the tile's task, so that a tile
    gathers at most its own number of pixels.  A tile is a group; the model is loaded once in a worker.
    """
    key = uuid.uuid4().hex
    found = []
    plain = pixels.select("image_id", "y", "x", "width", "height", "r", "g", "b")
    sizes = plain.select("image_id", "width", "height").distinct()
    for side in sides:
        to_width, to_height = rs.working_size(side)
        df = rs.resize_each(plain, ["r", "g", "b"], sizes.withColumns({"to_width": to_width, "to_height": to_height}))
        full = sizes.select("image_id", (F.lit(float(side)) / F.greatest("width", "height")).alias("scale"))
        to_width, to_height = rs.working_size(side, grow=True)
        df = df.withColumns({"_w": to_width, "_h": to_height}).join(full, "image_id").withColumn("side", F.lit(side))
        for axis, n, size in (("x", "width", "_w"), ("y", "height", "_h")):
            df = df.withColumn(f"t{axis}", F.explode(F.filter(_tiles(n, size, tile, overlap), _reaches(axis))))
        found.append(df)
    df = reduce(DataFrame.unionByName, found)
    names = {f"{a}_{b}": f"t{a}.{b}" for a in "xy" for b in ("start", "first", "last")}
    df = df.select("image_id", "side", "scale", "width", "height", "_w", "_h", "y", "x", "r", "g", "b", *[F.col(v).alias(k) for k, v in names.items()])

    def run(group: pa.Table) -> pa.Table:
        one = {c: group[c][0].as_py() for c in ("image_id", "scale", "width", "height", "_w", "_h", *names)}
        ny, nx = one["y_last"] - one["y_first"] + 1, one["x_last"] - one["x_first"] + 1
        at = (group["y"].to_numpy() - one["y_first"]) * nx + group["x"].to_numpy() - one["x_first"]
        down = _axis_weights(one["y_start"], one["height"], one["_h"], one["y_first"], ny, tile)
        across = _axis_weights(one["x_start"], one["width"], one["_w"], one["x_first"], nx, tile)
        planes = np.zeros((3, tile, tile), np.float32)
        for k, c in enumerate("bgr"):
            plane = np.zeros(ny * nx)
            plane[at] = group[c].to_numpy() * 255
            planes[k] = down @ plane.reshape(ny, nx) @ across.T
        out = session(key, factory)(planes)
        rows: dict[str, list] = {c.split(" ")[0]: [] for c in CELLS.split(", ")}
        for stride in STRIDES:
            cls, obj = (np.asarray(out[f"{c}_{stride}"], float).ravel() for c in ("cls", "obj"))
            bbox = np.asarray(out[f"bbox_{stride}"], float).reshape(-1, 4)
            for i in np.flatnonzero(np.sqrt(np.clip(cls, 0, 1) * np.clip(obj, 0, 1)) > above):
                for c, v in zip(rows, (one["image_id"], one["x_start"], one["y_start"], one["scale"], stride, int(i), cls[i], obj[i], bbox[i].tolist()), strict=True):
                    rows[c].append(v)
        return pa.table(rows, schema=CELL_TYPES)

    return df.groupBy("image_id", "side", "y_start", "x_start").applyInArrow(run, CELLS)


CELL_TYPES = pa.schema([("image_id", pa.int64()), ("tx", pa.int32()), ("ty", pa.int32()), ("scale", pa.float64()), ("stride", pa.int32()), ("idx", pa.int32()), ("cls", pa.float64()), ("obj", pa.float64()), ("bbox", pa.list_(pa.float64()))])


def detect(pixels: DataFrame, factory: Callable[[], RunTile], sides: tuple[int, ...] = SIDES, tile: int = TILE, overlap: int = OVERLAP, above: float = 0.6, most: float = 0.3) -> DataFrame:
    """image_id, x, y, width, height, score of the faces: boxes of all tiles and sizes in the image's pixels, suppressed together."""
    cells = tile_cells(pixels, factory, sides, tile, overlap, above)
    place = F.struct("image_id", "tx", "ty", "scale")
    boxes = decode(cells.select(place.alias("image_id"), "stride", "idx", "cls", "obj", "bbox"), tile, above)
    own = lambda c: F.col(f"image_id.{c}")
    scale = own("scale")
    return suppress(boxes.select(own("image_id").alias("image_id"), ((F.col("x") + own("tx")) / scale).alias("x"), ((F.col("y") + own("ty")) / scale).alias("y"), (F.col("width") / scale).alias("width"), (F.col("height") / scale).alias("height"), "score"), most)


def suppress(boxes: DataFrame, most: float = 0.3) -> DataFrame:
    """Greedy by descending score: a box stays if it overlaps no kept one by more than ``most``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "x", "y"], ascending=[False, True, True]).reset_index(drop=True)
        x0, y0 = pdf.x.to_numpy(), pdf.y.to_numpy()
        x1, y1 = x0 + pdf.width.to_numpy(), y0 + pdf.height.to_numpy()
        area, alive, kept = (x1 - x0) * (y1 - y0), np.ones(len(pdf), bool), []
        for i in range(len(pdf)):
            if alive[i]:
                kept.append(i)
                both = np.clip(np.minimum(x1, x1[i]) - np.maximum(x0, x0[i]), 0, None) * np.clip(np.minimum(y1, y1[i]) - np.maximum(y0, y0[i]), 0, None)
                alive &= both / np.maximum(area + area[i] - both, 1e-12) <= most
        return pdf.iloc[kept]

    return boxes.groupBy("image_id").applyInPandas(run, boxes.schema)


def locked_pixels(faces: DataFrame, sizes: DataFrame) -> DataFrame:
    """Distinct pixels inside a face box grown by the margin; sizes: image_id, width, height."""
    f = faces.select("image_id", *[F.col(c).alias(f"f_{c}") for c in ("x", "y", "width", "height")]).join(sizes, "image_id")
    span = lambda c, n, size: F.sequence(F.greatest(F.lit(0), F.floor(F.col(f"f_{c}") - MARGIN * F.col(f"f_{n}"))).cast("int"), F.least(F.col(size) - 1, F.ceil(F.col(f"f_{c}") + (1 + MARGIN) * F.col(f"f_{n}"))).cast("int"))
    inside = (F.col("f_x") - MARGIN * F.col("f_width") < F.col("width")) & (F.col("f_y") - MARGIN * F.col("f_height") < F.col("height"))
    return f.where(inside).select("image_id", F.explode(span("y", "height", "height")).alias("y"), span("x", "width", "width").alias("xs")).select("image_id", "y", F.explode("xs").alias("x")).distinct()


def lock(masks: DataFrame, faces: DataFrame, confidence: float = 0.85, repair: float = 0.5) -> DataFrame:
    """Clears less certain damage on faces; ``unlocked`` marks pixels that were to be repaired before."""
    sizes = masks.select("image_id", "width", "height").distinct()
    m = masks.join(locked_pixels(faces, sizes).withColumn("_f", F.lit(True)), ["image_id", "y", "x"], "left")
    hit = F.coalesce("_f", F.lit(False)) & (F.col("probability") > 0) & (F.col("probability") < confidence)
    return m.withColumns({"cleared": hit & (F.col("probability") >= repair), "damage_type": F.when(hit, "None").otherwise(F.col("damage_type")), "probability": F.when(hit, 0.0).otherwise(F.col("probability"))}).drop("_f")
