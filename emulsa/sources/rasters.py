"""Pixel tables: image_id, y, x, width, height, r, g, b, a with values in [0, 1].

``embedding_raster`` reads complete 64 x 64 images out of a vector table; ``drawn_raster`` is a closed-form
image with zones that each detector rule answers to; ``image_files`` and ``save_images`` are the file scan
and sink.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emulsa.functions.pixels import quantize
from emulsa.sources.file_formats import save_files

#: Import formats: fixed values.
FORMATS = "*.{jpg,jpeg,png,bmp,tiff,tif}"
SIDE, DRAWN_WIDTH, DRAWN_HEIGHT, DRAWN_ID = 64, 48, 40, 1_000_000


def embedding_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector v of an image is row (v % 192) div 3 of channel v % 3; incomplete images are left out."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    v = v.select(F.expr("vec_id div 192").alias("image_id"), F.expr("cast((vec_id % 192) div 3 as int)").alias("y"), (F.col("vec_id") % 3).alias("c"), "embedding")
    one = lambda c: F.max(F.when(F.col("c") == c, F.col("embedding")))
    rows = v.groupBy("image_id", "y").agg(one(0).alias("r"), one(1).alias("g"), one(2).alias("b"), F.sum(F.size("embedding")).alias("cells"))
    whole = rows.groupBy("image_id").agg(F.sum("cells").alias("n")).where(f"n = {3 * SIDE * SIDE}").select("image_id")
    cells = rows.join(whole, "image_id", "left_semi").select("image_id", "y", F.posexplode(F.arrays_zip("r", "g", "b")).alias("x", "p"))
    value = lambda c: F.least(F.greatest(F.col(f"p.{c}").cast("double") + 0.5, F.lit(0.0)), F.lit(1.0))
    return cells.select("image_id", "y", "x", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), *[value(c).alias(c) for c in "rgb"], F.lit(1.0).alias("a"))




def drawn_values() -> dict[str, str]:
    """SQL, good in either engine, for r, g and b at integer x and y."""
    noise = "((x * 37 + y * 59 + x * y * 11) % 32) / 400e0"
    base = f"case when x between 4 and 13 and y between 4 and 13 then 0.97e0 when x = 24 then 0.98e0 when (x * 7 + y * 5) % 53 = 0 and x > 30 then 0.85e0 when x between 30 and 46 and y between 24 and 38 then 0.5e0 else 0.25e0 + x / 160e0 + {noise} end"
    tint = "case when (x * 7 + y * 5) % 53 = 0 and x > 30 then 1e0 when x between 4 and 13 and y between 4 and 13 then 1e0 else {} end"
    return {"r": base, "g": f"({base}) * {tint.format('0.85e0')}", "b": f"({base}) * {tint.format('0.6e0')}"}


def drawn_raster(spark: SparkSession, images: int = 1) -> DataFrame:
    n = DRAWN_WIDTH * DRAWN_HEIGHT
    p = spark.range(n * images).select((F.lit(DRAWN_ID) + F.expr(f"id div {n}")).cast("long").alias("image_id"), F.expr(f"cast((id % {n}) div {DRAWN_WIDTH} as int)").alias("y"), F.expr(f"cast(id % {DRAWN_WIDTH} as int)").alias("x"))
    return p.select("image_id", "y", "x", F.lit(DRAWN_WIDTH).alias("width"), F.lit(DRAWN_HEIGHT).alias("height"), *[F.expr(s).alias(c) for c, s in drawn_values().items()], F.lit(1.0).alias("a"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_raster(spark, sf_dir).unionByName(drawn_raster(spark))


def rasters_sql() -> str:
    """The same pixels for the SQL check."""
    v = drawn_values()
    return f"""
cells as (select vec_id // 192 as image_id, cast((vec_id % 192) // 3 as int) as y, vec_id % 3 as c, unnest(embedding) as v, unnest(range(len(embedding))) as x from embeddings),
whole as (select image_id from cells group by image_id having count(*) = {3 * SIDE * SIDE}),
pixels as (
  select image_id, y, cast(x as int) as x, {SIDE} as width, {SIDE} as height,
    {", ".join(f"max(case when c = {k} then least(greatest(cast(v as double) + 0.5e0, 0), 1) end) as {n}" for k, n in enumerate("rgb"))}, 1e0 as a
  from cells where image_id in (select image_id from whole) group by image_id, y, x
  union all
  select image_id, y, x, {DRAWN_WIDTH}, {DRAWN_HEIGHT}, {", ".join(v.values())}, 1e0
  from (select cast({DRAWN_ID} as bigint) as image_id, cast(p // {DRAWN_WIDTH} as int) as y, cast(p % {DRAWN_WIDTH} as int) as x from range({DRAWN_WIDTH * DRAWN_HEIGHT}) t(p)))
"""


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of image files; Spark's reader gives rows of BGR or grey bytes."""
    raw = spark.read.format("image").option("pathGlobFilter", FORMATS).option("dropInvalid", "true").load(path).select("image.*")
    rows = raw.select(F.xxhash64("origin").alias("image_id"), "origin", "width", "height", "nChannels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    cells = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    at = (F.col("y") * F.col("width") + F.col("x")) * F.col("nChannels")
    byte = lambda k: F.conv(F.hex(F.substring("data", at + F.least(F.lit(k), F.col("nChannels") - 1) + 1, F.lit(1))), 16, 10).cast("double") / 255
    alpha = F.when(F.col("nChannels") == 4, byte(3)).otherwise(F.lit(1.0))
    return cells.select("image_id", "origin", "y", "x", "width", "height", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"), alpha.alias("a"))


def png(width: int, height: int, rgba: bytes) -> bytes:
    """An 8-bit RGBA PNG of row-major bytes."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + rgba[k : k + 4 * width] for k in range(0, 4 * width * height, 4 * width))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_images(pixels: DataFrame, kind: str = "png", quality: int = 95) -> DataFrame:
    """image_id and the bytes of its file, PNG with alpha or JPEG without: one group for each image, which fits one task by the data model.

    A JPEG's quality is cut to 1..100.
    """
    import numpy as np
    import pandas as pd

    from emulsa.sources.jpeg import jpeg

    if kind not in ("png", "jpeg"):
        raise ValueError(f"unsupported output format {kind}")

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        width, height = int(pdf.width.iloc[0]), int(pdf.height.iloc[0])
        values = pdf[["r", "g", "b", "a"]].to_numpy(np.uint8)
        content = png(width, height, values.tobytes()) if kind == "png" else jpeg(values[:, :3].reshape(height, width, 3), quality)
        return pd.DataFrame({"image_id": [key[0]], "content": [content]})

    whole = pixels.select("image_id", "y", "x", "width", "height", *[quantize(c).alias(c) for c in "rgba"])
    return whole.groupBy("image_id").applyInPandas(run, "image_id long, content binary")


def save_images(pixels: DataFrame, path: str, kind: str = "png", quality: int = 95, mode: str = "append") -> None:
    """Writes every image as a file named by its id."""
    files = encode_images(pixels, kind, quality)
    end = ".png" if kind == "png" else ".jpg"
    save_files(files.select(F.concat(F.col("image_id").cast("string"), F.lit(end)).alias("name"), "content"), path, mode)
