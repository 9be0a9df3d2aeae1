"""Binary tables of training: pairs (pixels with flags) and replay rows (half-precision features).

Contents come from ``spark.read.format("binaryFile")`` or any table with (path, content).  A bad file raises, or
with ``skip`` is left out.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.functions.pixels import quantize

#: Little-endian file marks and version: fixed values.
PAIR_MARK, REPLAY_MARK, VERSION = 0x50524950, 0x53524950, 1
FEATURES = 34
PAIR_ROWS = "path string, name string, y int, x int, width int, height int, r double, g double, b double, damage boolean, known boolean"
REPLAY_ROWS = "path string, row_id long, pairs int, features array<float>, label boolean, weight float"


def prefixed(text: str) -> bytes:
    """UTF-8 after its length in groups of seven bits, low ones first."""
    raw, n, head = text.encode(), len(text.encode()), b""
    while n >= 128:
        head, n = head + bytes([n % 128 + 128]), n // 128
    return head + bytes([n]) + raw


def read_prefixed(content: bytes, at: int) -> tuple[str, int]:
    n = shift = 0
    while True:
        byte = content[at]
        n, shift, at = n | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return content[at : at + n].decode(), at + n


def encode_pairs(pixels: DataFrame) -> DataFrame:
    """path, content of each pair of pixels (path, name, y, x, width, height, r, g, b, damage, known); one pair a group."""
    bytes_of = pixels.select("path", "name", "y", "x", "width", "height", *[quantize(c).alias(c) for c in "rgb"], (F.col("damage").cast("int") + 2 * F.col("known").cast("int")).alias("flags"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        head = struct.pack("<ii", PAIR_MARK, VERSION) + prefixed(pdf["name"].iloc[0]) + struct.pack("<ii", int(pdf.width.iloc[0]), int(pdf.height.iloc[0]))
        return pd.DataFrame([(key[0], head + pdf[["r", "g", "b", "flags"]].to_numpy(np.uint8).tobytes())])

    return bytes_of.groupBy("path").applyInPandas(run, "path string, content binary")


def pair_rows(path: str, content: bytes) -> pd.DataFrame:
    if len(content) < 8 or struct.unpack_from("<ii", content) != (PAIR_MARK, VERSION):
        raise ValueError(f"{path} is no training pair")
    try:
        name, at = read_prefixed(content, 8)
        width, height = struct.unpack_from("<ii", content, at)
    except (IndexError, struct.error, UnicodeDecodeError) as error:
        raise ValueError(f"{path} is truncated") from error
    raw = np.frombuffer(content, np.uint8, offset=at + 8)
    if min(width, height) < 0 or len(raw) < 4 * width * height:
        raise ValueError(f"{path} is truncated")
    raw, place = raw[: 4 * width * height].reshape(-1, 4), np.arange(width * height)
    return pd.DataFrame({"path": path, "name": name, "y": place // max(width, 1), "x": place % max(width, 1), "width": width, "height": height} | {c: raw[:, k] / 255 for k, c in enumerate("rgb")} | {"damage": raw[:, 3] & 1 > 0, "known": raw[:, 3] & 2 > 0})


def encode_replay(rows: DataFrame, pairs: int, files: int = 1) -> DataFrame:
    """path, content of replay rows (path, row_id, features, label, weight), in order of a digest of row_id.

    With more than one file a path's rows are dealt among path-0, path-1, ... by that digest; a file is a group.
    """
    place = F.md5(F.col("row_id").cast("string"))
    part = F.pmod(F.conv(F.substring(place, 1, 8), 16, 10).cast("long"), F.lit(files)).cast("string")
    path = F.concat("path", F.lit("-"), part) if files > 1 else F.col("path")
    mixed = rows.select(path.alias("path"), "features", "label", "weight", place.alias("place"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        features = np.stack(pdf.features.to_numpy()).astype("<f2")
        body = features.tobytes() + pdf.label.to_numpy(np.uint8).tobytes() + pdf.weight.to_numpy().astype("<f2").tobytes()
        return pd.DataFrame([(key[0], struct.pack("<iiiii", REPLAY_MARK, VERSION, len(pdf), features.shape[1], pairs) + body)])

    return mixed.groupBy("path").applyInPandas(run, "path string, content binary")


def replay_rows(path: str, content: bytes) -> pd.DataFrame:
    if len(content) < 20 or struct.unpack_from("<ii", content) != (REPLAY_MARK, VERSION):
        raise ValueError(f"{path} is no replay set")
    n, width, pairs = struct.unpack_from("<iii", content, 8)
    if width != FEATURES:
        raise ValueError(f"{path} has another feature layout")
    if n < 0 or len(content) < 20 + n * (2 * width + 3):
        raise ValueError(f"{path} is truncated")
    features = np.frombuffer(content, "<f2", n * width, 20).reshape(n, width).astype(np.float32)
    label = np.frombuffer(content, np.uint8, n, 20 + 2 * n * width)
    weight = np.frombuffer(content, "<f2", n, 20 + n * (2 * width + 1)).astype(np.float32)
    return pd.DataFrame({"path": path, "row_id": np.arange(n), "pairs": pairs, "features": pd.Series(list(features), dtype=object), "label": label != 0, "weight": weight})


def _decoded(files: DataFrame, rows: Callable[[str, bytes], pd.DataFrame], schema: str, skip: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    yield rows(path, bytes(content or b""))
                except ValueError:
                    if not skip:
                        raise

    return files.select("path", "content").mapInPandas(run, schema)


def decode_pairs(files: DataFrame, skip: bool = False) -> DataFrame:
    return _decoded(files, pair_rows, PAIR_ROWS, skip)


def decode_replay(files: DataFrame, skip: bool = False) -> DataFrame:
    return _decoded(files, replay_rows, REPLAY_ROWS, skip)
