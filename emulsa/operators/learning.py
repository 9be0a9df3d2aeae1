"""Features, the small network, evaluation, sampling and fitting."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emulsa.functions.pixels import calibrated, luminance, opponents, saturation
from emulsa.operators import neighbourhood as nb
from emulsa.operators import resample as rs
from emulsa.plans.stages import written

#: Radii of the windows: fixed values.
RADII = (2, 6, 16, 40)
#: What the learned detector calls all damage: a fixed value.
SPECKLE = "MetallicOrFoxingSpeckle"


def features(pixels: DataFrame) -> tuple[DataFrame, list[str]]:
    """34 columns a pixel, in the network's order; and their names."""
    o1, o2 = opponents()
    df = pixels.withColumns({"lum": luminance(), "sat": saturation(1e-6), "o1": o1, "o2": o2, "most": F.greatest("r", "g", "b"), "least": F.least("r", "g", "b")})
    # y before x: the boxes go on along x without another shuffle
    half = lambda axis: F.coalesce((nb.at("lum", axis, 1) - nb.at("lum", axis, -1)) / 2, F.lit(0.0))
    df = df.withColumn("_dy", half("y")).withColumn("_dx", half("x"))
    df = df.withColumns({"grad": F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")), "lum_sq": F.col("lum") * F.col("lum")}).drop("_dx", "_dy")
    names = ["lum", "sat", "o1", "o2", "most", "least"]
    df = nb.box_means(df, {r: {f"m_{c}_{r}": c for c in ("lum", "lum_sq", "sat", "o1", "o2", "grad")} for r in RADII})
    for r in RADII:
        m = lambda c, r=r: F.col(f"m_{c}_{r}")
        made = {f"d_lum_{r}": F.col("lum") - m("lum"), f"std_{r}": F.sqrt(F.greatest(m("lum_sq") - m("lum") * m("lum"), F.lit(0.0))), f"d_sat_{r}": F.col("sat") - m("sat"), f"d_o1_{r}": F.col("o1") - m("o1"), f"d_o2_{r}": F.col("o2") - m("o2"), f"grad_{r}": m("grad")}
        df = df.withColumns(made).drop(*[f"m_{c}_{r}" for c in ("lum_sq", "o1", "o2", "grad")])
        names += list(made)
    names += ["m_sat_6", "m_lum_6", "m_sat_40", "m_lum_40"]
    return df, names


@dataclass
class Network:
    """Layer sizes, standardisation and row-major weights; at most 64 wide."""

    layer_sizes: list[int]
    mean: list[float]
    scale: list[float]
    weights: list[list[float]]
    biases: list[list[float]]
    threshold: float = 0.5
    smooth_radius: int = 1
    notes: dict = field(default_factory=dict)

    def __post_init__(self):
        n = self.layer_sizes
        if len(n) < 2 or n[-1] != 1 or max(n[1:]) > 64 or len(self.mean) != n[0] or len(self.scale) != n[0]:
            raise ValueError("bad layer layout")
        if [len(w) for w in self.weights] != [a * b for a, b in zip(n, n[1:], strict=False)] or [len(b) for b in self.biases] != n[1:]:
            raise ValueError("bad array sizes")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "Network":
        return Network(**json.loads(text))

    def changed(self, **values) -> "Network":
        """A copy with other values; layouts are checked anew."""
        return replace(self, **values)

    def flat(self) -> np.ndarray:
        """All weights, then all biases."""
        return np.concatenate([np.array(p, float) for p in self.weights + self.biases])

    def with_flat(self, flat: np.ndarray) -> "Network":
        w, b = _layers(self.layer_sizes, flat)
        return self.changed(weights=[p.ravel().tolist() for p in w], biases=[p.tolist() for p in b])

    def predict(self, x: np.ndarray) -> np.ndarray:
        h = (x - np.array(self.mean)) / np.array(self.scale)
        for k, (w, b) in enumerate(zip(self.weights, self.biases, strict=True)):
            h = h @ np.array(w).reshape(self.layer_sizes[k], -1) + np.array(b)
            h = np.maximum(h, 0) if k < len(self.weights) - 1 else 1 / (1 + np.exp(-h))
        return h[:, 0]


def predict(df: DataFrame, names: list[str], network: Network, out: str = "raw") -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(network)  # at most a few thousand numbers

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        return pd.Series(shared.value.predict(x.to_numpy(np.float64)))

    return df.withColumn(out, run(F.struct(*names)))


#: Longer side at which the detector works: a fixed value.
WORKING_SIDE = 1280


def learned_raw(pixels: DataFrame, network: Network) -> DataFrame:
    """``raw``: the network's smoothed output at the size of the pixels."""
    df, names = features(pixels)
    own = pixels.columns
    df = predict(df, names, network, "_raw").select(*own, "_raw")
    if network.smooth_radius:
        return nb.box_mean(df, {"raw": "_raw"}, network.smooth_radius).drop("_raw")
    return df.withColumnRenamed("_raw", "raw")


def learned_detector(pixels: DataFrame, network: Network, sensitivity: float = 0.2) -> DataFrame:
    """Adds ``raw`` and probability, calibrated for the sensitivity, at the size of the pixels."""
    return learned_raw(pixels, network).withColumn("probability", calibrated("raw", sensitivity, model=network.threshold))


def detected_raw(pixels: DataFrame, network: Network, long_side: int = WORKING_SIDE) -> DataFrame:
    """image_id, y, x, width, height and raw of images of any size: shrunk to the working size and back again, each by its own size."""
    sizes = pixels.select("image_id", "width", "height").distinct()
    to_width, to_height = rs.working_size(long_side)
    there = sizes.withColumns({"to_width": to_width, "to_height": to_height})
    back = there.select("image_id", F.col("to_width").alias("width"), F.col("to_height").alias("height"), F.col("width").alias("to_width"), F.col("height").alias("to_height"))
    small = rs.resize_each(pixels, ["r", "g", "b"], there)
    return rs.resize_each(learned_raw(small, network), ["raw"], back)


def as_mask(raw: DataFrame, network: Network, sensitivity: float = 0.2) -> DataFrame:
    """Adds the calibrated probability and the type of damage."""
    df = raw.withColumn("probability", calibrated("raw", sensitivity, model=network.threshold))
    return df.withColumn("damage_type", F.when(F.col("probability") > 0.05, SPECKLE).otherwise("None"))


def image_digests(pixels: DataFrame) -> DataFrame:
    """image_id and a digest of its size and colours, from sums that combine before any shuffle."""
    place = F.xxhash64("y", "x", "width", "height", "r", "g", "b")
    sums = pixels.groupBy("image_id").agg(F.bit_xor(place).alias("_a"), F.sum(F.xxhash64(place).cast("decimal(38,0)")).alias("_b"), F.count("*").alias("_n"))
    return sums.select("image_id", F.md5(F.concat_ws(":", "_a", "_b", "_n")).alias("digest"))


class RawCache:
    """Raw outputs kept under a folder by network and image digest, so that another sensitivity computes none of them anew."""

    def __init__(self, folder: str, network: Network, long_side: int = WORKING_SIDE):
        name = hashlib.sha256(f"{network.to_json()}:{long_side}".encode()).hexdigest()
        self.path, self.network, self.long_side = f"{folder.rstrip('/')}/raw-{name[:32]}", network, long_side

    def known(self, spark) -> DataFrame | None:
        try:
            return spark.read.schema("y int, x int, width int, height int, raw double, digest string").parquet(self.path)
        except AnalysisException:  # nothing is kept yet
            return None

    def raw(self, pixels: DataFrame) -> DataFrame:
        """``detected_raw`` of the images; those without an entry are computed and kept first."""
        digests = written(image_digests(pixels))
        have = self.known(pixels.sparkSession)
        new = digests if have is None else digests.join(have.select("digest").distinct(), "digest", "left_anti")
        new = written(new.groupBy("digest").agg(F.min("image_id").alias("image_id")))
        if not new.isEmpty():
            made = detected_raw(pixels.join(new.select("image_id"), "image_id", "left_semi"), self.network, self.long_side)
            made = made.join(new, "image_id").select(*[F.col(c).cast("int").alias(c) for c in ("y", "x", "width", "height")], "raw", "digest")
            made.repartition("digest").write.mode("append").partitionBy("digest").parquet(self.path)
        return digests.join(self.known(pixels.sparkSession), "digest").select("image_id", "y", "x", "width", "height", "raw")


def loss_and_gradient(sizes: list[int], flat: np.ndarray, z: np.ndarray, y: np.ndarray, weight: np.ndarray, gradients: bool = True) -> np.ndarray:
    """Weighted cross entropy of standardised rows, the weights' sum and the gradient by ``flat``, all summed over the rows."""
    w, b = _layers(sizes, flat)
    h, kept = z, [z]
    for k in range(len(w)):
        h = h @ w[k] + b[k]
        h = np.maximum(h, 0) if k < len(w) - 1 else 1 / (1 + np.exp(-h))
        kept.append(h)
    p = np.clip(h[:, 0], 1e-7, 1 - 1e-7)
    loss = -(weight * np.where(y > 0, np.log(p), np.log(1 - p))).sum()
    if not gradients:
        return np.array([loss, weight.sum()])
    gw, gb, delta = [None] * len(w), [None] * len(w), ((h[:, 0] - y) * weight)[:, None]
    for k in range(len(w) - 1, -1, -1):
        gw[k], gb[k] = kept[k].T @ delta, delta.sum(0)
        delta = (delta @ w[k].T) * (kept[k] > 0)
    return np.concatenate([[loss, weight.sum()], *[g.ravel() for g in gw], *gb])


def _layers(sizes: list[int], flat: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    parts = np.split(flat, np.cumsum([a * b for a, b in zip(sizes, sizes[1:], strict=False)] + sizes[1:])[:-1])
    n = len(sizes) - 1
    return [p.reshape(a, -1) for p, a in zip(parts[:n], sizes, strict=False)], parts[n:]


def held_out(y="y", x="x", height="height", width="width") -> Column:
    """A 4 x 4 grid of blocks, one block of each row of blocks."""
    by, bx = F.floor(F.col(y) * 4 / F.col(height)), F.floor(F.col(x) * 4 / F.col(width))
    return bx == (3 * by + 1) % 4


def scores(df: DataFrame, threshold: float = 0.5, keys=("image_id",), everywhere: bool = False) -> DataFrame:
    """IoU, precision, recall and shares of probability against damage on known pixels of the held-out blocks, or everywhere."""
    flag = F.col("probability") > threshold
    d = df.where(F.col("known") if everywhere else held_out() & F.col("known")).groupBy(*keys).agg(F.count_if(flag & F.col("damage")).alias("both"), F.count_if(flag | F.col("damage")).alias("either"), F.count_if(flag).alias("flagged"), F.count_if(F.col("damage")).alias("damaged"), F.count("*").alias("n"))
    share = lambda a, b, empty: F.when(F.col(b) == 0, F.lit(empty)).otherwise(F.col(a) / F.col(b))
    return d.select(*keys, share("both", "either", 1.0).alias("iou"), F.when(F.col("flagged") == 0, 0.0).otherwise(1 - F.col("both") / F.col("flagged")).alias("false_flags"), share("both", "flagged", 0.0).alias("precision"), share("both", "damaged", 0.0).alias("recall"), (F.col("flagged") / F.col("n")).alias("flagged_share"))


def weighted_iou(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    flag, w = F.col("probability") > threshold, F.col("weight")
    either = F.sum(F.when(flag | F.col("label"), w).otherwise(0.0))
    return rows.agg(F.when(either == 0, 1.0).otherwise(F.sum(F.when(flag & F.col("label"), w).otherwise(0.0)) / either).alias("iou"))


def ncc(df: DataFrame, a: str, b: str, keys: list[str], overlap: float = 0.4) -> DataFrame:
    """Normalised cross correlation of valid pixels; -1 where too few overlap."""
    v = F.col("valid")
    s = lambda e: F.sum(F.when(v, e).otherwise(0.0))
    A, B = F.col(a), F.col(b)
    d = df.groupBy(*keys).agg(F.count_if(v).alias("n"), F.count("*").alias("all"), s(A).alias("sa"), s(B).alias("sb"), s(A * A).alias("saa"), s(B * B).alias("sbb"), s(A * B).alias("sab"))
    num = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    den = F.sqrt((F.col("saa") - F.col("sa") * F.col("sa") / F.col("n")) * (F.col("sbb") - F.col("sb") * F.col("sb") / F.col("n")))
    return d.select(*keys, F.when(F.col("n") < overlap * F.col("all"), -1.0).otherwise(num / F.greatest(den, F.lit(1e-12))).alias("ncc"))


TERMS = {"one": "1e0", "r": "r", "g": "g", "b": "b", "rr": "r * r", "gg": "g * g", "bb": "b * b", "rg": "r * g", "rb": "r * b", "gb": "g * b"}


def normal_equations(df: DataFrame, keys: list[str], targets=("tr", "tg", "tb")) -> DataFrame:
    """(i, j, value) of X'X and X'y of the polynomial colour terms, in one pass."""
    t = list(TERMS)
    df = df.withColumns({f"_{k}": F.expr(v) for k, v in TERMS.items()})
    sums = [F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"{a}:{b}") for i, a in enumerate(t) for b in t[i:]] + [F.sum(F.col(f"_{a}") * F.col(b)).alias(f"{a}:{b}") for a in t for b in targets]
    wide = df.groupBy(*keys).agg(*sums)
    named = [c for c in wide.columns if ":" in c]
    pairs = F.explode(F.array(*[F.struct(F.lit(c.split(":")[0]).alias("i"), F.lit(c.split(":")[1]).alias("j"), F.col(f"`{c}`").alias("value")) for c in named]))
    return wide.select(*keys, pairs.alias("p")).select(*keys, "p.i", "p.j", "p.value")


def solve(equations: dict[tuple[str, str], float], target: str, ridge: float = 1e-6) -> np.ndarray:
    t = list(TERMS)
    m = np.array([[equations.get((a, b), equations.get((b, a))) for b in t] for a in t], float)
    return np.linalg.solve(m + ridge * np.eye(len(t)), np.array([equations[a, target] for a in t], float))


def stratified(df: DataFrame, total: int = 60000, positive: float = 0.30, seed: int = 1, keys=("image_id",)) -> DataFrame:
    """Without replacement, at least ``positive`` damaged where there are as many; in order of a digest of seed and place."""
    n = df.groupBy(*keys).agg(F.count_if("damage").alias("_p"), F.count_if(~F.col("damage")).alias("_q"))
    all_of = F.least(F.lit(total), F.col("_p") + F.col("_q"))
    pos = F.least(F.col("_p"), F.floor(all_of * F.greatest(F.lit(positive), F.col("_p") / (F.col("_p") + F.col("_q")))))
    n = n.withColumns({"_pos": pos}).withColumn("_neg", F.least(F.col("_q"), all_of - F.col("_pos")))
    w = Window.partitionBy(*keys, "damage").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "y", "x")), "y", "x")
    return df.withColumn("_k", F.row_number().over(w)).join(n, list(keys)).where(F.col("_k") <= F.when(F.col("damage"), F.col("_pos")).otherwise(F.col("_neg"))).drop("_k", "_p", "_q", "_pos", "_neg")

