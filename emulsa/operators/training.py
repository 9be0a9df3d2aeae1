"""Gated training of the damage network as a Spark job.

Rows are (key, features, label, weight, fold).  ``staged`` writes them once, one folder a mini-batch, into the shared
folder; a row's batch, and whether it only checks, follow from a hash of its key.  A step reads one
batch: every task sums loss and gradients over its rows, sums of tasks are added in ``FAN`` groups by Spark,
and the driver sees ``FAN`` vectors of a few thousand numbers for each model and takes Adam's step.  So the
table never leaves the executors, and a lost task repeats its own rows only.

Several models train in one pass: model k leaves out the rows of fold k.  With one fold for each photo that is
leave-one-photo-out.  Order within an epoch is drawn anew; which rows make a batch is fixed.
A step is a job, so a batch grows where an epoch would have more than ``steps`` of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulsa.operators import alignment as al
from emulsa.operators import learning as ln
from emulsa.operators import library as lb
from emulsa.operators import neighbourhood as nb
from emulsa.plans.stages import shared_folder, written

ROWS = "key long, features array<double>, label boolean, weight double, fold int"
FAN = 16
#: Samples a pair, their least share of damage, every which replayed row checks.
PER_PAIR, POSITIVE, REPLAY_CHECK = 60_000, 0.30, 5


@dataclass(frozen=True)
class Options:
    """Of training: the first six are fixed values."""

    epochs: int = 12
    batch: int = 256
    rate: float = 5e-4
    decay: float = 1e-4
    patience: int = 3
    seed: int = 0
    steps: int = 32


# --- rows ---------------------------------------------------------------------------------------------
def samples(pixels: DataFrame, names: list[str], per_pair: int = PER_PAIR, positive: float = POSITIVE, seed: int = 1) -> DataFrame:
    """Training rows of pairs with features: at most ``per_pair`` known pixels outside the held-out blocks."""
    drawn = ln.stratified(pixels.where(al.candidates()), per_pair, positive, seed)
    fold = F.col("fold") if "fold" in pixels.columns else F.lit(None).cast("int")
    return drawn.select(F.xxhash64(F.lit("pair"), "image_id", "y", "x").alias("key"), F.array(*[F.col(n).cast("double") for n in names]).alias("features"), F.col("damage").alias("label"), F.lit(1.0).alias("weight"), fold.alias("fold"))


def replayed(replay: DataFrame, check: bool) -> DataFrame:
    """Rows (row_id, features, label, weight) of the replay set: every fifth checks, the others train."""
    mine = (F.col("row_id") % REPLAY_CHECK == 0) == F.lit(check)
    return replay.where(mine).select(F.xxhash64(F.lit("replay"), "row_id").alias("key"), F.col("features").cast("array<double>").alias("features"), "label", F.col("weight").cast("double").alias("weight"), F.lit(None).cast("int").alias("fold"))


@dataclass(frozen=True)
class Staged:
    """Where the batches lie, in ``files`` files each; ``batches`` of them besides the checking rows (batch -1)."""

    folder: str
    batches: int
    rows: int
    files: int

    def read(self, spark, batch: int) -> DataFrame:
        return spark.read.schema(ROWS).parquet(f"{self.folder}/batch={batch}")


def staged(rows: DataFrame, options: Options) -> Staged:
    """Writes the rows by batch; raises where there are none."""
    spark = rows.sparkSession
    rows = written(rows.select(*[f.split()[0] for f in ROWS.split(", ")]))
    n = rows.count()
    if not n:
        raise ValueError("no rows to train on")
    batches = max(1, min(options.steps, -(-n // options.batch)))
    draw = lambda what, most: F.pmod(F.xxhash64(F.lit(what), F.lit(options.seed), "key"), F.lit(most))
    # at least one row checks, and at least one trains: the first and the last hash see to that in small tables
    bounds = rows.agg(F.min(F.xxhash64(F.lit("check"), F.lit(options.seed), "key")), F.max(F.xxhash64(F.lit("check"), F.lit(options.seed), "key"))).first()
    mark = F.xxhash64(F.lit("check"), F.lit(options.seed), "key")
    checks = ((F.pmod(mark, F.lit(10)) == 0) | (mark == bounds[0])) & ((mark != bounds[1]) | F.lit(n == 1))
    folder = f"{shared_folder(spark)}/training-{uuid.uuid4().hex}"
    placed = rows.withColumn("batch", F.when(checks, -1).otherwise(draw("batch", batches)).cast("int"))
    # a batch larger than a task's share lies in several files
    share = max(1, -(-n // batches // 50_000))
    placed.repartition(F.col("batch"), draw("share", share)).write.partitionBy("batch").parquet(folder)
    return Staged(folder, batches, n, share)


# --- steps --------------------------------------------------------------------------------------------
def partial_sums(rows: DataFrame, models: list[tuple[int, ln.Network]], gradients: bool, few: bool = False) -> list[np.ndarray]:
    """For each (fold, network): loss, weight and, if wanted, the gradient, summed over the rows outside its fold.

    With ``few`` tasks, ``FAN`` at most, their sums come to the driver as they are.
    """
    shared = [(fold, net.layer_sizes, np.array(net.mean), np.array(net.scale), net.flat()) for fold, net in models]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            w, fold = batch.column("weight").to_numpy(), batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
            sums = []
            for own, sizes, mean, scale, flat in shared:
                use = fold != own if own >= 0 else slice(None)
                sums.append(ln.loss_and_gradient(sizes, flat, (x[use] - mean) / scale, y[use], w[use], gradients))
            total = sums if total is None else [a + b for a, b in zip(total, sums, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()] * len(total), pa.int32()), "model": pa.array(range(len(total)), pa.int32()), "sums": pa.array([t.tobytes() for t in total], pa.binary())})

    def add(parts: pa.Table) -> pa.Table:
        parts = parts.sort_by("part")  # the order of adding decides the last bits
        total = sum(np.frombuffer(s, float) for s in parts["sums"].to_pylist())
        return pa.table({"part": pa.array([parts["part"][0].as_py() % FAN], pa.int32()), "model": parts["model"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, model int, sums binary"
    parts = rows.mapInArrow(run, schema)
    parts = parts if few else parts.groupBy("model", F.pmod("part", F.lit(FAN))).applyInArrow(add, schema)
    found = sorted(parts.collect())  # FAN rows a model at most
    empty = np.zeros(2 + (len(shared[0][4]) if gradients else 0))
    return [sum((np.frombuffer(r.sums, float) for r in found if r.model == k), empty) for k in range(len(models))]


class Adam:
    """One model's state; decay holds for weights alone."""

    def __init__(self, net: ln.Network, options: Options):
        self.net, self.flat, self.options = net, net.flat(), options
        self.first, self.second, self.steps = np.zeros_like(self.flat), np.zeros_like(self.flat), 0
        self.decayed = options.decay * (np.arange(len(self.flat)) < sum(map(len, net.weights)))
        self.best, self.kept, self.stale, self.losses = np.inf, self.flat, 0, []

    def step(self, sums: np.ndarray) -> None:
        g = sums[2:] / max(sums[1], 1e-9) + self.decayed * self.flat
        self.steps += 1
        self.first = 0.9 * self.first + 0.1 * g
        self.second = 0.999 * self.second + 0.001 * g * g
        rate = self.options.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        self.flat = self.flat - rate * self.first / (np.sqrt(self.second) + 1e-8)

    def check(self, sums: np.ndarray) -> None:
        loss = sums[0] / max(sums[1], 1e-9)
        if not self.losses or loss < self.best - 1e-5:
            self.best, self.kept, self.stale = loss, self.flat, 0
        else:
            self.stale += 1
        self.losses.append(float(loss))

    @property
    def done(self) -> bool:
        return self.stale >= self.options.patience

    def current(self) -> ln.Network:
        return self.net.with_flat(self.flat)


def epoch_order(options: Options, epoch: int, batches: int) -> list[int]:
    return np.random.default_rng([options.seed, epoch]).permutation(batches).tolist()


def train(rows: DataFrame, start: ln.Network, options: Options = Options(), folds: list[int] | None = None) -> list[tuple[ln.Network, list[float]]]:
    """The networks with the least loss on checking rows, and the losses from the start on.

    Without ``folds`` one network, which learns from all rows; else one for each, without the fold's rows.
    """
    spark, at = rows.sparkSession, staged(rows, options)
    runs = [Adam(start, options) for _ in (folds or [-1])]
    own = folds or [-1]

    def each(batch: int, gradients: bool) -> None:
        open_ = [(k, r) for k, r in zip(own, runs, strict=True) if not r.done]
        sums = partial_sums(frames[batch], [(k, r.current()) for k, r in open_], gradients, at.files <= FAN)
        for (_, r), s in zip(open_, sums, strict=True):
            (r.step if gradients else r.check)(s)

    have = {int(r.batch) for r in spark.read.parquet(at.folder).select("batch").distinct().collect()}  # at most ``steps`` + 1 rows
    frames = {b: at.read(spark, b) for b in have}  # files are listed once
    each(-1, False)
    for epoch in range(options.epochs):
        for batch in epoch_order(options, epoch, at.batches):
            if batch in have:
                each(batch, True)
        each(-1, False)
        if all(r.done for r in runs):
            break
    return [(r.net.with_flat(r.kept), r.losses) for r in runs]


def fresh_network(rows: DataFrame, sizes: tuple[int, ...] = (34, 32, 16, 1), seed: int = 0, threshold: float = 0.5, smooth_radius: int = 1) -> ln.Network:
    """A network to start from: the rows' means and deviations, and drawn weights."""
    each = [F.get("features", F.lit(i)) for i in range(sizes[0])]
    stats = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(each)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(each)]).first()
    rng = np.random.default_rng(seed)
    weights = [(rng.normal(size=a * b) * np.sqrt(2 / a)).tolist() for a, b in zip(sizes, sizes[1:], strict=False)]
    at = lambda c, i, none: float(stats[f"{c}{i}"] or none)
    return ln.Network(list(sizes), [at("m", i, 0.0) for i in range(sizes[0])], [max(at("s", i, 1.0), 1e-6) for i in range(sizes[0])], weights, [[0.0] * n for n in sizes[1:]], threshold, smooth_radius)


# --- scores and gate ----------------------------------------------------------------------------------
def predictions(df: DataFrame, features: str, networks: dict[str, ln.Network]) -> DataFrame:
    """Adds a column of raw outputs for each network; features cross to Python once for all."""

    @F.pandas_udf(", ".join(f"{k} double" for k in networks))
    def run(x: pd.Series) -> pd.DataFrame:
        m = np.stack(x.to_numpy()).astype(float) if len(x) else np.empty((0, 1))
        return pd.DataFrame({k: n.predict(m) if len(m) else np.empty(0) for k, n in networks.items()})

    return df.withColumn("_p", run(features)).select(*df.columns, *[F.col(f"_p.{k}").alias(k) for k in networks])


def pair_scores(pixels: DataFrame, names: list[str], networks: dict[str, ln.Network]) -> dict[str, DataFrame]:
    """For each network the scores of every pair on its held-out blocks."""
    keep = ["image_id", "y", "x", "width", "height", "damage", "known"]
    df = pixels.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias("features"))
    df = predictions(df, "features", {f"_{k}": n for k, n in networks.items()}).drop("features")
    for r in sorted({n.smooth_radius for n in networks.values()}):
        mine = {k: f"_{k}" for k, n in networks.items() if n.smooth_radius == r}
        df = nb.box_mean(df, mine, r) if r else df.withColumns({k: F.col(c) for k, c in mine.items()})
    df = written(df.select(*keep, *networks))
    return {k: ln.scores(df.withColumn("probability", F.col(k)), n.threshold) for k, n in networks.items()}


def replay_scores(replay: DataFrame, networks: dict[str, ln.Network]) -> dict[str, DataFrame]:
    df = predictions(replayed(replay, True), "features", networks)
    return {k: ln.weighted_iou(df.withColumn("probability", F.col(k)), n.threshold) for k, n in networks.items()}


@dataclass(frozen=True)
class Report:
    """``gate``: one row; ``pairs``: both models' scores for each pair; ``model``: the one to use from now on."""

    gate: DataFrame
    pairs: DataFrame
    candidate: ln.Network
    model: ln.Network
    losses: list[float]


def train_gated(pixels: DataFrame, names: list[str], replay: DataFrame, current: ln.Network | None = None, options: Options = Options(), per_pair: int = PER_PAIR) -> Report:
    """Trains a candidate on the pairs' samples and the replayed rows; the gate decides whether it replaces ``current``.

    ``pixels`` has the pairs' keys, sizes, damage, known and features.  Without a current network one is drawn.
    """
    rows = written(samples(pixels, names, per_pair).unionByName(replayed(replay, False)))
    current = current or fresh_network(rows, (len(names), 32, 16, 1), options.seed)
    [(candidate, losses)] = train(rows, current, options)
    both = {"current": current, "candidate": candidate}
    scores, again = pair_scores(pixels, names, both), replay_scores(replay, both)
    gate = written(lb.gate(scores["current"], scores["candidate"], again["current"], again["candidate"]))
    each = scores["current"].select("image_id", F.col("iou").alias("current_iou"), F.col("false_flags").alias("current_false_flags"))
    each = each.join(scores["candidate"].select("image_id", F.col("iou").alias("candidate_iou"), F.col("false_flags").alias("candidate_false_flags")), "image_id")
    found = gate.first()
    noted = candidate.changed(notes={"pairs": current.notes.get("pairs", 0) + found.pairs, "validation_iou": found.candidate_iou})
    return Report(gate.withColumn("summary", summary()), each, noted, noted if found.accepted else current, losses)


def summary():
    share = lambda c: F.concat(F.format_number(100 * F.col(c), 1), F.lit(" %"))
    kept = F.concat(F.lit("accepted: held-out overlap "), share("current_iou"), F.lit(" to "), share("candidate_iou"), F.lit(" on "), F.col("pairs"), F.lit(" pairs"))
    worse = F.concat(F.lit("rejected: held-out overlap "), share("candidate_iou"), F.lit(", the current model has "), share("current_iou"))
    forgets = F.concat(F.lit("rejected: replayed rows "), share("candidate_replay"), F.lit(", the current model has "), share("current_replay"))
    return F.when(F.col("accepted"), kept).when(F.col("candidate_iou") < F.col("current_iou") - 1e-4, worse).otherwise(forgets)


def folded(pixels: DataFrame, folds: int) -> tuple[DataFrame, list[int]]:
    """Adds ``fold``: one for each photo while there are at most ``folds`` photos, else by a hash of the photo."""
    ids = [r.image_id for r in pixels.select("image_id").distinct().orderBy("image_id").limit(folds + 1).collect()]
    if len(ids) > folds:
        return pixels.withColumn("fold", F.pmod(F.xxhash64("image_id"), F.lit(folds)).cast("int")), list(range(folds))
    known = pixels.sparkSession.createDataFrame(list(zip(ids, range(len(ids)), strict=True)), f"image_id {dict(pixels.dtypes)['image_id']}, fold int")
    return pixels.join(F.broadcast(known), "image_id"), list(range(len(ids)))


def cross_validated(pixels: DataFrame, names: list[str], folds: int = 5, options: Options = Options(), per_pair: int = PER_PAIR) -> DataFrame:
    """image_id, fold and the scores on all known pixels of each photo, by the model that never saw its fold."""
    pixels, numbers = folded(pixels, folds)
    rows = written(samples(pixels, names, per_pair))
    start = fresh_network(rows, (len(names), 32, 16, 1), options.seed)
    made = train(rows, start, options, numbers)
    keep = ["image_id", "y", "x", "width", "height", "damage", "known", "fold"]
    df = pixels.select(*keep, F.array(*[F.col(n).cast("double") for n in names]).alias("features"))
    df = predictions(df, "features", {f"_{k}": net for k, (net, _) in zip(numbers, made, strict=True)})
    df = df.withColumn("_own", F.get(F.array(*[f"_{k}" for k in numbers]), "fold")).select(*keep, "_own")
    df = nb.box_mean(df, {"probability": "_own"}, start.smooth_radius)
    return ln.scores(df, start.threshold, ("image_id", "fold"), everywhere=True)
