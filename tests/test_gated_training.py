"""The training job against a NumPy loop over the same batches; gate, folds, store and history."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emulsa.operators import learning as ln
from emulsa.operators import training as tr
from emulsa.sources.model_store import ModelStore

SIZES = (3, 5, 1)


def rows_of(spark, n, seed=0, folds=None):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    label, weight = (x[:, 0] - 0.5 * x[:, 1] > 0.2).tolist(), r.uniform(0.5, 2, n).tolist()
    return spark.createDataFrame([(i, x[i].tolist(), label[i], weight[i], None if folds is None else i % folds) for i in range(n)], tr.ROWS)


def gradient(net, x, y, w):
    """By differences, one weight at a time."""
    flat, out = net.flat(), []
    def loss(f):
        p = np.clip(net.with_flat(f).predict(x), 1e-7, 1 - 1e-7)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        out.append((loss(flat + step) - loss(flat - step)) / 2e-6)
    return loss(flat), np.array(out)


def test_gradient_by_differences(spark):
    rows = rows_of(spark, 40)
    net = tr.fresh_network(rows, SIZES)
    d = rows.toPandas()
    loss, want = gradient(net, np.stack(d.features), d.label.to_numpy(float), d.weight.to_numpy())
    [sums] = tr.partial_sums(rows.repartition(3), [(-1, net)], True)
    assert np.isclose(sums[0], loss) and np.isclose(sums[1], d.weight.sum()) and np.allclose(sums[2:], want, atol=1e-4)


@pytest.mark.parametrize("fold", [None, 1])
def test_training_equals_a_loop(spark, fold):
    """Adam with patience, on the batches that the job wrote, row by row in plain NumPy."""
    options = tr.Options(epochs=6, batch=50, rate=0.05, patience=2, seed=3)
    rows = rows_of(spark, 300, folds=None if fold is None else 3)
    start = tr.fresh_network(rows, SIZES)
    made = tr.train(rows, start, options, None if fold is None else [0, 1, 2])
    net, losses = made[fold or 0]
    at = tr.staged(rows, options)
    read = {b: at.read(spark, b).toPandas() for b in range(-1, at.batches)}
    assert sum(map(len, read.values())) == 300 and 10 <= len(read[-1]) <= 60 and at.batches == 6
    if fold is not None:
        read = {b: d[d.fold != fold] for b, d in read.items()}
    flat, m, v, t = start.flat(), 0, 0, 0
    n_weights = sum(map(len, start.weights))

    def check():
        d = read[-1]
        p = start.with_flat(flat).predict(np.stack(d.features))
        return float(sum(w * -np.log(np.clip(q if y else 1 - q, 1e-7, 1)) for q, y, w in zip(p, d.label, d.weight, strict=True)) / d.weight.sum())

    best, kept, stale, want = check(), flat, 0, []
    want.append(best)
    for epoch in range(options.epochs):
        for b in tr.epoch_order(options, epoch, at.batches):
            d = read[b]
            g = sum(ln.loss_and_gradient(list(SIZES), flat, (np.array([x]) - start.mean) / start.scale, np.array([float(y)]), np.array([w]))[2:] for x, y, w in zip(d.features, d.label, d.weight, strict=True)) / d.weight.sum()
            g = g + np.where(np.arange(len(flat)) < n_weights, options.decay * flat, 0)
            t, m, v = t + 1, 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - options.rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
        want.append(check())
        if want[-1] < best - 1e-5:
            best, kept, stale = want[-1], flat, 0
        else:
            stale += 1
            if stale >= options.patience:
                break
    assert np.allclose(losses, want) and np.allclose(net.flat(), kept) and losses[-1] < losses[0]


def test_small_and_empty_tables(spark):
    with pytest.raises(ValueError, match="no rows"):
        tr.staged(rows_of(spark, 1).where("false"), tr.Options())
    for n in (1, 2, 3):
        rows = rows_of(spark, n)
        [(net, losses)] = tr.train(rows, tr.fresh_network(rows, SIZES), tr.Options(epochs=2))
        assert np.isfinite(net.flat()).all() and len(losses) == 3


def photos(spark, n, side=24):
    y, x = (a.ravel() for a in np.indices((side, side)))
    parts = []
    for k in range(n):
        r = np.random.default_rng(k)
        damage = ((x + 3 * k) // 4 + y // 4) % 3 == 0
        parts.append(pd.DataFrame({"image_id": k, "y": y, "x": x, "width": side, "height": side, "damage": damage, "known": (x + y) % 11 > 0, "f0": damage + r.normal(0, 0.4, len(x)), "f1": r.normal(size=len(x))}))
    return spark.createDataFrame(pd.concat(parts)), ["f0", "f1"]


def replay(spark, turned=False):
    r = np.random.default_rng(9)
    x = r.normal(size=(200, 2))
    label = ((x[:, 0] > 0.5) ^ turned).tolist()
    return spark.createDataFrame([(i, x[i].tolist(), label[i], 1.0 + i % 3) for i in range(200)], "row_id long, features array<double>, label boolean, weight double")


def test_gate(spark):
    p, names = photos(spark, 3)
    options = tr.Options(epochs=6, batch=64, rate=0.03)
    report = tr.train_gated(p, names, replay(spark), options=options, per_pair=200)
    gate, pairs = report.gate.first(), report.pairs.toPandas()
    assert gate.accepted and gate.candidate_iou > gate.current_iou and gate.pairs == 3 and gate.summary.startswith("accepted")
    assert np.isclose(pairs.candidate_iou.mean(), gate.candidate_iou) and report.model == report.candidate and report.model.notes["pairs"] == 3
    assert ln.Network.from_json(report.model.to_json()) == report.model
    # held-out scores by hand, with the smoothing at replicated edges
    d = p.where("image_id = 1").toPandas().sort_values(["y", "x"])
    raw = np.pad(report.candidate.predict(d[names].to_numpy()).reshape(24, 24), 1, mode="edge")
    smooth = sum(raw[i : i + 24, j : j + 24] for i in range(3) for j in range(3)).ravel() / 9
    held = ((d.x * 4 // 24) == (3 * (d.y * 4 // 24) + 1) % 4) & d.known
    flag = (smooth > 0.5) & held
    assert np.isclose((flag & d.damage).sum() / (flag | (d.damage & held)).sum(), pairs.set_index("image_id").candidate_iou[1])
    # the same network once more is no worse; one that has forgotten the replayed rows is turned away
    again = tr.train_gated(p, names, replay(spark), current=report.model, options=tr.Options(epochs=1, rate=0.0), per_pair=200).gate.first()
    assert again.accepted and again.current_iou == again.candidate_iou
    lost = tr.train_gated(p, names, replay(spark, turned=True), current=report.model.changed(weights=[(-np.array(w)).tolist() if k == len(report.model.weights) - 1 else w for k, w in enumerate(report.model.weights)], biases=[(-np.array(b)).tolist() if k == len(report.model.biases) - 1 else b for k, b in enumerate(report.model.biases)]), options=options, per_pair=200)
    row = lost.gate.first()
    assert row.accepted == (row.candidate_iou >= row.current_iou - 1e-4 and row.candidate_replay >= 0.95 * row.current_replay)
    assert lost.model == (lost.candidate if row.accepted else lost.model)


def test_samples(spark):
    p, names = photos(spark, 2)
    got = tr.samples(p, names, per_pair=100).toPandas()
    assert len(got) == 200 and got.key.nunique() == 200 and set(got.weight) == {1.0}
    share = p.where("known").agg(F.avg(F.col("damage").cast("int"))).first()[0]
    assert abs(got.label.mean() - max(0.3, share)) < 0.05
    held = p.where(ln.held_out()).select(F.xxhash64(F.lit("pair"), "image_id", "y", "x").alias("key")).toPandas()
    assert not set(held.key) & set(got.key)


def test_cross_validation(spark):
    """The fold's photo has no part in its own model: changing its labels leaves its model alone."""
    p, names = photos(spark, 3)
    options = tr.Options(epochs=4, batch=64, rate=0.03)
    got = tr.cross_validated(p, names, 5, options, 200).toPandas().set_index("image_id")
    assert sorted(got.fold) == [0, 1, 2] and (got.iou > 0.3).all()
    q, numbers = tr.folded(p, 5)
    rows = tr.samples(q, names, 200)
    made = tr.train(rows, tr.fresh_network(rows, (2, 32, 16, 1)), options, numbers)
    d = q.where("image_id = 2").toPandas().sort_values(["y", "x"])
    raw = np.pad(made[d.fold.iloc[0]][0].predict(d[names].to_numpy()).reshape(24, 24), 1, mode="edge")
    smooth = sum(raw[i : i + 24, j : j + 24] for i in range(3) for j in range(3)).ravel() / 9
    flag = (smooth > 0.5) & d.known
    assert np.isclose((flag & d.damage).sum() / (flag | (d.damage & d.known)).sum(), got.iou[2])
    turned = rows.withColumn("label", F.when(F.col("fold") == 2, ~F.col("label")).otherwise(F.col("label")))
    other = tr.train(turned, tr.fresh_network(rows, (2, 32, 16, 1)), options, numbers)
    assert np.allclose(other[2][0].flat(), made[2][0].flat()) and not np.allclose(other[0][0].flat(), made[0][0].flat())
    many, numbers = tr.folded(photos(spark, 7, 8)[0], 3)
    assert numbers == [0, 1, 2] and many.groupBy("image_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()


def test_model_store(spark, tmp_path):
    store = ModelStore(spark, f"file://{tmp_path}/library")
    net = ln.Network([2, 1], [0.0, 0.0], [1.0, 1.0], [[1.0, 2.0]], [[0.5]])
    assert store.load() is None and store.versions().count() == 0 and store.history().count() == 0
    assert store.save(net) == 1 and store.load() == net
    # a writer that dies between its write and its rename leaves the active model alone
    store._put("model", json.dumps({"broken": 1}))
    assert store.load() == net and store.save(net.changed(threshold=0.4)) == 2 and store.load().threshold == 0.4
    # another writer has taken the next version
    (tmp_path / "library/models/000000000003.json").write_text(net.to_json())
    taken = store._put("model", net.to_json())
    assert not store._commit(taken, "models/000000000003.json")
    assert store.save(net) == 4 and [r.version for r in store.versions().collect()] == [4, 3, 2, 1]
    for bad in ("{", json.dumps({"broken": 1}), "", json.dumps(json.loads(net.to_json()) | {"mean": [0.0]})):
        (tmp_path / "library/models/000000000005.json").write_text(bad)
        (tmp_path / "library/models/.000000000005.json.crc").unlink(missing_ok=True)
        assert store.load() is None
    store.append("one line")
    assert store.reset() == 6 and store.load() is None
    assert [r.line for r in store.history().collect()] == ["Reset to the built-in model.", "one line"]
