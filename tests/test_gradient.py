"""Mini-batch descent, the kernel classifier and exact neighbours against plain numpy versions."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators import gradient as gr, pivots as pv

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 300
    frame = pd.DataFrame({"id": range(n), **{f: rng.normal(size=n) for f in FEATURES}})
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(-2 * frame.a + frame.b))).astype(int)
    frame["ring"] = (frame.a ** 2 + frame.b ** 2 < 1.2).astype(int)
    frame["fold"] = frame.id % 3
    return frame, spark.createDataFrame(frame).repartition(3).cache()


def numpy_descent(frame, how, batches, seed, use):
    """The same order of batches, one model at a time."""
    x, y = frame[FEATURES].to_numpy(), np.where(frame.label == 1, 1.0, -1.0)
    batch = np.array([int(hashlib.md5(f"{i}{seed}".encode()).hexdigest()[:8], 16) % batches for i in frame.id])
    w, b, seen, best, idle, epoch, mean, steps = np.zeros(3), 0.0, 0.0, np.inf, 0, 0, np.zeros(4), 0
    while epoch < how.max_iter and idle < how.patience:
        loss = rows = 0.0
        for k in gr.batch_order(seed, epoch, batches):
            at = (batch == k) & use
            if not at.any():
                continue
            z = y[at] * (x[at] @ w + b)
            if how.loss == "log":
                loss, slope = loss + np.log1p(np.exp(-z)).sum(), -y[at] / (1 + np.exp(z))
            else:
                loss, slope = loss + np.maximum(0, 1 - z).sum(), -y[at] * (z < 1)
            rows += at.sum()
            eta = {"constant": how.eta0, "invscaling": how.eta0 / max(seen, 1) ** 0.5,
                   "optimal": 1 / (how.alpha * (seen + 1 / (how.alpha * np.sqrt(1 / np.sqrt(how.alpha)))))}[how.schedule]
            w = w * max(0, 1 - eta * how.alpha) - eta * (slope @ x[at]) / at.sum()
            b -= eta * slope.mean()
            seen, steps = seen + at.sum(), steps + 1
            mean += (np.append(w, b) - mean) / steps
        idle = idle + 1 if loss / rows > best - how.tol else 0
        best, epoch = min(best, loss / rows), epoch + 1
    return np.append(w, b), mean, epoch


def test_descent_equals_numpy(data):
    frame, df = data
    points = [gr.Descent(max_iter=6), gr.Descent(schedule="constant", eta0=0.1, alpha=0.01, max_iter=4), gr.Descent(schedule="invscaling", eta0=0.5, tol=0.05, patience=2, max_iter=6),
              gr.Descent("hinge", alpha=0.01, average=True, max_iter=5)]
    found = gr.descend(df, FEATURES, "label", "id", points, [None, 1], batches=4, seed=7)
    for how, walks in zip(points, found):
        for walk, use in zip(walks, (np.ones(len(frame), bool), (frame.fold != 1).to_numpy())):
            weights, mean, epochs = numpy_descent(frame, how, 4, 7, use)
            assert walk.epochs == epochs
            assert np.allclose(walk.weights, weights, atol=1e-9) and np.allclose(walk.mean, mean, atol=1e-9)
    assert found[2][0].epochs < 6  # ended by its tolerance
    model = gr.fit_sgd(df, FEATURES, "label", "id", points[:1], batches=4, seed=7)[0][0]
    scores = model.score(df, "s").select("id", "s").toPandas().sort_values("id").s.to_numpy()
    x = frame[FEATURES].to_numpy()
    assert np.allclose(scores, 1 / (1 + np.exp(-(x @ found[0][0].weights[:3] + found[0][0].weights[3]))))


def test_large_batches_are_read_by_several_tasks(spark):
    df = spark.range(2000).select("id", F.rand(3).alias("a"), (F.col("id") % 2).cast("int").alias("label"))
    rows = gr.in_batches(df, ["a"], "label", "id", 2, 7, None, file_rows=100)
    for batch in range(2):
        assert rows.where(F.col("batch") == batch).rdd.getNumPartitions() > 4
    assert rows.count() == 2000 and sorted(rows.columns) == ["batch", "fold", "x", "y"]
    assert gr.in_batches(df, ["a"], "label", "id", 2, 7, None).where("batch = 0").rdd.getNumPartitions() == 1


def test_random_features_approach_the_kernel():
    x = np.random.default_rng(1).normal(size=(60, 5))
    kernel = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(2))
    errors = []
    for components in (64, 4096):
        z = gr.FourierMap.drawn(5, components, 0.2, 3)(x)
        errors.append(np.abs(z @ z.T - kernel).mean())
    assert errors[1] < 0.012 and errors[1] < errors[0] / 3


def test_kernel_classifier_learns_a_ring(data):
    frame, df = data
    model = gr.fit_kernel_svm(df, FEATURES, "ring", "id", components=128, max_iter=8, batches=2, c=10.0)
    x, y = frame[FEATURES].to_numpy(), frame.ring.to_numpy()
    p = model(x)
    order = np.argsort(model.decisions(x))
    assert (np.diff(p[order]) >= 0).all() and 0 < p.min() and p.max() < 1  # probabilities follow the decisions
    assert ((p > 0.5) == y).mean() > 0.85  # no straight line can tell the ring from the rest
    assert abs(p.mean() - y.mean()) < 0.08


def test_sigmoid_is_the_best_one(data):
    frame, df = data
    slope, shift = gr.fit_sigmoid(df, "a", "label")
    bad, good = frame.label.sum(), (1 - frame.label).sum()
    target = np.where(frame.label == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    rest = 1 / (1 + np.exp(-(slope * frame.a + shift))) - target
    assert abs(rest.sum()) < 1e-4 and abs((rest * frame.a).sum()) < 1e-4


@pytest.mark.parametrize("k,most,block", [(5, 1024, 4096), (1, 6, 7), (400, 3, 50)])
def test_neighbours_equal_brute_force(spark, data, k, most, block):
    frame, _ = data
    rng = np.random.default_rng(2)
    points = frame[["id", *FEATURES, "label"]].copy()
    points.loc[150:220, FEATURES] = points.loc[0, FEATURES].to_numpy()  # one place holds many rows
    points[FEATURES] = points[FEATURES].round(1)
    asked = pd.concat([points.head(20), pd.DataFrame({"id": range(1000, 1060), **{f: rng.normal(size=60) * 2 for f in FEATURES}, "label": 0})])
    found = pv.nearest_rows(spark.createDataFrame(points).repartition(3), spark.createDataFrame(asked), FEATURES, "label", "id", k, most, block)
    rows = {r["id"]: r for r in found.select("*", pv.vote(F.col("near")).alias("u"), pv.vote(F.col("near"), True).alias("w")).collect()}
    assert len(rows) == len(asked)
    x, ids, label = points[FEATURES].to_numpy(), points.id.to_numpy(), points.label.to_numpy()
    for i, q in zip(asked.id, asked[FEATURES].to_numpy()):
        d = np.round(np.sqrt(((x - q) ** 2).sum(1)), pv.PLACES)
        order = np.lexsort((ids, d))[:k]
        assert [n["other"] for n in rows[i]["near"]] == ids[order].tolist()
        assert rows[i]["u"] == pytest.approx(label[order].mean())
        weight = (d[order] == 0) if (d[order] == 0).any() else 1 / d[order]
        assert rows[i]["w"] == pytest.approx((weight * label[order]).sum() / weight.sum())
        assert rows[i]["compared"] <= len(points)
    if k == 1:
        assert np.mean([r["compared"] for r in rows.values()]) < 0.9 * len(points)


def test_neighbours_need_rows(spark, data):
    _, df = data
    with pytest.raises(ValueError, match="no rows"):
        pv.nearest_rows(df.where("id < 0"), df, FEATURES, "label", "id", 3)
    assert pv.nearest_rows(df, df.where("id < 0"), FEATURES, "label", "id", 3).count() == 0


def test_neighbours_beyond_nearest_cells_equal_brute_force(spark, monkeypatch):
    """Far from the origin, with ties, in small parts and groups; a row travels once per part or group."""
    rng = np.random.default_rng(9)
    points = pd.DataFrame({"id": range(600), **{f: 1000 + rng.normal(size=600).round(1) for f in FEATURES}, "label": rng.integers(0, 2, 600)})
    points.loc[300:450, FEATURES] = points.loc[0, FEATURES].to_numpy()  # more than a part holds
    asked = pd.DataFrame({"id": range(1000, 1090), **{f: 1000 + rng.normal(size=90) * 2 for f in FEATURES}, "label": 0})
    asked.loc[:4, FEATURES] = points.loc[0, FEATURES].to_numpy()
    blocks = []
    whole = pv.met
    monkeypatch.setattr(pv, "met", lambda *a: blocks.append(a) or whole(*a))
    found = pv.nearest_rows(spark.createDataFrame(points).repartition(3), spark.createDataFrame(asked), FEATURES, "label", "id", 6, 24, 4)
    rows = {r["id"]: r for r in found.collect()}
    assert len(blocks) == 1  # only the nearest cells are met query by query
    x, ids = points[FEATURES].to_numpy(), points.id.to_numpy()
    for i, q in zip(asked.id, asked[FEATURES].to_numpy()):
        d = np.round(np.sqrt(((x - q) ** 2).sum(1)), pv.PLACES)
        order = np.lexsort((ids, d))[:6]
        assert [(n["other"], n["distance"]) for n in rows[i]["near"]] == list(zip(ids[order].tolist(), d[order].tolist()))
        assert 6 <= rows[i]["compared"] <= len(points)
