"""AdaBoost and extremely randomised trees against plain numpy versions."""

import numpy as np
import pandas as pd
import pytest

from lendlens.operators import adaboost as ada, extra_trees as et

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 300
    frame = pd.DataFrame({"id": range(n), "a": rng.normal(size=n).round(1), "b": rng.integers(0, 4, n).astype(float), "c": rng.normal(size=n).round(2)})
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * frame.a * (frame.b > 1) - frame.c))).astype(int)
    frame["fold"] = frame.id % 3
    return frame, spark.createDataFrame(frame).repartition(3).cache()


def numpy_adaboost(x, y, rounds, rate, edges):
    """Weights carried along, every cut tried."""
    weight, stumps = np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            for e in edges[f]:
                low = x[:, f] <= e
                sides = [[weight[s & (y == k)].sum() for k in (0, 1)] for s in (low, ~low)]
                if not (low.any() and (~low).any()):
                    continue
                pure = sum((a * a + b * b) / (a + b) for a, b in sides)
                if best is None or pure > best[0] + 1e-9:
                    best = (pure, f, e, *[int(b > a) for a, b in sides])
        _, f, e, below, above = best
        miss = np.where(x[:, f] <= e, below, above) != y
        error = weight[miss].sum()
        if error >= 0.5:
            break
        alpha = rate * np.log((1 - error) / error)
        stumps.append((f, e, below, above, alpha, error))
        weight = weight * np.exp(alpha * miss)
        weight /= weight.sum()
    return stumps


@pytest.mark.parametrize("rate", [0.5, 1.0])
def test_adaboost_equals_numpy(data, rate):
    frame, df = data
    models = ada.fit_adaboost(df, FEATURES, "label", [ada.AdaBoost(12, rate), ada.AdaBoost(3, 1.5)], [None, 1])
    x, y = frame[FEATURES].to_numpy(), frame.label.to_numpy()
    for how, (whole, part) in zip([(12, rate), (3, 1.5)], models):
        for model, use in ((whole, np.ones(len(y), bool)), (part, (frame.fold != 1).to_numpy())):
            wanted = numpy_adaboost(x[use], y[use], *how, model.bins.edges)
            assert [(s.feature, model.bins.edges[s.feature][s.cut], s.below, s.above) for s in model.stumps] == [w[:4] for w in wanted]
            assert np.allclose([(s.alpha, s.error) for s in model.stumps], [w[4:] for w in wanted], atol=1e-5)
    scored = models[0][0].score(df, "s").select("id", "s").toPandas().sort_values("id").s.to_numpy()
    total = sum(s.alpha for s in models[0][0].stumps)
    votes = sum(s.alpha * (2 * np.where(x[:, s.feature] <= models[0][0].bins.edges[s.feature][s.cut], s.below, s.above) - 1)
                for s in models[0][0].stumps)
    assert np.allclose(scored, 1 / (1 + np.exp(-votes / total)))


def test_whole_adaboost_equals_that_of_passes(data, monkeypatch):
    _, df = data
    points = [ada.AdaBoost(12, 0.5), ada.AdaBoost(4, 1.5)]
    passes = ada.boost_in_passes
    monkeypatch.setattr(ada, "boost_in_passes", None)  # a whole fit takes no passes
    whole = ada.fit_adaboost(df, FEATURES, "label", points, [None, 1], 8)
    monkeypatch.setattr(ada, "boost_in_passes", passes), monkeypatch.setattr(ada, "WHOLE", 0)
    assert [[m.stumps for m in models] for models in whole] == [[m.stumps for m in models] for models in ada.fit_adaboost(df, FEATURES, "label", points, [None, 1], 8)]


def test_adaboost_ends_early(spark):
    clear = spark.createDataFrame([(float(i), int(i > 4)) for i in range(10)], "a double, label int")
    model = ada.fit_adaboost(clear, ["a"], "label")[0][0]
    assert [(s.error, s.alpha) for s in model.stumps] == [(0.0, 1.0)]
    even = spark.createDataFrame([(1.0, 0), (1.0, 1)], "a double, label int")
    with pytest.raises(ValueError, match="chance"):
        ada.fit_adaboost(even, ["a"], "label")


def numpy_tree(x, y, seed, tree, depth, most):
    """Nodes (rows, positives, feature, cut) grown level by level from the same draws."""
    sets, feature, cut, left, level = [np.arange(len(y))], [-1], [0.0], [0], [0]
    at = 0
    while at < len(sets):
        rows = sets[at]
        if level[at] < depth and len(rows) >= 2 and 0 < y[rows].sum() < len(rows):
            drawn = et.drawn_cuts(seed, tree, at, x[rows].min(0), x[rows].max(0), most)
            gains = [et.gini_gain(len(rows), y[rows].sum(), (x[rows, f] <= c).sum(), y[rows][x[rows, f] <= c].sum()) for f, c in drawn]
            if drawn:
                f, c = drawn[int(np.argmax(gains))]
                feature[at], cut[at], left[at] = f, c, len(sets)
                for part in (rows[x[rows, f] <= c], rows[x[rows, f] > c]):
                    sets.append(part), feature.append(-1), cut.append(0.0), left.append(0), level.append(level[at] + 1)
        at += 1
    return feature, cut, left, [y[s].mean() for s in sets]


@pytest.mark.parametrize("depth,most", [(3, None), (30, 2)])
def test_extra_trees_equal_numpy(data, depth, most):
    frame, df = data
    x, y = frame[FEATURES].to_numpy(), frame.label.to_numpy()
    forest, part = et.fit_extra_trees(df, FEATURES, "label", 4, depth, most_features=most, folds=[None, 0])
    for model, use in ((forest, np.ones(len(y), bool)), (part, (frame.fold != 0).to_numpy())):
        for t, (feature, cut, left, share) in enumerate(model.trees):
            wanted = numpy_tree(x[use], y[use], 42, t, depth, most or 1)
            assert feature.tolist() == wanted[0] and left.tolist() == wanted[2]
            assert np.allclose(cut, wanted[1]) and np.allclose(share, wanted[3])
    if depth == 30:  # grown to the end, so all but equal rows are told apart
        assert (np.abs(forest(x) - y) < 0.5).mean() > 0.97
    again = et.fit_extra_trees(df.repartition(5), FEATURES, "label", 4, depth, most_features=most)[0]
    assert np.array_equal(again(x), forest(x))
    scored = forest.score(df, "s").select("id", "s").toPandas().sort_values("id").s
    assert np.allclose(scored, forest(x))


def test_trees_abreast_lead_rows_to_their_leaves():
    x = np.random.default_rng(2).normal(size=(50, 3))
    stump = (np.array([1, -1, -1]), np.array([0.2, 0.0, 0.0]), np.array([1, 0, 0]))
    deeper = (np.array([0, -1, 2, -1, -1]), np.array([-0.1, 0.0, 0.4, 0.0, 0.0]), np.array([1, 0, 3, 0, 0]))
    trees = et.Abreast.of([stump, deeper, tuple(a[1:2] for a in stump)])
    assert trees.levels == 2 and trees.roots.tolist() == [0, 3, 8]
    found = trees.nodes(x)
    assert found[0].tolist() == np.where(x[:, 1] > 0.2, 2, 1).tolist()
    assert found[1].tolist() == (3 + np.where(x[:, 0] <= -0.1, 1, np.where(x[:, 2] > 0.4, 4, 3))).tolist()
    assert found[2].tolist() == [8] * 50


def test_nodes_are_asked_for_drawn_features_only(data):
    _, df = data
    rows = df.selectExpr("label", "-1 AS fold", "array(a, b, c) AS x")
    groups = et.plan([(None, 0, et.RandomTree([-1], [0.0], [0], [300], [150], [0]))], {(0, 0): [2]})
    (low, high), = et.node_ranges(rows, groups, 3).values()
    wanted = df.selectExpr("min(c)", "max(c)").first()
    assert low.tolist() == [0.0, 0.0, wanted[0]] and high.tolist() == [0.0, 0.0, wanted[1]]


def test_drawn_cuts():
    low, high = np.array([0.0, 5.0, 1.0]), np.array([0.0, 5.0, 3.0])
    for node in range(50):
        (f, c), = et.drawn_cuts(1, 0, node, low, high, 1)  # only one feature varies
        assert f == 2 and 1 <= c < 3
    assert et.drawn_cuts(1, 0, 0, low, low, 3) == []
