"""Leaf-wise boosting against a plain numpy version."""

import numpy as np
import pandas as pd
import pytest

from lendlens.operators import boosting as bo, families
from lendlens.operators.bins import fit_bins
from lendlens.operators.cells import Cells

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 400
    frame = pd.DataFrame({"id": range(n), "a": rng.normal(size=n).round(1), "b": rng.integers(0, 4, n).astype(float), "c": rng.normal(size=n).round(2)})
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * frame.a * (frame.b > 1) - frame.c))).astype(int)
    frame["fold"] = frame.id % 3
    return frame, spark.createDataFrame(frame).repartition(3).cache()


def numpy_boosting(x, y, how, edges):
    """Best-first growth, one split at a time, over the same cuts."""
    base = np.log(y.mean() / (1 - y.mean()))
    margin, splits = np.full(len(y), base), []
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * bo.UNIT) / bo.UNIT, np.rint(p * (1 - p) * bo.UNIT) / bo.UNIT
        leaves = [(np.ones(len(y), bool), 0)]

        def best(rows):
            found = (0.0, None, None)
            worth = lambda r: g[r].sum() ** 2 / max(h[r].sum() + how.l2, 1e-12)
            for f in range(x.shape[1]):
                for e in edges[f]:
                    left, right = rows & (x[:, f] <= e), rows & (x[:, f] > e)
                    if min(left.sum(), right.sum()) < max(how.min_child, 1) or min(h[left].sum(), h[right].sum()) < how.min_hessian:
                        continue
                    gain = worth(left) + worth(right) - worth(rows)
                    if gain > found[0] + 1e-10:
                        found = (gain, f, e)
            return found
        known = [best(leaves[0][0])]
        while len(leaves) < how.max_leaves:
            order = [i for i, k in enumerate(known) if k[0] > 1e-9 and (not how.depth or leaves[i][1] < how.depth)]
            if not order:
                break
            i = max(order, key=lambda j: known[j][0])
            gain, f, e = known[i]
            rows, depth = leaves.pop(i)
            known.pop(i)
            splits.append((f, round(float(e), 6)))
            for part in (rows & (x[:, f] <= e), rows & (x[:, f] > e)):
                leaves.append((part, depth + 1))
                known.append(best(part))
        for rows, _ in leaves:
            margin[rows] -= how.rate * g[rows].sum() / max(h[rows].sum() + how.l2, 1e-12)
    return 1 / (1 + np.exp(-margin)), splits


def splits_of(model):
    names = {f: i for i, f in enumerate(FEATURES)}
    return sorted((names[FEATURES[f]], round(float(model.bins.edges[f][c]), 6)) for t in model.trees
                  for f, c in zip(t.feature.tolist(), t.cut.tolist()) if f >= 0)


@pytest.mark.parametrize("few", [0, 90, 1 << 16])
@pytest.mark.parametrize("how", [
    bo.Boosting(rounds=3, max_leaves=6, min_child=5), bo.Boosting(rounds=11, max_leaves=4, rate=0.3, l2=1.0, min_child=1),
    bo.Boosting(rounds=2, max_leaves=50, min_child=12, depth=2), bo.Boosting(rounds=2, max_leaves=8, min_child=500)])
def test_whole_fit_equals_numpy(data, how, few, monkeypatch):
    monkeypatch.setattr(bo, "FEW", few)  # leaves by histograms, mixed, and in one task
    frame, df = data
    model = bo.fit_boosting(df, FEATURES, "label", [how])[0][0]
    x, y = frame[FEATURES].to_numpy(), frame.label.to_numpy()
    score, splits = numpy_boosting(x, y, how, model.bins.edges)
    found = model.score(df, "s").select("id", "s").toPandas().sort_values("id").s.to_numpy()
    assert len(model.trees) == how.rounds
    assert splits_of(model) == sorted(splits)
    assert np.allclose(found, score, atol=1e-9)
    for tree in model.trees:
        assert (tree.feature < 0).sum() <= how.max_leaves


def test_folds_and_points_grow_together(data):
    frame, df = data
    points = [bo.Boosting(rounds=3, max_leaves=4, min_child=5), bo.Boosting(rounds=2, max_leaves=5, min_child=5, rate=0.2)]
    found = bo.fit_boosting(df, FEATURES, "label", points, [0, 2, None])
    x, y = frame[FEATURES].to_numpy(), frame.label.to_numpy()
    for how, models in zip(points, found):
        for fold, model in zip([0, 2, None], models):
            use = (frame.fold != fold).to_numpy() if fold is not None else np.ones(len(y), bool)
            score, _ = numpy_boosting(x[use], y[use], how, model.bins.edges)
            assert np.allclose(bo.BoostedScorer(model)(x[use]), score, atol=1e-9)


def test_subsample_repeats_and_sees_its_share(data):
    _, df = data
    how = bo.Boosting(rounds=2, max_leaves=4, min_child=5, subsample=0.5)
    a, b = (bo.fit_boosting(d, FEATURES, "label", [how], row_id="id")[0][0] for d in (df, df.repartition(7)))
    assert all(np.array_equal(s.value, t.value) for s, t in zip(a.trees, b.trees))
    share = bo.seen(np.arange(20000), how, 0)
    assert 0.48 < share.mean() < 0.52 and (share != bo.seen(np.arange(20000), how, 1)).any()
    with pytest.raises(ValueError):
        bo.fit_boosting(df, FEATURES, "label", [how])


def test_bins(spark, data):
    frame, df = data
    bins = fit_bins(df, FEATURES, 16)
    assert bins.edges[1].tolist() == [0.0, 1.0, 2.0] and len(bins.edges[2]) <= 16
    codes = df.select("c", bins.codes().alias("k")).collect()
    assert all(r["k"][2] == (bins.edges[2] < r["c"]).sum() for r in codes)
    lone = spark.createDataFrame([(0, 1.0, 1), (1, 1.0, 0)] * 3, "id long, a double, label int")
    model = bo.fit_boosting(lone, ["a"], "label", [bo.Boosting(rounds=1)])[0][0]  # a constant feature
    assert [len(t.feature) for t in model.trees] == [1]
    with pytest.raises(Exception, match="a is missing"):
        fit_bins(spark.createDataFrame([(None, 1)], "a double, label int"), ["a"])
    with pytest.raises(ValueError, match="both classes"):
        bo.fit_boosting(lone.where("label = 1"), ["a"], "label")


@pytest.mark.parametrize("how", [
    bo.Boosting(rounds=12, max_leaves=7, min_child=5), bo.Boosting(rounds=3, max_leaves=8, depth=3, min_child=1, l2=1.0, subsample=0.6)])
def test_whole_models_equal_those_of_passes(data, how, monkeypatch):
    """In tasks that hold all rows, by passes with large and small leaves, and by passes of histograms only."""
    _, df = data
    found = []
    for parts, few in ((32, 90), (0, 90), (0, 0)):
        monkeypatch.setattr(bo, "PARTS", parts), monkeypatch.setattr(bo, "FEW", few)
        if parts:
            monkeypatch.setattr(bo, "fit_in_passes", None)  # a whole fit takes no passes
        found.append(bo.fit_boosting(df, FEATURES, "label", [how], [None, 1], "id", 8)[0])
        monkeypatch.undo()
    for models in zip(*found):
        for trees in zip(*(m.trees for m in models)):
            assert all(np.array_equal(getattr(t, a), getattr(trees[0], a)) for t in trees[1:] for a in ("feature", "left", "right", "value"))


def test_cells_sum_by_feature_and_bin():
    rng = np.random.default_rng(3)
    sizes = [256, 1, 2, 5, 200, 2, 3]
    codes = np.stack([rng.integers(0, n, 500) for n in sizes]).astype(np.uint8)
    cells, g = Cells(sizes), np.rint(rng.normal(size=500) * 2 ** 30)
    assert sorted(f for group in cells.groups for f in group) == list(range(7)) and len(cells.groups) < 4
    rows = np.flatnonzero(rng.random(500) < 0.5)
    found = cells.sums(cells.joint(codes), (g[rows], None), rows)
    wanted = [[sum(w[codes[f][rows] == b]) for f, n in enumerate(sizes) for b in range(n)] for w in (g[rows], np.ones(len(rows)))]
    assert found.tolist() == wanted
    padded = cells.padded(found, 256)
    assert padded.sum() == found.sum() and padded[0, 3, :5].tolist() == found[0, cells.starts[3]:cells.ends[3]].tolist()
    assert cells.upto(found)[:, cells.ends - 1].tolist() == [[w[rows].sum()] * 7 for w in (g, np.ones(500))]


def test_margins_of_large_and_small_blocks_are_equal(data, monkeypatch):
    frame, df = data
    model = bo.fit_boosting(df, FEATURES, "label", [bo.Boosting(rounds=4, max_leaves=6, min_child=5)])[0][0]
    x, found = frame[FEATURES].to_numpy(), []
    for many in (0, 1 << 30):
        monkeypatch.setattr(bo, "MANY", many)
        found.append(model.margins(x))
    assert found[0].tolist() == found[1].tolist() and len(set(found[0])) > 6
    assert model.margins(x[:0]).tolist() == []


def test_families_share_their_bins(data, monkeypatch):
    _, df = data
    asked = []
    monkeypatch.setattr(families, "fit_bins", lambda *a: asked.append(a[0]) or fit_bins(*a))
    kinds = families.portfolio(FEATURES, "label", "id", rounds=2, max_bins=16)
    whole = [kinds[k].fit_points(df, [kinds[k].untuned], [None])[0][0] for k in ("leaf_boosting", "xgboost", "adaboost")]
    part = df.where("fold <> 1")
    kinds["adaboost"].fit_points(part, [kinds["adaboost"].untuned], [None])
    assert len(asked) == 2 and asked[0] is df and asked[1] is part
    assert all(a.tolist() == b.tolist() for m in whole for a, b in zip(m.bins.edges, fit_bins(df, FEATURES, 16).edges))
