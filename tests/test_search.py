"""Penalised logistic models by their optimality conditions, and searches over families."""

import numpy as np
import pandas as pd
import pytest

from lendlens.operators import adaboost, families, newton, train
from lendlens.plans import catalog
from pyspark.sql import functions as F

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 240
    frame = pd.DataFrame({"id": range(n), **{f: rng.normal(size=n) for f in FEATURES}})
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(1 - 2 * frame.a + 0.5 * frame.b))).astype(int)
    frame["fold"] = frame.id % 3
    return frame, spark.createDataFrame(frame).repartition(3).cache()


@pytest.mark.parametrize("l1", [0.0, 0.5, 1.0])
def test_penalised_fits_are_minima(data, l1):
    frame, df = data
    points = [newton.Penalty(s, l1) for s in (0.05, 1.0, 100.0)]
    x = np.hstack([frame[FEATURES].to_numpy(), np.ones((len(frame), 1))])
    for how, fits in zip(points, newton.penalised(df, FEATURES, "label", points, [None, 2])):
        for fit, use in zip(fits, (np.ones(len(frame), bool), (frame.fold != 2).to_numpy())):
            p = 1 / (1 + np.exp(-(x[use] @ fit.weights)))
            slope = x[use].T @ (p - frame.label[use])
            w, g = fit.weights[:-1], slope[:-1] + (1 - l1) / how.strength * fit.weights[:-1]
            lasso = l1 / how.strength
            assert abs(slope[-1]) < 1e-5
            assert np.all(np.where(w != 0, np.abs(g + lasso * np.sign(w)), np.abs(g) - lasso) < 1e-5)
            assert fit.done and fit.steps < 30
    if l1 == 1.0:
        assert (newton.penalised(df, FEATURES, "label", [newton.Penalty(0.02, 1.0)])[0][0].weights[:-1] == 0).any()


def logistic_family():
    return train.Family(
        "logistic", {"strength": [0.01, 0.1, 1.0, 10.0], "l1_ratio": [0.0, 1.0]},
        lambda df, points, folds: newton.fit_penalised(df, FEATURES, "label", [newton.Penalty(**p) for p in points], folds),
        {"strength": 1.0, "l1_ratio": 0.0})


def test_one_rung_is_the_plain_search(data):
    _, df = data
    family = logistic_family()
    found = train.successive_search(df, family, "label", "id", 5, 3).collect()
    specs = [train.ModelSpec(str(r["point"]), family.spec(dict(eval(r["params"]))).fit) for r in found]
    plain = {r["model_name"]: r for r in train.cross_validate(df, specs, "label", 3).collect()}
    assert len(found) == 5 and sum(r["survives"] for r in found) == 1
    for r in found:
        assert r["cv_mean"] == pytest.approx(plain[str(r["point"])]["cv_mean"], abs=1e-9)
        assert r["cv_std"] == pytest.approx(plain[str(r["point"])]["cv_std"], abs=1e-9)
    best = max(found, key=lambda r: (r["cv_mean"], -r["point"]))
    assert best["survives"]
    row = train.search_families(df.where("id < 160"), df.where("id >= 160"), [family], "label", "id", 5).first()
    assert row["model_name"] == "logistic" and row["improvement"] == pytest.approx(row["test_auc"] - row["baseline_auc"])


def test_rungs_grow_and_thin_out(data):
    _, df = data
    family = train.Family(
        "ada", {"rounds": [2, 4, 6], "rate": [0.5, 1.0, 1.5]},
        lambda rows, points, folds: adaboost.fit_adaboost(rows, FEATURES, "label", [adaboost.AdaBoost(**p) for p in points], folds),
        {"rounds": 3, "rate": 1.0})
    found = train.successive_search(df, family, "label", "id", 9, 3, (0.4, 1.0)).collect()
    first, second = ([r for r in found if r["rung"] == k] for k in (0, 1))
    assert len(first) == 9 and len(second) == 3 and {r["point"] for r in second} == {r["point"] for r in first if r["survives"]}
    shares = [train.seeded_share(df, "id", s, 42).count() for s in (0.2, 0.4, 1.0)]
    assert shares[0] < shares[1] < shares[2] == 240
    nested = train.seeded_share(df, "id", 0.2, 42).join(train.seeded_share(df, "id", 0.4, 42), "id", "left_anti")
    assert nested.count() == 0


def test_successive_search_takes_whole_grids(spark, monkeypatch):
    asked, rows = {}, spark.range(1)

    def searched(df, family, label, row_id, size=25, folds=3, shares=(1.0,)):
        asked[family.name] = train.sample_grid(family.grid, size), shares
        return df
    monkeypatch.setattr(catalog, "_folded", lambda *_: (rows, rows))
    monkeypatch.setattr(train, "successive_search", searched)
    catalog.QUERIES["successive_search"](spark, "")
    assert set(asked) == {"leaf_boosting", "hist_boosting", "gradient_boosting", "adaboost", "sgd"}
    for name, (points, shares) in asked.items():
        grid = families.GRIDS[name]
        assert points == train.sample_grid(grid, 25) and shares[-1] == 1.0
        assert all({p[k] for p in points} == set(grid[k]) for k in ("rounds", "max_iter") if k in grid)


def test_capped_portfolio_keeps_its_grids():
    capped = families.portfolio(FEATURES, "label", "id", 6, 1)
    assert all(capped[name].grid == grid for name, grid in families.GRIDS.items())


def test_train_compare_takes_whole_models(spark, monkeypatch):
    asked, rows = {}, spark.range(1)

    def compared(own, other, kinds, label, folds):
        asked.update({k.name: k.untuned for k in kinds})
        return own
    monkeypatch.setattr(catalog, "_folded", lambda *_: (rows, rows))
    monkeypatch.setattr(train, "compare_families", compared)
    catalog.QUERIES["train_compare"](spark, "")
    assert len(asked) == 17
    assert all(asked[k]["rounds"] == 100 for k in ("leaf_boosting", "xgboost", "hist_boosting", "gradient_boosting"))
    assert asked["adaboost"] == {"rounds": 50} and asked["sgd"] == {} and asked["svm_rbf"] == {"c": 1.0}
    assert asked["extra_trees"]["trees"] == 100 and all(asked[k]["depth"] == 10 for k in ("random_forest", "extra_trees", "bagging"))
