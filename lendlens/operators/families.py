"""The model portfolio: for each kind its grid, its usual point, and how points and folds are fitted together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from lendlens.constants import SCALED_FEATURES
from lendlens.operators import adaboost, boosting, extra_trees, fit, gradient, newton, pivots
from lendlens.operators.bins import Bins, fit_bins
from lendlens.operators.train import Family

# The grids that are searched, per kind of model.
GRIDS = {
    "gradient_boosting": {"rounds": [50, 100], "rate": [0.1, 0.15, 0.2], "depth": [3, 5], "subsample": [0.8, 1.0]},
    "ridge": {"alpha": [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0], "fit_intercept": [True, False]},
    "elastic_net": {"strength": [0.1, 1.0, 10.0, 100.0], "l1_ratio": [0.1, 0.3, 0.5, 0.7, 0.9], "max_iter": [500, 1000],
                    "tol": [1e-3, 1e-4]},
    "logistic": {"strength": [0.01, 0.1, 1.0, 10.0, 100.0], "l1_ratio": [1.0, 0.0, 0.5], "max_iter": [1000, 2000], "tol": [1e-3, 1e-4]},
    "bernoulli_nb": {"alpha": [0.01, 0.1, 0.5, 1.0, 2.0], "fit_prior": [True, False], "binarize": [0.0, 0.1, 0.5]},
    "adaboost": {"rounds": [50, 100, 200], "rate": [0.5, 1.0, 1.5]},
    "hist_boosting": {"rate": [0.05, 0.1, 0.15, 0.2], "rounds": [100, 200, 300], "depth": [3, 6, 10, 0], "min_child": [5, 10, 20]},
    "sgd": {"alpha": [0.0001, 0.001, 0.01, 0.1], "schedule": ["constant", "optimal", "invscaling"], "eta0": [0.01, 0.1, 1.0],
            "max_iter": [500, 1000], "tol": [1e-3, 1e-4]},
    "leaf_boosting": {"rounds": [100, 200, 300], "max_leaves": [20, 31, 50], "rate": [0.05, 0.1, 0.15], "min_child": [10, 20],
                      "subsample": [0.8, 1.0]},
}


def one_by_one(make: Callable[..., object]) -> Callable:
    """Fits that share no pass: every point on the rows of every training set."""
    def fit_points(df: DataFrame, points: Sequence[dict], folds: Sequence[int | None]) -> list[list]:
        return [[make(df if f is None else df.where(F.col("fold") != f), **p) for f in folds] for p in points]
    return fit_points


def portfolio(features: Sequence[str], label: str, row_id: str, rounds: int | None = None, max_iter: int | None = None,
              trees: int = 100, depth: int = 10, max_bins: int = 255) -> dict[str, Family]:
    """All kinds by name. ``rounds`` and ``max_iter`` cap boosting rounds and epochs of the usual points, never the
    grids; ``trees`` and ``depth`` are those of the forests."""
    binned: list[tuple[DataFrame, Bins]] = []

    def bins_of(df: DataFrame) -> Bins:
        """Bins of the table that was asked for last are kept: kinds take turns on one table."""
        if not binned or binned[0][0] is not df:
            binned[:] = [(df, fit_bins(df, features, max_bins))]
        return binned[0][1]

    def boosted(name: str, base: boosting.Boosting) -> Family:
        def fit_points(df, points, folds):
            full = [replace(base, **p) for p in points]
            # Without a limit of leaves of their own, trees of a depth grow to that depth.
            full = [replace(p, max_leaves=1 << p.depth) if name == "gradient_boosting" else p for p in full]
            return boosting.fit_boosting(df, features, label, full, folds, row_id, bins=bins_of(df))
        start = {"rounds": min(base.rounds, rounds) if rounds else base.rounds}
        return Family(name, GRIDS.get(name, {"rounds": [base.rounds]}), fit_points, start)

    def ridge(df, points, folds):
        named = any(f is not None for f in folds)
        sums = fit.gram_sums(df, features, label, "fold" if named else None)
        parts = list(sums.counts)
        return [[sums.solve("ridge", p["alpha"], [x for x in parts if f is None or x != f], p["fit_intercept"], SCALED_FEATURES) for f in folds] for p in points]

    def bayes(df, points, folds):
        counted: dict = {}
        largest = max((f for f in folds if f is not None), default=-1) + 1
        found = []
        for p in points:
            held = fit.bernoulli_folds(df, features, label, largest, counted=counted, **p) if largest else []
            whole = [fit.fit_bernoulli_nb(df, features, label, **p)] if None in folds else []
            found.append([whole[0] if f is None else held[f] for f in folds])
        return found

    def penalised(df, points, folds):
        return newton.fit_penalised(df, features, label, [newton.Penalty(**p) for p in points], folds)

    def sgd(df, points, folds):
        return gradient.fit_sgd(df, features, label, row_id, [gradient.Descent(**p) for p in points], folds, batches=8)

    def ada(df, points, folds):
        return adaboost.fit_adaboost(df, features, label, [adaboost.AdaBoost(**p) for p in points], folds, bins=bins_of(df))

    def extra(df, points, folds):
        return [extra_trees.fit_extra_trees(df, features, label, folds=folds, **p) for p in points]

    def neighbours(df, points, folds):
        return [[pivots.ExactNeighbours(df if f is None else df.where(F.col("fold") != f), list(features), label, row_id, **p) for f in folds] for p in points]
    epochs = {"max_iter": max_iter} if max_iter else {}
    kinds = [
        Family("logistic", GRIDS["logistic"], penalised, {"strength": 1.0, "l1_ratio": 0.0}, True),
        Family("random_forest", {"depth": [depth]}, one_by_one(lambda df, **p: fit.fit_random_forest(df, features, label, trees, **p)), {"depth": depth}),
        boosted("leaf_boosting", boosting.Boosting()),
        boosted("xgboost", boosting.Boosting(depth=6, max_leaves=64, rate=0.3, l2=1.0, min_child=1, min_hessian=1.0)),
        boosted("hist_boosting", boosting.Boosting()),
        Family("extra_trees", {"trees": [trees], "depth": [depth]}, extra, {"trees": trees, "depth": depth}),
        Family("ridge", GRIDS["ridge"], ridge, {"alpha": 1.0, "fit_intercept": True}),
        Family("elastic_net", GRIDS["elastic_net"], penalised, {"strength": 1.0, "l1_ratio": 0.5}, True),
        Family("knn", {"k": [5]}, neighbours, {"k": 5}, True),
        Family("knn_weighted", {"k": [10]}, neighbours, {"k": 10, "by_distance": True}, True),
        Family("adaboost", GRIDS["adaboost"], ada, {"rounds": min(50, rounds) if rounds else 50}),
        boosted("gradient_boosting", boosting.Boosting(depth=3, max_leaves=8, min_child=1)),
        Family("bernoulli_nb", GRIDS["bernoulli_nb"], bayes, {}),
        Family("sgd", GRIDS["sgd"], sgd, epochs, True),
        Family("bagging", {"bags": [10], "depth": [depth]}, one_by_one(lambda df, **p: fit.fit_bagging(df, features, label, row_id, **p)), {"bags": 10, "depth": depth}),
        Family("svm_rbf", {"c": [1.0]}, one_by_one(lambda df, **p: gradient.fit_kernel_svm(df, features, label, row_id, **p)),
               {"c": 1.0, **epochs}, True),
    ]
    return {f.name: f for f in kinds}
