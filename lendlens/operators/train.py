"""Cross-validation, model comparison, random search and stacking."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.hashing import order_key
from lendlens.operators.evaluate import roc_auc, score_curve
from lendlens.operators.fit import Scorer, fit_logistic, gram_sums
from lendlens.operators.held_out import fold_aucs
from lendlens.operators.matrix import standard_scale_fit
from lendlens.session import materialize

Fit = Callable[[DataFrame], Scorer]


@dataclass(frozen=True)
class ModelSpec:
    """A name, how to fit it, and whether it wants standardised features.

    ``fit_folds`` may give the models of all folds from one pass, as scoring expressions.
    """

    name: str
    fit: Fit
    scaled: bool = False
    fit_folds: Callable[[DataFrame, int], list] | None = None


@dataclass(frozen=True)
class ScaledModel:
    scaler: object
    model: Scorer

    def score(self, df: DataFrame, output: str) -> DataFrame:
        raw = df.withColumn("__raw", F.struct(*[c for c in self.scaler.means]))
        scored = self.model.score(self.scaler.transform(raw), output)
        return scored.withColumns({c: F.col(f"__raw.{c}") for c in self.scaler.means}).drop("__raw")


def fit_spec(spec: ModelSpec, train: DataFrame) -> Scorer:
    """Scaling parameters come from the training rows only."""
    if not spec.scaled:
        return spec.fit(train)
    scaler = standard_scale_fit(train)
    return ScaledModel(scaler, spec.fit(scaler.transform(train)))


def _long(df: DataFrame, name: str, label: str, *extra: str) -> DataFrame:
    return df.select(F.lit(name).alias("model_name"), *extra, F.col(label).cast("int").alias("label"),
                     F.col("__score").alias("score"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def held_out_column(models: Sequence) -> Column:
    """The score of a row by the model that did not see its fold."""
    cases = " ".join(f"WHEN {fold} THEN {model.column_sql()}" for fold, model in enumerate(models))
    return F.expr(f"CASE fold {cases} END")


def held_out_scores(df: DataFrame, specs: Sequence[ModelSpec], label: str, folds: int) -> DataFrame:
    """Every row scored by models fitted on the other folds, one by one: (model_name, fold, label, score)."""
    parts = []
    for spec in specs:
        for fold in range(folds):
            model = fit_spec(spec, df.where(F.col("fold") != fold))
            scored = model.score(df.where(F.col("fold") == fold), "__score")
            parts.append(_long(scored, spec.name, label, "fold"))
    return union_all(parts)


def cross_validate(df: DataFrame, specs: Sequence[ModelSpec], label: str, folds: int) -> DataFrame:
    """Mean and population deviation of the AUC over the folds.

    Models that come for all folds at once are scored together. Other scores are written once, so
    models score each row once.
    """
    quick, slow = [s for s in specs if s.fit_folds], [s for s in specs if not s.fit_folds]
    parts = []
    if quick:
        unseen = F.raise_error(F.lit("score is null")).cast("int")
        held = df.withColumn("fold", F.when(F.col("fold").between(0, folds - 1), F.col("fold").cast("int")).otherwise(unseen))
        names = F.array(*[F.lit(s.name) for s in quick])
        parts.append(fold_aucs(held, [s.fit_folds(df, folds) for s in quick], label).select(
            F.get(names, F.col("point").cast("int")).alias("model_name"), F.col("fold").cast("int").alias("fold"), "auc"))
    if slow:
        by = ("model_name", "fold")
        scores = materialize(held_out_scores(df, slow, label, folds))
        parts.append(roc_auc(score_curve(scores, by), by).withColumn("fold", F.col("fold").cast("int")))
    return union_all(parts).groupBy("model_name").agg(
        F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"),
        F.count("auc").alias("folds"))


def train_compare(train: DataFrame, test: DataFrame, specs: Sequence[ModelSpec], label: str,
                  folds: int = 5) -> DataFrame:
    """(model_name, cv_mean, cv_std, test_auc, status); a model that cannot be fitted is recorded.

    Failures of jobs or of the session are raised.
    """
    rows = []
    for spec in specs:
        try:
            cv = cross_validate(train, [spec], label, folds).first()
            model = fit_spec(spec, train)
            scored = _long(model.score(test, "__score"), spec.name, label)
            auc = roc_auc(score_curve(scored)).first()["auc"]
            rows.append((spec.name, cv["cv_mean"], cv["cv_std"], auc, "success"))
        except (ValueError, ArithmeticError, IllegalArgumentException) as error:
            rows.append((spec.name, None, None, None, f"failed: {str(error)[:100]}"))
    return train.sparkSession.createDataFrame(
        rows, "model_name string, cv_mean double, cv_std double, test_auc double, status string")


def sample_grid(grid: dict[str, Sequence], size: int, seed: int = 42) -> list[dict]:
    """Up to ``size`` distinct points of the grid in a seeded order."""
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    random.Random(seed).shuffle(points)
    return points[:size]


def random_search(train: DataFrame, test: DataFrame, name: str, make: Callable[[dict], ModelSpec],
                  grid: dict[str, Sequence], label: str, baseline: ModelSpec, size: int = 25,
                  folds: int = 3, seed: int = 42) -> DataFrame:
    """Best sampled point by cross-validated AUC, refitted, against the untuned model on test."""
    points = sample_grid(grid, size, seed)
    specs = [make(point) for point in points]
    numbered = [replace(s, name=str(i)) for i, s in enumerate(specs)]
    ranked = cross_validate(train, numbered, label, folds).orderBy(
        F.desc("cv_mean"), F.col("model_name").cast("int")).first()
    best = int(ranked["model_name"])
    return _tuned_row(train, test, name, specs[best], points[best], ranked["cv_mean"], baseline, label)


def _tuned_row(train: DataFrame, test: DataFrame, name: str, spec: ModelSpec, point: dict,
               cv: float, baseline: ModelSpec, label: str) -> DataFrame:
    scored = union_all([
        _long(fit_spec(s, train).score(test, "__score"), role, label)
        for role, s in (("tuned", spec), ("baseline", baseline))
    ])
    auc = {r["model_name"]: r["auc"] for r in roc_auc(score_curve(scored)).collect()}
    row = (name, str(sorted(point.items())), cv, auc["tuned"], auc["baseline"], auc["tuned"] - auc["baseline"])
    return train.sparkSession.createDataFrame(
        [row], "model_name string, best_params string, best_cv_auc double, test_auc double, "
               "baseline_auc double, improvement double")


def search_ridge(train: DataFrame, features: Sequence[str], label: str, alphas: Sequence[float],
                 folds: int = 3, intercepts: Sequence[bool] = (True, False),
                 scaled: Sequence[str] = ()) -> DataFrame:
    """AUC of every penalty in one pass for the products per fold and one for the scores.

    The sums of products of a training set are the sums of its folds, so no penalty needs
    its own pass over the rows.
    """
    sums = gram_sums(train, features, label, "fold")
    points = [(float(a), i) for a, i in product(alphas, intercepts)]
    aucs = fold_aucs(train, [sums.held_out("ridge", alpha, folds, intercept, scaled) for alpha, intercept in points], label)
    point = F.get(F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(i).alias("fit_intercept")) for a, i in points]), F.col("point").cast("int"))
    return aucs.select(point.alias("at"), "auc").groupBy("at.alpha", "at.fit_intercept").agg(
        F.avg("auc").alias("cv_mean"), F.stddev_pop("auc").alias("cv_std"))


# Families: points of a grid that are fitted together ------------------------------------------


@dataclass(frozen=True)
class Family:
    """A kind of model with its grid.

    ``fit_points`` (rows, points, folds) gives per point one model for each entry of ``folds``, fitted
    without that fold (None: on all rows), as far as possible in shared passes. ``untuned`` is the
    point that a search is compared with.
    """

    name: str
    grid: dict[str, Sequence]
    fit_points: Callable[[DataFrame, Sequence[dict], Sequence[int | None]], list[list[Scorer]]]
    untuned: dict
    scaled: bool = False

    def spec(self, point: dict | None = None) -> ModelSpec:
        chosen = self.untuned if point is None else point
        return ModelSpec(self.name, lambda df: self.fit_points(df, [chosen], [None])[0][0], self.scaled)


def held_out_points(rows: DataFrame, models: Sequence[Sequence[Scorer]], label: str) -> DataFrame:
    """(point, fold, label, score): every row scored by the models of all points that did not see its fold."""
    parts = []
    for fold in range(len(models[0])):
        scored = rows.where(F.col("fold") == fold)
        for i, point in enumerate(models):
            scored = point[fold].score(scored, f"__point{i}")
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("point"), F.col(f"__point{i}").alias("score")) for i in range(len(models))]))
        parts.append(scored.select("fold", F.col(label).cast("int").alias("label"), cells.alias("cell")).select(
            "cell.point", "fold", "label", "cell.score"))
    return union_all(parts)


def seeded_share(df: DataFrame, row_id: str, share: float, seed: int) -> DataFrame:
    """Rows whose fingerprint lies below the share; larger shares hold the rows of smaller ones."""
    if share >= 1:
        return df
    # An order of its own: folds are runs of the plain seeded one.
    key = F.conv(F.substring(order_key(f"share {seed}", F.col(row_id)), 1, 13), 16, 10).cast("double")
    return df.where(key < share * 16.0 ** 13)


def successive_search(rows: DataFrame, family: Family, label: str, row_id: str, size: int = 25, folds: int = 3,
                      shares: Sequence[float] = (1.0,), keep: float = 1 / 3, seed: int = 42) -> DataFrame:
    """(rung, point, params, share, cv_mean, cv_std, survives) of the sampled points of a family.

    Each rung fits the points that are left on a larger share of the rows and keeps the best by mean
    AUC of the folds (ties: the earlier point). With one rung it is the plain search.
    """
    if family.scaled:
        scaler = standard_scale_fit(rows)
        rows = scaler.transform(rows)
    points = list(enumerate(sample_grid(family.grid, size, seed)))
    report = []
    for rung, share in enumerate(shares):
        some = materialize(seeded_share(rows, row_id, share, seed), "rung")
        models = family.fit_points(some, [p for _, p in points], list(range(folds)))
        found = {r["point"]: (r["mean"], r["std"]) for r in fold_aucs(some, models, label).groupBy("point").agg(
            F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std")).collect()}
        best = sorted(range(len(points)), key=lambda i: (-found[i][0], points[i][0]))
        left = set(best[:1 if rung + 1 == len(shares) else max(1, math.ceil(len(points) * keep))])
        report += [(rung, number, str(sorted(point.items())), float(share), *found[i], i in left) for i, (number, point) in enumerate(points)]
        points = [p for i, p in enumerate(points) if i in left]
    return rows.sparkSession.createDataFrame(
        report, "rung int, point int, params string, share double, cv_mean double, cv_std double, survives boolean")


def search_families(train: DataFrame, test: DataFrame, families: Sequence[Family], label: str, row_id: str,
                    size: int = 25, folds: int = 3, shares: Sequence[float] = (1.0,), keep: float = 1 / 3,
                    seed: int = 42) -> DataFrame:
    """Per family the best sampled point, refitted, against its untuned model on the test rows."""
    parts = []
    for family in families:
        best = successive_search(train, family, label, row_id, size, folds, shares, keep, seed).where(
            "survives").orderBy(F.desc("rung")).first()
        point = sample_grid(family.grid, size, seed)[best["point"]]
        parts.append(_tuned_row(train, test, family.name, family.spec(point), point, best["cv_mean"], family.spec(), label))
    return union_all(parts)


def scaled_pair(family: Family, train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    if not family.scaled:
        return train, test
    scaler = standard_scale_fit(train)
    return scaler.transform(train), scaler.transform(test)


def compare_families(train: DataFrame, test: DataFrame, families: Sequence[Family], label: str, folds: int = 5) -> DataFrame:
    """(model_name, cv_mean, cv_std, test_auc, status) at the usual points; models of the folds and of
    all rows are fitted together. A model that cannot be fitted is recorded, failures of jobs are raised."""
    rows = []
    for family in families:
        own, other = scaled_pair(family, train, test)
        try:
            *held, whole = family.fit_points(own, [family.untuned], [*range(folds), None])[0]
        except (ValueError, ArithmeticError, IllegalArgumentException) as error:
            rows.append((family.name, None, None, None, f"failed: {str(error)[:100]}"))
            continue
        scores = held_out_points(own, [held], label).select(F.col("fold").alias("part"), "label", "score").unionByName(
            whole.score(other, "__score").select(F.lit(-1).alias("part"), F.col(label).cast("int").alias("label"), F.col("__score").alias("score")))
        auc = {r["part"]: r["auc"] for r in roc_auc(score_curve(materialize(scores, "scores"), ("part",)), ("part",)).collect()}
        cv = [a for p, a in auc.items() if p >= 0 and a is not None]
        mean = sum(cv) / len(cv) if cv else None
        rows.append((family.name, mean, (sum((a - mean) ** 2 for a in cv) / len(cv)) ** 0.5 if cv else None, auc.get(-1), "success"))
    return train.sparkSession.createDataFrame(
        rows, "model_name string, cv_mean double, cv_std double, test_auc double, status string")


def with_predictions(model: Scorer, df: DataFrame, cut: float = 0.5) -> DataFrame:
    """Adds ``probabilities`` (of class 0 and 1) and ``prediction``."""
    scored = model.score(df, "__score")
    return scored.withColumns({
        "probabilities": F.array(1 - F.col("__score"), F.col("__score")),
        "prediction": (F.col("__score") >= cut).cast("int")}).drop("__score")


def stack_families(train: DataFrame, families: Sequence[Family], label: str, row_id: str, folds: int = 3) -> StackedModel:
    """Held-out scores of the families' usual models feed a logistic model; bases are those of all rows."""
    bases, held_out = {}, train.select(row_id, label)
    for family in families:
        own = standard_scale_fit(train).transform(train) if family.scaled else train
        *held, whole = family.fit_points(own, [family.untuned], [*range(folds), None])[0]
        name = f"base_{family.name}"
        scores = union_all([model.score(own.where(F.col("fold") == fold), name).select(row_id, name) for fold, model in enumerate(held)])
        held_out = held_out.join(scores, row_id)
        bases[name] = ScaledModel(standard_scale_fit(train), whole) if family.scaled else whole
    meta = fit_logistic(materialize(held_out, "stacking"), list(bases), label, name="stacking")
    return StackedModel(bases, meta)


@dataclass(frozen=True)
class StackedModel:
    bases: dict[str, Scorer]
    meta: Scorer

    def score(self, df: DataFrame, output: str) -> DataFrame:
        for name, model in self.bases.items():
            df = model.score(df, name)
        return self.meta.score(df, output).drop(*self.bases)


def fit_stacking(train: DataFrame, specs: Sequence[ModelSpec], label: str, row_id: str,
                 folds: int = 3) -> StackedModel:
    """Held-out scores of the base models feed a logistic model; bases are refitted on all rows."""
    quick = [s for s in specs if s.fit_folds]
    slow = [s for s in specs if not s.fit_folds]
    scored = train.withColumns({
        f"base_{s.name}": held_out_column(s.fit_folds(train, folds)) for s in quick})
    parts = []
    for fold in range(folds) if slow else []:
        fit_rows, held = train.where(F.col("fold") != fold), scored.where(F.col("fold") == fold)
        for spec in slow:
            held = fit_spec(spec, fit_rows).score(held, f"base_{spec.name}")
        parts.append(held)
    names = [f"base_{s.name}" for s in specs]
    held_out = (union_all(parts) if slow else scored).select(row_id, label, *names)
    meta = fit_logistic(materialize(held_out, "stacking"), names, label, name="stacking")
    return StackedModel({f"base_{s.name}": fit_spec(s, train) for s in specs}, meta)
