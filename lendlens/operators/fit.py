"""Distributed model fitting: ridge, logistic, trees, naive Bayes, bagging, nearest neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.hashing import order_key
from lendlens.operators.matrix import assemble
from lendlens.operators.profile import column_means, gram_partials
from lendlens.operators.score import LinearModel, number, row_mean, sigmoid_sql
from lendlens.operators.split import stratified_subsample
from lendlens.session import materialize

NEIGHBOUR_ROWS = 15_000
BLOCK_ROWS = 128


class Scorer(Protocol):
    """What every fitted model offers: a score column, higher meaning riskier."""

    def score(self, df: DataFrame, output: str) -> DataFrame: ...


# Ridge ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class GramSums:
    """Shifted sums of products of features and signed target, small enough for the driver."""

    columns: list[str]
    shifts: np.ndarray
    counts: dict[int, float]
    sums: dict[int, np.ndarray]
    products: dict[int, np.ndarray]

    def solve(self, name: str, alpha: float, parts: Sequence[int] | None = None,
              fit_intercept: bool = True, scaled: Sequence[str] = ()) -> LinearModel:
        """Normal equations of the penalised squares over the chosen parts.

        ``scaled`` features are standardised first; the weights returned fit the raw values.
        """
        chosen = [p for p in (self.counts if parts is None else parts) if p in self.counts]
        n = sum(self.counts[p] for p in chosen)
        total = sum(self.sums[p] for p in chosen)
        means = total / n + self.shifts
        centre = sum(self.products[p] for p in chosen) - np.outer(total, total) / n
        width = len(self.columns) - 1
        standard = np.array([c in scaled for c in self.columns[:width]] + [False])
        spread = np.sqrt(np.maximum(np.diag(centre) / n, 0.0))
        spread = np.where(standard & (spread > 0), spread, 1.0)
        if not fit_intercept:
            # Products about the origin of each column: its mean if standardised, else zero.
            away = np.where(standard, 0.0, means)
            centre = centre + n * np.outer(away, away)
        square = centre / np.outer(spread, spread)
        weights = np.linalg.solve(
            square[:width, :width] + alpha * np.eye(width), square[:width, width]) / spread[:width]
        if fit_intercept:
            intercept = means[width] - weights @ means[:width]
        else:
            intercept = -(weights @ np.where(standard, means, 0.0)[:width])
        return LinearModel(name, float(intercept), dict(zip(self.columns[:width], map(float, weights))))

    def held_out(self, name: str, alpha: float, folds: int, fit_intercept: bool = True,
                 scaled: Sequence[str] = ()) -> list[LinearModel]:
        """Per fold the model of all other folds, without another pass over the rows."""
        return [self.solve(name, alpha, [f for f in range(folds) if f != fold], fit_intercept, scaled)
                for fold in range(folds)]


def gram_sums(df: DataFrame, features: Sequence[str], label: str, part: str | None = None) -> GramSums:
    """One pass for the means and one for the products; a null feature fails, as in the other fits."""
    columns = [*features, "__target"]
    rows = df.withColumn("__target", F.when(F.col(label).cast("int") == 1, 1.0).otherwise(-1.0))
    known = [F.coalesce(F.col(c), F.raise_error(F.lit(f"{c} is null")).cast(rows.schema[c].dataType)).alias(c) for c in features]
    rows = rows.select(*known, "__target", *[part] * bool(part))
    shifts = column_means(rows, columns)
    width = len(columns)
    counts, sums, products = {}, {}, {}
    for r in gram_partials(rows, columns, shifts, part).collect():
        g, i, j = r["part"], r["i"], r["j"]
        counts[g] = r["n"]
        total = sums.setdefault(g, np.zeros(width))
        product = products.setdefault(g, np.zeros((width, width)))
        total[i], total[j] = r["si"], r["sj"]
        product[i, j] = product[j, i] = r["sij"]
    return GramSums(columns, np.asarray(shifts), counts, sums, products)


def fit_ridge(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1000.0,
              fit_intercept: bool = True, scaled: Sequence[str] = (), name: str = "ridge") -> LinearModel:
    """Least squares on a +1/-1 target with an unpenalised intercept."""
    return gram_sums(df, features, label).solve(name, alpha, None, fit_intercept, scaled)


def ridge_folds(df: DataFrame, features: Sequence[str], label: str, folds: int, alpha: float = 1000.0,
                scaled: Sequence[str] = ()) -> list[LinearModel]:
    return gram_sums(df, features, label, "fold").held_out("ridge", alpha, folds, scaled=scaled)


# Logistic ------------------------------------------------------------------------------------


def fit_logistic(df: DataFrame, features: Sequence[str], label: str, penalty: str = "l2",
                 strength: float = 1.0, l1_ratio: float = 0.5, max_iter: int = 100,
                 tolerance: float = 1e-6, name: str = "logistic") -> LinearModel:
    """Logistic regression; ``strength`` is the inverse penalty on the summed loss."""
    rows = assemble(df.withColumn("__label", F.col(label).cast("double")), features, ["__label"])
    share = {"l1": 1.0, "l2": 0.0, "elasticnet": l1_ratio}[penalty]
    n = df.count()
    model = LogisticRegression(
        featuresCol="features", labelCol="__label", regParam=1.0 / (strength * n),
        elasticNetParam=share, standardization=False, maxIter=max_iter, tol=tolerance,
    ).fit(rows)
    weights = dict(zip(features, map(float, model.coefficients.toArray())))
    return LinearModel(name, float(model.intercept), weights)


# Trees ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorModel:
    """A fitted MLlib classifier with the features it was fitted on."""

    features: list[str]
    model: object

    def score(self, df: DataFrame, output: str) -> DataFrame:
        vectored = assemble(df, self.features, df.columns, "__vector")
        scored = self.model.transform(vectored)
        return scored.withColumn(output, vector_to_array("probability")[1]).drop(
            "__vector", "rawPrediction", "probability", "prediction")


def _vector_fit(estimator, df: DataFrame, features: Sequence[str], label: str,
                weight: str | None = None) -> VectorModel:
    rows = df.withColumn("__label", F.col(label).cast("double"))
    keep = ["__label", *[weight] * bool(weight)]
    return VectorModel(list(features), estimator.fit(assemble(rows, features, keep, "__vector")))


def fit_random_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 100,
                      depth: int = 5, seed: int = 42) -> VectorModel:
    return _vector_fit(RandomForestClassifier(
        featuresCol="__vector", labelCol="__label", numTrees=trees, maxDepth=depth, seed=seed),
        df, features, label)


def fit_gbt(df: DataFrame, features: Sequence[str], label: str, rounds: int = 100, depth: int = 3,
            rate: float = 0.1, subsample: float = 1.0, seed: int = 42) -> VectorModel:
    return _vector_fit(GBTClassifier(
        featuresCol="__vector", labelCol="__label", maxIter=rounds, maxDepth=depth, stepSize=rate,
        subsamplingRate=subsample, seed=seed), df, features, label)


# Naive Bayes ---------------------------------------------------------------------------------


def bernoulli_nb_table(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0,
                       binarize: float = 0.0) -> DataFrame:
    """(feature, class, positives, log_probability, log_complement, log_prior) from grouped counts."""
    rows = df.select(F.col(label).cast("int").alias("class"), *[
        (F.col(f) > binarize).cast("int").alias(f) for f in features])
    counts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("rows"), F.array(*[
        F.struct(F.lit(f).alias("feature"), F.sum(f).alias("positives")) for f in features
    ]).alias("cells"))
    share = (F.col("positives") + F.lit(alpha)) / (F.col("rows") + F.lit(2 * alpha))
    total = df.count()
    return counts.select("class", "rows", F.explode("cells").alias("cell")).select(
        "cell.feature", "class", "rows", "cell.positives").select(
        "feature", "class", "positives", F.log(share).alias("log_probability"),
        F.log(F.lit(1.0) - share).alias("log_complement"),
        F.log(F.col("rows") / F.lit(float(total))).alias("log_prior"))


@dataclass(frozen=True)
class BernoulliModel:
    """The log odds are linear in the binarised features."""

    linear: LinearModel
    binarize: float

    def column_sql(self) -> str:
        terms = [f"{number(w)} * CAST(`{f}` > {number(self.binarize)} AS double)"
                 for f, w in self.linear.weights.items()]
        return sigmoid_sql(" + ".join([number(self.linear.intercept), *terms]))

    def score(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(self.column_sql()))


def _bernoulli_counts(df: DataFrame, features: Sequence[str], label: str, binarize: float,
                      part: str | None = None) -> dict[tuple[int, int], np.ndarray]:
    """Per part and class the rows and the positives of each feature, from one grouping."""
    number = F.col(part).cast("int") if part else F.lit(0)
    flags = [F.sum((F.col(f) > binarize).cast("long")).alias(f"c{i}") for i, f in enumerate(features)]
    grouped = df.groupBy(number.alias("part"), F.col(label).cast("int").alias("class")).agg(
        F.count(F.lit(1)).alias("rows"), *flags)
    return {(r["part"], r["class"]): np.array(r[2:], dtype="float64") for r in grouped.collect()}


def _bernoulli_model(good: np.ndarray, bad: np.ndarray, features: Sequence[str], alpha: float,
                     binarize: float, fit_prior: bool) -> BernoulliModel:
    if not (good[0] and bad[0]):
        raise ValueError("both classes are needed")
    on_good, on_bad = [(c[1:] + alpha) / (c[0] + 2 * alpha) for c in (good, bad)]
    base = np.log1p(-on_bad) - np.log1p(-on_good)
    weights = np.log(on_bad) - np.log(on_good) - base
    prior = np.log(bad[0] / good[0]) if fit_prior else 0.0
    linear = LinearModel("bernoulli_nb", float(prior + base.sum()), dict(zip(features, map(float, weights))))
    return BernoulliModel(linear, binarize)


def fit_bernoulli_nb(df: DataFrame, features: Sequence[str], label: str, alpha: float = 1.0,
                     binarize: float = 0.0, fit_prior: bool = True) -> BernoulliModel:
    return bernoulli_folds(df, features, label, None, alpha, binarize, fit_prior)[0]


def bernoulli_folds(df: DataFrame, features: Sequence[str], label: str, folds: int | None,
                    alpha: float = 1.0, binarize: float = 0.0, fit_prior: bool = True,
                    counted: dict | None = None) -> list[BernoulliModel]:
    """Per fold the model of all other folds from one pass; without folds, the one of all rows.

    ``counted`` keeps the counts per cut, so that points of a search that share a cut on the same
    rows share the pass.
    """
    counted = {} if counted is None else counted
    if binarize not in counted:
        counted[binarize] = _bernoulli_counts(df, features, label, binarize, "fold" if folds else None)
    counts = counted[binarize]
    nothing = np.zeros(len(features) + 1)

    def rows_of(label_value: int, left_out: int | None) -> np.ndarray:
        return sum((c for (p, k), c in counts.items() if k == label_value and p != left_out), nothing)

    return [_bernoulli_model(rows_of(0, fold), rows_of(1, fold), features, alpha, binarize, fit_prior)
            for fold in (range(folds) if folds else [None])]


# Bagging -------------------------------------------------------------------------------------

def poisson_steps() -> list[float]:
    """Cumulative probabilities of a Poisson variable with mean 1, as far as a double tells them from 1."""
    term = total = math.exp(-1)
    steps = [total]
    while total + term / len(steps) < 1 - 2.0 ** -52 and len(steps) < 25:
        term /= len(steps)
        total += term
        steps.append(total)
    return steps


POISSON_STEPS = poisson_steps()


def uniform_draw(row_id: str, seed: int) -> Column:
    """A number from 0 to 1 from the row's fingerprint."""
    key = F.conv(F.substring(order_key(seed, F.col(row_id)), 1, 13), 16, 10).cast("double")
    return key / F.lit(float(16 ** 13))


def poisson_count(uniform: Column) -> Column:
    """The Poisson variable of a uniform one; best given a column by name, as it stands in every step."""
    weight = F.lit(len(POISSON_STEPS))
    for i, limit in reversed(list(enumerate(POISSON_STEPS))):
        weight = F.when(uniform < limit, F.lit(i)).otherwise(weight)
    return weight.cast("double")


def poisson_weight(row_id: str, seed: int) -> Column:
    """How often a bootstrap sample would draw the row, from its fingerprint."""
    return poisson_count(uniform_draw(row_id, seed))


@dataclass(frozen=True)
class MeanModel:
    """Mean score of several models."""

    models: list[Scorer]

    def score(self, df: DataFrame, output: str) -> DataFrame:
        names = [f"__bag{i}" for i in range(len(self.models))]
        for model, name in zip(self.models, names):
            df = model.score(df, name)
        return df.withColumn(output, row_mean(names)).drop(*names)


def fit_bagging(df: DataFrame, features: Sequence[str], label: str, row_id: str, bags: int = 10,
                depth: int = 5, seed: int = 42) -> MeanModel:
    """Trees on bootstrap weights; no rows are copied.

    A tree reads its rows in several passes, so the weights of all bags are worked out and written once.
    """
    models = []
    drawn = df.select(label, *features, *[uniform_draw(row_id, seed * 1000 + bag).alias(f"__weight{bag}") for bag in range(bags)])
    weights = [poisson_count(F.col(f"__weight{bag}")).cast("byte").alias(f"__weight{bag}") for bag in range(bags)]
    rows = materialize(drawn.select(label, *features, *weights), "bags")
    for bag in range(bags):
        weighted = rows.withColumn("__weight", F.col(f"__weight{bag}").cast("double")).where("__weight > 0")
        tree = DecisionTreeClassifier(
            featuresCol="__vector", labelCol="__label", weightCol="__weight", maxDepth=depth, seed=seed)
        models.append(_vector_fit(tree, weighted, features, label, "__weight"))
    return MeanModel(models)


# Nearest neighbours --------------------------------------------------------------------------


@dataclass(frozen=True)
class NeighbourModel:
    """At most ``NEIGHBOUR_ROWS`` labelled rows, held by every task."""

    features: list[str]
    points: np.ndarray
    labels: np.ndarray
    k: int
    by_distance: bool

    def score(self, df: DataFrame, output: str) -> DataFrame:
        spark = df.sparkSession
        shared = spark.sparkContext.broadcast((self.points, self.labels))
        vote = _voter(self.k, self.by_distance)

        @F.pandas_udf("double")
        def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            points, labels = shared.value
            for frame in frames:
                rows = frame.to_numpy("float64")
                blocks = [vote(rows[i:i + BLOCK_ROWS], points, labels)
                          for i in range(0, len(rows), BLOCK_ROWS)]
                yield pd.Series(np.concatenate(blocks) if blocks else np.empty(0))

        return df.withColumn(output, neighbours(F.struct(*self.features)))


def _voter(k: int, by_distance: bool):
    """The vote as a closure, so that it travels to the tasks by value."""

    def vote(block: np.ndarray, points: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Mean label of the k nearest; equal distances go to the earlier point.

        A matrix product finds the candidates with a margin for its rounding; the
        distances that count are taken exactly, for the candidates only.
        """
        near = min(k, len(points))
        sizes = (block ** 2).sum(axis=1)[:, None] + (points ** 2).sum(axis=1)[None, :]
        rough = sizes - 2.0 * (block @ points.T)
        limit = np.partition(rough, near - 1, axis=1)[:, near - 1]
        inside = rough <= (limit + 1e-9 * sizes.max(axis=1))[:, None]
        row, point = np.nonzero(inside)
        exact = np.sqrt(((points[point] - block[row]) ** 2).sum(axis=1))
        order = np.lexsort((point, exact, row))
        first = np.searchsorted(row, np.arange(len(block)))
        chosen = order[first[:, None] + np.arange(near)]
        nearest, distances = labels[point[chosen]], exact[chosen]
        if not by_distance:
            return nearest.mean(axis=1)
        same = distances == 0
        weights = np.where(same.any(axis=1)[:, None], same, 1.0 / np.where(same, 1.0, distances))
        return (nearest * weights).sum(axis=1) / weights.sum(axis=1)

    return vote


def fit_neighbours(df: DataFrame, features: Sequence[str], label: str, row_id: str, k: int = 5,
                   by_distance: bool = False, max_rows: int = NEIGHBOUR_ROWS, seed: int = 42) -> NeighbourModel:
    """The sample size is part of the method; it bounds what is sent to the tasks."""
    sample = stratified_subsample(df.select(row_id, label, *features), max_rows, label, row_id, seed)
    frame = sample.orderBy(row_id).toPandas()
    return NeighbourModel(
        list(features), frame[list(features)].to_numpy("float64"),
        frame[label].to_numpy().astype("float64"), k, by_distance)
