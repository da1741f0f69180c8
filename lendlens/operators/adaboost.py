"""AdaBoost (SAMME) over decision stumps.

A row's weight is an expression over the stumps so far, so nothing is written between rounds. A pass
sums the weights of both classes per feature and bin; the stump of least weighted Gini impurity is
chosen where the sums meet. Weights are summed as whole numbers of a fixed unit. Several models
(folds, points of a search) are boosted in the same passes. Up to ``WHOLE`` rows are read whole by each task instead,
and every task boosts some of the models from first to last stump, with the same sums.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lendlens.operators.bins import Bins, fit_bins
from lendlens.operators.cells import Cells, dealt_models, with_all_rows
from lendlens.operators.passes import Chunk, chunks, combined, dealt, known, packed, task_count
from lendlens.operators.score import number, sigmoid_sql
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 20)  # a row of mean weight
WHOLE = 1 << 21


@dataclass(frozen=True)
class Stump:
    """Class below and above the cut, the weight of the stump and its weighted error."""

    feature: int
    cut: int
    below: int
    above: int
    alpha: float
    error: float


@dataclass(frozen=True)
class AdaBoost:
    rounds: int = 50
    rate: float = 1.0


@dataclass
class Boosted:
    how: AdaBoost
    fold: int | None
    rows: int = 0
    stumps: list[Stump] = field(default_factory=list)
    # Logarithm of the sum of the unscaled weights, to scale them to a sum of the number of rows.
    log_total: float = 0.0
    done: bool = False

    def take(self, place: tuple[int, int, int, int], error: float) -> None:
        """Adds a stump, or ends."""
        if error <= 0:
            self.stumps.append(Stump(*place, 1.0, 0.0))
            self.done = True
        elif error >= 0.5:
            self.done = True
        else:
            alpha = self.how.rate * float(np.log((1 - error) / error))
            self.stumps.append(Stump(*place, alpha, error))
            self.log_total += float(np.log1p(error * np.expm1(alpha)))
            self.done = len(self.stumps) >= self.how.rounds


@dataclass(frozen=True)
class StumpModel:
    bins: Bins
    stumps: list[Stump]

    def decision_sql(self) -> str:
        """Share of the stump weights for class 1 less that for class 0."""
        total = sum(s.alpha for s in self.stumps)
        terms = []
        for s in self.stumps:
            name, edge = self.bins.features[s.feature], float(self.bins.edges[s.feature][s.cut]) if s.cut >= 0 else None
            below, above = ((2 * c - 1) * s.alpha / total for c in (s.below, s.above))
            terms.append(number(above) if edge is None else f"if(`{name}` <= {number(edge)}, {number(below)}, {number(above)})")
        return " + ".join(terms)

    def column_sql(self) -> str:
        return sigmoid_sql(self.decision_sql())

    def score(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(self.column_sql()))

    def table(self, spark) -> DataFrame:
        rows = [(i, self.bins.features[s.feature], float(self.bins.edges[s.feature][s.cut]) if s.cut >= 0 else None,
                 s.below, s.above, s.alpha, s.error) for i, s in enumerate(self.stumps)]
        return spark.createDataFrame(
            rows, "round int, feature string, threshold double, below int, above int, alpha double, error double")


def log_weights(codes: np.ndarray, y: np.ndarray, stumps: Sequence[Stump]) -> np.ndarray:
    found = np.zeros(len(y))
    for s in stumps:
        said = np.where(codes[:, s.feature] <= s.cut, s.below, s.above)
        found += s.alpha * (said != y)
    return found


def best_stump(sums: np.ndarray) -> tuple[int, int, int, int, float]:
    """feature, cut, class below and above, error; ``sums`` is (class, feature, bin).

    Of equal impurities the first feature, then the lowest cut; a tied side says 0. Without any cut
    the stump says one class for all (cut -1).
    """
    total = sums[:, 0].sum(1)
    left = np.cumsum(sums, 2)
    right = total[:, None, None] - left
    sides = [left.sum(0), right.sum(0)]
    pure = sum(np.where(w > 0, (part ** 2).sum(0) / np.where(w > 0, w, 1), 0) for part, w in zip((left, right), sides))
    pure = np.where((sides[0] > 0) & (sides[1] > 0), pure, -1.0)
    feature, cut = np.unravel_index(int(pure.argmax()), pure.shape)
    if pure[feature, cut] < 0:
        said = int(total[1] > total[0])
        return 0, -1, said, said, float(total[1 - said] / total.sum())
    a, b = left[:, feature, cut], right[:, feature, cut]
    below, above = int(a[1] > a[0]), int(b[1] > b[0])
    return int(feature), int(cut), below, above, float((a[1 - below] + b[1 - above]) / total.sum())


def fit_adaboost(df: DataFrame, features: Sequence[str], label: str, points: Sequence[AdaBoost] = (AdaBoost(),),
                 folds: Sequence[int | None] = (None,), max_bins: int = 255, bins: Bins | None = None) -> list[list[StumpModel]]:
    """Per point one model for each entry of ``folds``: trained on rows of other folds (None: all rows).

    Boosting ends early with a stump without error, or before one that is no better than chance.
    """
    bins = bins or fit_bins(df, features, max_bins)
    fold = F.col("fold").cast("int") if any(f is not None for f in folds) else F.lit(-1)
    rows = df.select(F.col(label).cast("int").alias("label"), fold.alias("fold"), *known(features, df))
    coded, n = rows.select("label", "fold", bins.codes().alias("codes")), df.count()
    whole = n <= WHOLE
    rows = materialize(coded if whole else dealt(coded, n, len(points) * len(folds)), "codes")
    counts = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = [Boosted(how, f, sum(n for k, n in counts.items() if f is None or k != f)) for how in points for f in folds]
    for m in models:
        m.log_total = float(np.log(max(m.rows, 1)))
    if whole:
        boost_whole(rows, models, bins)
    else:
        boost_in_passes(rows, models, bins)
    for m in models:
        if not m.stumps:
            raise ValueError("no stump is better than chance")
    fitted = [StumpModel(bins, m.stumps) for m in models]
    return [fitted[i:i + len(folds)] for i in range(0, len(fitted), len(folds))]


def boost_whole(rows: DataFrame, models: list[Boosted], bins: Bins) -> None:
    """Boosts all models in tasks that hold all rows, some models in each."""
    sizes, size = bins.sizes, bins.size
    some = [i for i, m in enumerate(models) if m.rows]
    tasks = min(len(some), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    deal = [[some[k] for k in part] for part in dealt_models([models[i].rows * models[i].how.rounds for i in some], tasks)] if some else []

    def boost(task: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        cells = Cells(sizes)
        codes = np.ascontiguousarray(chunk["codes"].reshape(-1, len(sizes)).T)
        joint, y = cells.joint(codes), chunk["label"]
        for i in deal[task]:
            m = models[i]
            use = np.flatnonzero(chunk["fold"] != m.fold) if m.fold is not None else np.arange(len(y))
            sides = [use[y[use] == k] for k in (0, 1)]
            logs = [np.zeros(len(side)) for side in sides]
            while not m.done:
                log_mean = m.log_total - np.log(m.rows)
                weights = [np.rint(np.exp(log - log_mean) * UNIT) for log in logs]
                sums = np.concatenate([cells.sums(joint, (weight,), side) for weight, side in zip(weights, sides)])
                feature, cut, below, above, error = best_stump(cells.padded(sums, size))
                before = len(m.stumps)
                m.take((feature, cut, below, above), error)
                for s in m.stumps[before:]:
                    for k, (log, side) in enumerate(zip(logs, sides)):
                        said = np.where(codes[s.feature].take(side) <= s.cut, s.below, s.above)
                        log += s.alpha * (said != k)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pickle.dumps(
                [(s.feature, s.cut, s.below, s.above, s.alpha, s.error) for s in m.stumps])], pa.binary())], names=["model", "stumps"])
    for r in with_all_rows(rows, tasks, boost, "model long, stumps binary") if some else ():
        models[r["model"]].stumps = [Stump(*values) for values in pickle.loads(r["stumps"])]


def boost_in_passes(rows: DataFrame, models: list[Boosted], bins: Bins) -> None:
    """Boosts all models by passes over the rows, wherever these are."""
    width, size, tasks = len(bins.sizes), bins.size, task_count(rows)
    while plans := [(i, m.fold, m.stumps, m.log_total - np.log(m.rows)) for i, m in enumerate(models) if not m.done and m.rows]:
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = Cells(bins.sizes)
            totals = np.zeros((len(plans), 2, cells.total))
            for chunk in chunks(batches, {"codes": width}):
                joint = cells.joint(chunk["codes"].T)
                for total, (_, left_out, stumps, log_mean) in zip(totals, plans):
                    use = np.flatnonzero(chunk["fold"] != left_out) if left_out is not None else np.arange(len(chunk["fold"]))
                    codes, y = chunk["codes"][use], chunk["label"][use]
                    weight = np.rint(np.exp(log_weights(codes, y, stumps) - log_mean) * UNIT)
                    for k in (0, 1):
                        total[k] += cells.sums(joint, (weight[y == k],), use[y == k])[0]
            yield packed([p[0] for p in plans], list(cells.padded(totals.reshape(-1, cells.total), size).reshape(len(plans), -1).astype(np.int64)), True)

        def choose(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
            found = [(key, *best_stump(numbers.reshape(2, width, size).astype(np.float64))) for key, numbers in held.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["model", "feature", "cut", "below", "above", "error"])
        schema = "model long, feature long, cut long, below long, above long, error double"
        for r in combined(rows, sums, True, choose, schema, tasks=tasks).collect():
            models[r["model"]].take((r["feature"], r["cut"], r["below"], r["above"]), r["error"])
