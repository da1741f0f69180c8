"""Logistic models with lasso and ridge penalties by proximal Newton steps.

A pass sums the gradient and the matrix of second derivatives of every model over the rows; the
penalised quadratic is then minimised on the driver, whose size is the square of the number of
features. Models of several folds and points of a search share the passes, about ten in all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lendlens.operators.passes import chunks, combined, dealt, known, packed, task_count
from lendlens.operators.score import LinearModel
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 1 << 12  # rows whose products stay in the processor's cache


@dataclass(frozen=True)
class Penalty:
    """``strength`` is the inverse penalty on the summed loss; ``l1_ratio`` the lasso's share of it."""

    strength: float = 1.0
    l1_ratio: float = 0.0
    max_iter: int = 50
    tol: float = 1e-8


@dataclass
class Fitted:
    how: Penalty
    fold: int | None
    rows: float
    weights: np.ndarray  # the intercept last
    move: np.ndarray  # from the last weights that were taken
    value: float = np.inf
    violation: float = np.inf
    steps: int = 0
    share: float = 1.0
    done: bool = False
    curve: tuple | None = None

    def penalty(self, weights: np.ndarray) -> float:
        w = weights[:-1]
        return (self.how.l1_ratio * np.abs(w).sum() + (1 - self.how.l1_ratio) / 2 * (w ** 2).sum()) / self.how.strength

    def observe(self, loss: float, slope: np.ndarray) -> bool:
        """Takes the weights if they lower the objective, else goes half the way back; whether to move on from them."""
        value = loss + self.penalty(self.weights)
        if value > self.value + 1e-10 * abs(self.value) and self.share > 1e-6:
            self.share /= 2
            self.weights = self.weights - self.move * self.share  # from here to the half of the last move
            return False
        self.value, self.share = value, 1.0
        self.violation = self.unmet(slope)
        self.steps += 1
        self.done = self.violation <= self.how.tol * self.rows or self.steps >= self.how.max_iter
        return not self.done

    def go(self, after: np.ndarray) -> None:
        self.move = after - self.weights
        self.weights = after
        if np.abs(self.move).max() < 1e-13:
            self.done = True

    def unmet(self, slope: np.ndarray) -> float:
        """By how much the conditions of a minimum are missed, at the worst weight."""
        lasso = self.how.l1_ratio / self.how.strength
        w = self.weights[:-1]
        g = slope[:-1] + (1 - self.how.l1_ratio) / self.how.strength * w
        missed = np.where(w != 0, np.abs(g + lasso * np.sign(w)), np.maximum(np.abs(g) - lasso, 0))
        return float(max(missed.max(initial=0), abs(slope[-1])))


def minimised(models: Sequence[Fitted], slopes: Sequence[np.ndarray], seconds: Sequence[np.ndarray]) -> np.ndarray:
    """Coordinate descent on the quadratics with their penalties, of all models side by side."""
    strength, share = (np.array([getattr(m.how, k) for m in models]) for k in ("strength", "l1_ratio"))
    lasso, ridge = share / strength, (1 - share) / strength
    w, g, second = np.stack([m.weights for m in models]), np.stack(slopes), np.stack(seconds)
    diagonal = np.maximum(np.diagonal(second, axis1=1, axis2=2), 1e-12)
    close = np.array([1e-11 * max(1.0, m.rows ** 0.5) for m in models])
    left = np.arange(len(models))
    width = w.shape[1]
    for _ in range(500):
        some, slope, curve, scale = w[left], g[left], second[left], diagonal[left]
        largest = np.zeros(len(left))
        for j in range(width):
            d = scale[:, j]
            if j == width - 1:
                after = some[:, j] - slope[:, j] / d
            else:
                pull = d * some[:, j] - slope[:, j]
                after = np.sign(pull) * np.maximum(np.abs(pull) - lasso[left], 0.0) / (d + ridge[left])
            change = after - some[:, j]
            slope += curve[:, :, j] * change[:, None]
            some[:, j] = after
            largest = np.maximum(largest, np.abs(change) * d ** 0.5)
        w[left], g[left] = some, slope
        left = left[~(largest < close[left])]
        if not len(left):
            break
    return w


def fit_penalised(df: DataFrame, features: Sequence[str], label: str, points: Sequence[Penalty] = (Penalty(),),
                  folds: Sequence[int | None] = (None,), name: str = "logistic") -> list[list[LinearModel]]:
    """Per point one model for each entry of ``folds``: trained on rows of other folds (None: all rows)."""
    return [[LinearModel(name, float(m.weights[-1]), dict(zip(features, map(float, m.weights[:-1])))) for m in group]
            for group in penalised(df, features, label, points, folds)]


def add_sums(total: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> None:
    """Adds loss, gradient and second derivatives of some rows at weights ``w``."""
    z, width = x @ w, x.shape[1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    total[0] += (np.logaddexp(0, z) - y * z).sum()
    total[1:width + 1] += x.T @ (p - y)
    total[width + 1:] += (x.T @ (x * (p * (1 - p))[:, None])).ravel()


def penalised(df: DataFrame, features: Sequence[str], label: str, points: Sequence[Penalty],
              folds: Sequence[int | None] = (None,)) -> list[list[Fitted]]:
    fold = F.col("fold").cast("int") if any(f is not None for f in folds) else F.lit(-1)
    rows = df.select(F.col(label).cast("double").alias("label"), fold.alias("fold"), *known(features, df))
    rows = materialize(dealt(rows.select("label", "fold", F.array(*features).alias("x")), df.count(), len(points) * len(folds)), "rows")
    tasks = task_count(rows)
    counts = {r["fold"]: (r["n"], r["bad"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).collect()}
    width = len(features)
    models = []
    for how in points:
        for left_out in folds:
            n, bad = (sum(c[k] for f, c in counts.items() if left_out is None or f != left_out) for k in (0, 1))
            if not 0 < bad < n:
                raise ValueError("both classes are needed")
            start = np.append(np.zeros(width), np.log(bad / (n - bad)))
            models.append(Fitted(how, left_out, float(n), start, np.zeros(width + 1)))
    while open_ := [m for m in models if not m.done]:
        # Models at the same weights on the same rows, such as points that end at other tolerances, share their sums.
        alike: dict[tuple, list[Fitted]] = {}
        for m in open_:
            alike.setdefault((m.fold, m.weights.tobytes()), []).append(m)
        plans = [(group[0].weights.copy(), group[0].fold) for group in alike.values()]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals = np.zeros((len(plans), 1 + (width + 1) * (width + 2)))
            for chunk in chunks(batches, {"x": width}):
                for low in range(0, len(chunk["label"]), BLOCK_ROWS):
                    block = slice(low, low + BLOCK_ROWS)
                    order = np.argsort(chunk["fold"][block], kind="stable")
                    part, y = chunk["fold"][block][order], chunk["label"][block][order]
                    x = np.hstack([chunk["x"][block][order], np.ones((len(y), 1))])
                    for total, (w, left_out) in zip(totals, plans):
                        out = np.searchsorted(part, [left_out, left_out + 1]) if left_out is not None else [0, 0]
                        for use in (slice(0, out[0]), slice(out[1], len(y))):
                            if use.start < use.stop:
                                add_sums(total, x[use], y[use], w)
            yield packed(range(len(plans)), list(totals), False)
        groups, moving = list(alike.values()), []
        for r in combined(rows, sums, False, tasks=tasks).collect():
            numbers = np.array(r["numbers"])
            slope, second = numbers[1:width + 2], numbers[width + 2:].reshape(width + 1, width + 1)
            moving += [(m, slope, second) for m in groups[r["key"]] if m.observe(numbers[0], slope)]
        if moving:
            for (m, *_), after in zip(moving, minimised(*zip(*moving))):
                m.go(after)
    return [models[i:i + len(folds)] for i in range(0, len(models), len(folds))]
