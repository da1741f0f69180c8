"""Linear models by mini-batch gradients, and a kernel classifier on random Fourier features.

Rows are dealt to batches by a seeded fingerprint and written batch by batch; a step reads one batch,
sums the gradients of all models in the tasks and adds them on executors. Several models (folds,
points of a search) take their steps in the same passes.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.hashing import order_key
from lendlens.operators.bins import score_column
from lendlens.operators.passes import ROWS_PER_TASK, chunks, combined, known, packed, task_count
from lendlens.operators.score import LinearModel
from lendlens.session import materialize, new_folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BATCHES = 16
POWER = 0.5
# Numbers of a block of rows that is worked on at a time, small enough for a core's cache.
BLOCK_CELLS = 1 << 18


@dataclass(frozen=True)
class Descent:
    """``loss`` log or hinge; ``alpha`` the squared penalty; ``schedule`` constant, optimal or invscaling.

    Ends when the mean loss of an epoch has not fallen by ``tol`` below the best for ``patience`` epochs.
    """

    loss: str = "log"
    alpha: float = 1e-4
    schedule: str = "optimal"
    eta0: float = 0.01
    max_iter: int = 1000
    tol: float = 1e-3
    patience: int = 5
    average: bool = False

    def step(self, seen: float) -> float:
        """Length of the step after ``seen`` rows."""
        if self.schedule == "constant":
            return self.eta0
        if self.schedule == "invscaling":
            return self.eta0 / max(seen, 1.0) ** POWER
        if self.schedule != "optimal":
            raise ValueError(f"unknown schedule {self.schedule}")
        typical = (1.0 / self.alpha ** 0.5) ** 0.5
        return 1.0 / (self.alpha * (1.0 / (typical * self.alpha) + seen))


def losses(margin: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row and its slope in the margin; y is +1 or -1."""
    z = y * margin
    if loss == "log":
        return np.logaddexp(0, -z), -y / (1 + np.exp(np.clip(z, -500, 500)))
    if loss == "hinge":
        return np.maximum(0, 1 - z), np.where(z < 1, -y, 0.0)
    raise ValueError(f"unknown loss {loss}")


@dataclass
class Walk:
    """One model on its way: weights with the intercept last."""

    how: Descent
    fold: int | None
    weights: np.ndarray
    mean: np.ndarray
    seen: float = 0.0
    steps: int = 0
    best: float = float("inf")
    idle: int = 0
    epochs: int = 0
    done: bool = False
    loss: float = 0.0
    rows: float = 0.0

    def take(self, slope: np.ndarray, loss: float, rows: float) -> None:
        """A step against the mean gradient of a batch."""
        self.loss, self.rows = self.loss + loss, self.rows + rows
        eta = self.how.step(self.seen)
        self.weights[:-1] *= max(0.0, 1.0 - eta * self.how.alpha)
        self.weights -= eta * slope / rows
        self.seen += rows
        self.steps += 1
        self.mean += (self.weights - self.mean) / self.steps

    def end_epoch(self) -> None:
        now = self.loss / max(self.rows, 1.0)
        self.idle = self.idle + 1 if now > self.best - self.how.tol else 0
        self.best = min(self.best, now)
        self.epochs, self.loss, self.rows = self.epochs + 1, 0.0, 0.0
        self.done = self.idle >= self.how.patience or self.epochs >= self.how.max_iter


def batch_order(seed: int, epoch: int, batches: int) -> list[int]:
    return np.random.default_rng((seed, epoch)).permutation(batches).tolist()


def in_batches(df: DataFrame, features: Sequence[str], label: str, row_id: str, batches: int, seed: int,
               fold: str | None, file_rows: int = ROWS_PER_TASK) -> DataFrame:
    """(batch, y, fold, x), written by batch, so that a step reads no other.

    A batch is dealt to files of about ``file_rows`` rows, or a few for each core: a file is read by one task.
    """
    def digits(first: int) -> Column:
        return F.conv(F.substring(order_key(seed, F.col(row_id)), first, 8), 16, 10).cast("long")
    files = min(-(-df.count() // (batches * file_rows)), 4 * df.sparkSession.sparkContext.defaultParallelism)
    number = F.pmod(digits(1), F.lit(batches)).cast("int")
    part = F.pmod(digits(9), F.lit(max(files, 1)))
    rows = df.select(F.col(row_id), F.col(label).cast("int").alias("label"), (F.col(fold).cast("int") if fold else F.lit(-1)).alias("fold"),
                     *known(features, df))
    rows = rows.select(F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y"), "fold", F.array(*features).alias("x"), number.alias("batch"), part.alias("__file"))
    folder = new_folder(df.sparkSession, "batches")
    dealt = rows.repartition(batches * max(files, 1), "batch", "__file").drop("__file")
    dealt.write.partitionBy("batch").parquet(folder)
    return df.sparkSession.read.schema(dealt.schema).parquet(folder)


def descend(df: DataFrame, features: Sequence[str], label: str, row_id: str, points: Sequence[Descent],
            folds: Sequence[int | None] = (None,), batches: int = BATCHES, seed: int = 42,
            project: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None,
            fold: str = "fold") -> list[list[Walk]]:
    """Per point one walk for each entry of ``folds``: over the rows of other folds (None: all rows).

    ``project`` maps the features to ``width`` others inside the tasks.
    """
    named = any(f is not None for f in folds)
    size = (width or len(features)) + 1
    rows = in_batches(df, features, label, row_id, batches, seed, fold if named else None, ROWS_PER_TASK // (4 if project else 1))
    block = max(1, BLOCK_CELLS // size)
    walks = [Walk(how, f, np.zeros(size), np.zeros(size)) for how in points for f in folds]
    wide, epoch = len(features), 0
    tasks = max(task_count(rows.where(F.col("batch") == b)) for b in range(batches))
    while any(not w.done for w in walks):
        for batch in batch_order(seed, epoch, batches):
            plans = [(i, w.weights.copy(), w.how.loss, w.fold) for i, w in enumerate(walks) if not w.done]

            def slopes(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(plans), size + 2))
                weights, shifts = np.stack([p[1][:-1] for p in plans], 1), np.array([p[1][-1] for p in plans])
                for chunk in chunks(parts, {"x": wide}):
                    for at in range(0, len(chunk["y"]), block):
                        x, y, own = (chunk[name][at:at + block] for name in ("x", "y", "fold"))
                        x = project(x) if project else x
                        margins = x @ weights + shifts
                        for out, margin, (_, _, kind, left_out) in zip(total, margins.T, plans):
                            value, slope = losses(margin, y, kind)
                            use = (own != left_out) if left_out is not None else np.ones(len(slope), bool)
                            slope = np.where(use, slope, 0.0)
                            out += np.concatenate([slope @ x, [slope.sum(), value[use].sum(), use.sum()]])
                yield packed([0], [total], False)
            found = combined(rows.where(F.col("batch") == batch).select("y", "fold", "x"), slopes, False, tasks=tasks).collect()
            for out, (i, *_) in zip(np.array(found[0]["numbers"]).reshape(len(plans), -1) if found else [], plans):
                if out[-1] > 0:
                    walks[i].take(out[:-2], out[-2], out[-1])
        for w in walks:
            if not w.done:
                w.end_epoch()
        epoch += 1
    return [walks[i:i + len(folds)] for i in range(0, len(walks), len(folds))]


def fit_sgd(df: DataFrame, features: Sequence[str], label: str, row_id: str, points: Sequence[Descent] = (Descent(),),
            folds: Sequence[int | None] = (None,), batches: int = BATCHES, seed: int = 42) -> list[list[LinearModel]]:
    """Logistic models of standardised features by mini-batch steps."""
    def model(w: Walk) -> LinearModel:
        weights = w.mean if w.how.average else w.weights
        return LinearModel("sgd", float(weights[-1]), dict(zip(features, map(float, weights[:-1]))), w.how.loss == "log")
    return [[model(w) for w in walks] for walks in descend(df, features, label, row_id, points, folds, batches, seed)]


# Kernel classifier ---------------------------------------------------------------------------


@dataclass(frozen=True)
class FourierMap:
    """Random features whose products approach the Gaussian kernel exp(-gamma |x - y|^2)."""

    turns: np.ndarray
    phases: np.ndarray

    @staticmethod
    def drawn(width: int, components: int, gamma: float, seed: int) -> FourierMap:
        rng = np.random.default_rng(seed)
        return FourierMap(rng.normal(size=(width, components)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, components))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        found = x @ self.turns
        found += self.phases
        np.cos(found, out=found)
        found *= np.sqrt(2 / len(self.phases))
        return found


@dataclass(frozen=True)
class KernelModel:
    features: list[str]
    kernel: FourierMap
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def decisions(self, x: np.ndarray) -> np.ndarray:
        block = max(1, BLOCK_CELLS // len(self.weights))
        found = [self.kernel(x[at:at + block]) @ self.weights[:-1] + self.weights[-1] for at in range(0, len(x), block)]
        return np.concatenate([np.zeros(0), *found])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.decisions(x) + self.shift, -500, 500)))

    def score(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, score_column(self.features, self))


def scale_gamma(df: DataFrame, features: Sequence[str]) -> float:
    """One over the number of features times the variance of all their values."""
    sums = df.agg(*[f for c in features for f in (F.avg(F.col(c)).alias(f"{c}__1"), F.avg(F.col(c) * F.col(c)).alias(f"{c}__2"))]).first()
    mean = float(np.mean([sums[f"{c}__1"] for c in features]))
    variance = float(np.mean([sums[f"{c}__2"] for c in features])) - mean ** 2
    return 1.0 / (len(features) * variance) if variance > 0 else 1.0


def fit_sigmoid(scores: DataFrame, decision: str, label: str, most: int = 50) -> tuple[float, float]:
    """Slope and shift of P(1) = 1 / (1 + exp(-(slope x + shift))) by Newton steps on sums over all rows.

    Targets are drawn in from 0 and 1 by one row, so that clear cases keep them finite.
    """
    counts = scores.agg(F.sum(F.col(label).cast("int")).alias("bad"), F.count(F.lit(1)).alias("n")).first()
    bad, good = counts["bad"] or 0, counts["n"] - (counts["bad"] or 0)
    target = F.when(F.col(label).cast("int") == 1, (bad + 1.0) / (bad + 2.0)).otherwise(1.0 / (good + 2.0))
    x = F.col(decision)
    slope, shift = 0.0, float(np.log((bad + 1.0) / (good + 1.0)))

    def sums(slope: float, shift: float):
        z = x * slope + shift
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        loss = F.sum(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - target * z)
        return scores.agg(loss.alias("loss"), F.sum((p - target) * x).alias("a"), F.sum(p - target).alias("b"),
                          F.sum(w * x * x).alias("aa"), F.sum(w * x).alias("ab"), F.sum(w).alias("bb")).first()
    now = sums(slope, shift)
    for _ in range(most):
        curve = np.array([[now["aa"], now["ab"]], [now["ab"], now["bb"]]]) + 1e-12 * np.eye(2)
        move = np.linalg.solve(curve, [now["a"], now["b"]])
        if abs(move).max() < 1e-9:
            break
        step = 1.0
        while step > 1e-10:
            then = sums(slope - step * move[0], shift - step * move[1])
            if then["loss"] <= now["loss"] + 1e-12:
                break
            step /= 2
        slope, shift, fallen, now = slope - step * move[0], shift - step * move[1], now["loss"] - then["loss"], then
        if fallen <= 1e-10 * max(1.0, now["loss"]):
            break
    return float(slope), float(shift)


def fit_kernel_svm(df: DataFrame, features: Sequence[str], label: str, row_id: str, components: int = 256,
                   gamma: float | None = None, c: float = 1.0, folds: int = 3, max_iter: int = 30, tol: float = 1e-4,
                   batches: int = 8, seed: int = 42) -> KernelModel:
    """Margin classifier on random features of standardised features, with probabilities.

    The sigmoid is fitted to decisions of rows by models that did not see them.
    """
    rows = materialize(df.select(row_id, label, *features, F.pmod(F.xxhash64(F.col(row_id), F.lit(seed)), F.lit(folds)).cast("int").alias("__part")), "kernel")
    kernel = FourierMap.drawn(len(features), components, gamma or scale_gamma(rows, features), seed)
    how = Descent("hinge", 1.0 / (c * rows.count()), "optimal", max_iter=max_iter, tol=tol, average=True)
    whole, *parts = descend(rows, features, label, row_id, [how], [None, *range(folds)], batches, seed, kernel, components, "__part")[0]
    models = [KernelModel(list(features), kernel, walk.mean) for walk in parts]

    def unseen(x: np.ndarray) -> np.ndarray:
        """Decisions of the model that did not see the row, whose part stands last."""
        found = np.zeros(len(x))
        for part, model in enumerate(models):
            here = x[:, -1] == part
            found[here] = model.decisions(x[here, :-1])
        return found
    held = rows.select(label, score_column([*features, "__part"], unseen).alias("decision"))
    slope, shift = fit_sigmoid(materialize(held, "decisions"), "decision", label)
    return KernelModel(list(features), kernel, whole.mean, slope, shift)
