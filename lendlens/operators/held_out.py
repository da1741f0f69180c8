"""AUC of many models on rows that they did not see.

No row is made per model and score: tasks score their rows block by block, order the scores and send
on distinct ones as arrays by value range, which meet per model, fold and range. Linear models are
added up feature by feature in the order of their SQL, so equal rows have equal scores.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from lendlens.operators.fit import BernoulliModel, Scorer
from lendlens.operators.importance import tallied
from lendlens.operators.passes import chunks
from lendlens.operators.score import LinearModel

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scores of one model and fold that meet in a task, and of how many rows a range's edges are estimated.
SCORES_PER_RANGE = 1 << 18
EDGE_ROWS = 1 << 11
CHUNK_SCORES = 1 << 22
BLOCK = 1 << 11
PIECE = "point long, fold long, range long, bad array<double>, bads array<long>, good array<double>, goods array<long>"
LISTS = [pa.list_(pa.float64()), pa.list_(pa.int64())]
PIECES = pa.schema(zip(["point", "fold", "range", "bad", "bads", "good", "goods"], [pa.int64()] * 3 + LISTS * 2))


def is_linear(model: Scorer) -> bool:
    return isinstance(model, LinearModel | BernoulliModel)


def linear_scorer(models: Sequence[LinearModel | BernoulliModel], features: Sequence[str]) -> Callable[[np.ndarray], np.ndarray]:
    """From a matrix of features to the scores of all models, one row per model."""
    lines = [m.linear if isinstance(m, BernoulliModel) else m for m in models]
    cuts = np.array([m.binarize if isinstance(m, BernoulliModel) else np.nan for m in models])
    start = np.array([line.intercept for line in lines])
    weights = np.array([[line.weights.get(f, 0.0) for f in features] for line in lines]).reshape(len(lines), len(features))
    chance = np.array([isinstance(m, BernoulliModel) or m.probability for m in models])
    groups = [np.flatnonzero(cuts == c) for c in np.unique(cuts[~np.isnan(cuts)])] + [np.flatnonzero(np.isnan(cuts))]

    def block_scores(x: np.ndarray) -> np.ndarray:
        found = np.empty((len(start), x.shape[1]))
        for group in (g for g in groups if len(g)):
            cut = cuts[group[0]]
            values = x if np.isnan(cut) else (~(x <= cut)).astype(np.float64)
            total = np.repeat(start[group][:, None], x.shape[1], axis=1)
            for j, column in enumerate(values):
                w = weights[group, j]
                used = w != 0
                if used.all():
                    total += w[:, None] * column
                elif used.any():
                    total[used] += w[used][:, None] * column
            found[group] = total
        with np.errstate(over="ignore"):
            found[chance] = 1 / (1 + np.exp(-found[chance]))
        return found

    def scores(x: np.ndarray) -> np.ndarray:
        parts = [block_scores(np.ascontiguousarray(x[i:i + BLOCK].T)) for i in range(0, len(x), BLOCK)]
        return np.concatenate(parts, axis=1) if parts else np.zeros((len(start), 0))
    return scores


Part = tuple[DataFrame, list[int], list[Callable[[np.ndarray], np.ndarray]], int]


def scored_parts(df: DataFrame, models: Sequence[Sequence[Scorer]], label: str) -> list[Part]:
    """Tables (fold, positive, x) with the points they serve, per fold a function from x to scores, and x's width."""
    folds = len(models[0])
    inside = df.where(F.col("fold").between(0, folds - 1))
    positive = (F.coalesce(F.col(label).cast("int"), F.lit(0)) == 1).cast("int").alias("positive")

    def matrix(columns: Sequence[str]):
        missing = F.raise_error(F.lit("score is null")).cast("double")
        return F.array(*[F.coalesce(F.col(c).cast("double"), missing) for c in columns]).alias("x")
    parts: list[Part] = []
    plain = [i for i, point in enumerate(models) if all(map(is_linear, point))]
    if plain:
        lines = [m.linear if isinstance(m, BernoulliModel) else m for i in plain for m in models[i]]
        whole = {f for i in plain for m in models[i] if isinstance(m, BernoulliModel) for f in m.linear.weights}
        names = list(dict.fromkeys(f for line in lines for f, w in line.weights.items() if w != 0 or f in whole))
        x = matrix(names) if names else F.array(F.lit(0.0)).alias("x")
        parts.append((inside.select(F.col("fold").cast("int").alias("fold"), positive, x), plain,
                      [linear_scorer([models[i][fold] for i in plain], names or [""]) for fold in range(folds)], max(len(names), 1)))
    other = [i for i in range(len(models)) if i not in plain]
    for fold in range(folds) if other else ():
        scored = inside.where(F.col("fold") == fold)
        for i in other:
            scored = models[i][fold].score(scored, f"__point{i}")
        parts.append((scored.select(F.col("fold").cast("int").alias("fold"), positive, matrix([f"__point{i}" for i in other])), other,
                      [np.transpose] * folds, len(other)))
    return parts


def pieces(part: Part, edges: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """Ordered distinct scores of a task's rows and how often each occurs, per point, fold and range."""
    rows, points, scorers, width = part
    at_once = max(1 << 12, CHUNK_SCORES // max(len(points), width))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, {"x": width}, at_once):
            found = []
            for fold in np.unique(chunk["fold"]).tolist():
                mine = chunk["fold"] == fold
                positive = chunk["positive"][mine] == 1
                for point, scores in zip(points, scorers[fold](chunk["x"][mine])):
                    cuts = edges.get((point, fold), np.zeros(0))
                    sides = [np.sort(scores[positive]), np.sort(scores[~positive])]
                    split = [np.split(side, np.searchsorted(side, cuts)) for side in sides]
                    found += [(point, fold, number, *tallied(bad), *tallied(good))
                              for number, (bad, good) in enumerate(zip(*split)) if len(bad) or len(good)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), PIECES.types)], schema=PIECES)
    return rows.mapInArrow(tally, PIECE)


def range_edges(df: DataFrame, models: Sequence[Sequence[Scorer]], label: str, scores_per_range: int) -> dict[tuple[int, int], np.ndarray]:
    """Boundaries that split the scores of a point and fold into similar parts; any boundaries give right results."""
    total = df.count()
    ranges = -(-total // (scores_per_range * len(models[0])))
    if ranges <= 1:
        return {}
    some = df.sample(min(1.0, EDGE_ROWS * ranges * len(models[0]) / total), 1)

    def quantiles(key: tuple, rows: pa.Table) -> pa.Table:
        values = np.sort(np.concatenate([np.repeat(rows[v].combine_chunks().flatten().to_numpy(), rows[n].combine_chunks().flatten().to_numpy())
                                         for v, n in (("bad", "bads"), ("good", "goods"))]))
        cuts = np.unique(values[np.arange(1, ranges) * len(values) // ranges])
        return pa.table({"point": [key[0].as_py()], "fold": [key[1].as_py()], "cuts": pa.array([cuts], LISTS[0])})
    found = {}
    for part in scored_parts(some, models, label):
        for r in pieces(part, {}).groupBy("point", "fold").applyInArrow(quantiles, "point long, fold long, cuts array<double>").collect():
            found[r["point"], r["fold"]] = np.array(r["cuts"])
    return found


def right_pairs(key: tuple, rows: pa.Table) -> pa.Table:
    """Twice the (good, bad) pairs of a range that are in the right order, ties counted half."""
    bad, bads, good, goods = (rows[n].combine_chunks().flatten().to_numpy() for n in ("bad", "bads", "good", "goods"))
    order = np.argsort(good)
    good, upto = good[order], np.append(0, np.cumsum(goods[order]))
    twice = int((bads * (upto[np.searchsorted(good, bad)] + upto[np.searchsorted(good, bad, side="right")])).sum())
    return pa.table({n: pa.array([v], pa.int64()) for n, v in zip(("point", "fold", "range", "positives", "negatives", "twice"), (
        *(k.as_py() for k in key), int(bads.sum()), int(goods.sum()), twice))})


def fold_aucs(df: DataFrame, models: Sequence[Sequence[Scorer]], label: str, scores_per_range: int = SCORES_PER_RANGE) -> DataFrame:
    """(point, fold, auc) of every point's model of a fold on the rows of that fold; null with rows of one class only."""
    edges = range_edges(df, models, label, scores_per_range)
    tables = [pieces(part, edges) for part in scored_parts(df, models, label)]
    found = tables[0]
    for table in tables[1:]:
        found = found.unionByName(table)
    counts = found.groupBy("point", "fold", "range").applyInArrow(
        right_pairs, "point long, fold long, range long, positives long, negatives long, twice long")
    before = Window.partitionBy("point", "fold").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("negatives").over(before), F.lit(0))
    positives, negatives = F.sum("positives").cast("double"), F.sum("negatives").cast("double")
    return counts.withColumn("twice", F.col("twice") + 2 * F.col("positives") * lower).groupBy("point", "fold").agg(
        F.try_divide(F.sum("twice").cast("double") / 2, positives * negatives).alias("auc"))
