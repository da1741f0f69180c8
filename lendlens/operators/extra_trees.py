"""Extremely randomised trees.

All trees grow one level at a time. A level takes two passes: the ranges of all features per open
node, then, for one seeded random cut per drawn feature inside its range, the rows and positives that
go left. A node's features and cuts depend only on seed, tree and node, so they repeat however the
rows are dealt. The tables of nodes are on the driver: at most 2^depth nodes of each tree, so ``depth``
bounds them at any number of rows; on few rows it may be as large as wanted.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from lendlens.operators.bins import score_column
from lendlens.operators.passes import chunks, combined, dealt, known, packed
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows and trees that are worked on at a time, few enough for a core's cache.
BLOCK, TREES = 1 << 12, 16


@dataclass
class RandomTree:
    """Nodes in the order of their making; a leaf has feature -1."""

    feature: list[int]
    cut: list[float]
    left: list[int]
    rows: list[int]
    positives: list[int]
    depth: list[int]

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature), np.array(self.cut), np.array(self.left)

    def shares(self) -> np.ndarray:
        return np.array(self.positives) / np.maximum(self.rows, 1)


@dataclass(frozen=True)
class Abreast:
    """Trees whose nodes lie end to end, so that blocks of rows go down all of them at once; a leaf leads to itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    roots: np.ndarray
    levels: int

    @staticmethod
    def of(trees: Sequence[tuple[np.ndarray, ...]]) -> Abreast:
        """``trees`` begin with features, cuts and left children; a right child follows the left one."""
        sizes = np.array([len(t[0]) for t in trees])
        roots = np.cumsum(sizes) - sizes
        feature, cut = np.concatenate([t[0] for t in trees]).astype(np.int64), np.concatenate([t[1] for t in trees]).astype(np.float64)
        left = np.concatenate([t[2] for t in trees]).astype(np.int64) + np.repeat(roots, sizes)
        leaf = feature < 0
        levels, below = 0, roots[~leaf[roots]]
        while len(below):
            below = np.concatenate([left[below], left[below] + 1])
            below = below[~leaf[below]]
            levels += 1
        return Abreast(np.where(leaf, 0, feature), np.where(leaf, np.inf, cut), np.where(leaf, np.arange(len(leaf)), left), roots, levels)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The deepest node of each tree (rows of the result) that each row of ``x`` reaches."""
        cells, row = x.ravel(), np.arange(len(x)) * x.shape[1]
        at = np.repeat(self.roots[:, None], len(x), 1)
        for _ in range(self.levels):
            right = cells.take(self.feature.take(at) + row) > self.cut.take(at)
            at = self.left.take(at)
            at += right
        return at


@dataclass(frozen=True)
class RandomForest:
    features: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        total, x = np.zeros(len(x)), np.ascontiguousarray(x)
        for low in range(0, len(self.trees), TREES):
            some = self.trees[low:low + TREES]
            trees, shares = Abreast.of(some), np.concatenate([t[3] for t in some])
            for at in range(0, len(x), BLOCK):
                for share in shares.take(trees.nodes(x[at:at + BLOCK])):
                    total[at:at + BLOCK] += share
        return total / len(self.trees)

    def score(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, score_column(self.features, self))


def draws(seed: int, tree: int, node: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeded order of the features, and where between its ends the cut of each lies."""
    rng = np.random.default_rng((seed, tree, node))
    return rng.permutation(width), rng.random(width)


def cuts_within(order: np.ndarray, shares: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, float]]:
    """(feature, cut) pairs: features in the order given, as many as ``most``, constant ones
    passed over but counted, unless all of them are constant: then on to the first that is not."""
    found = []
    for place, f in enumerate(order.tolist()):
        if place >= most and found:
            break
        if high[f] > low[f]:
            cut = low[f] + shares[f] * (high[f] - low[f])
            found.append((f, float(low[f] if cut >= high[f] else cut)))
    return found


def drawn_cuts(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray, most: int) -> list[tuple[int, float]]:
    """Seeded cuts of a node whose features lie between ``low`` and ``high``."""
    return cuts_within(*draws(seed, tree, node, len(low)), low, high, most)


def gini_gain(n: int, pos: int, n_left: int, pos_left: int) -> float:
    """How much impurity a cut takes away, times the rows."""
    def spread(rows: int, bad: int) -> float:
        return 2.0 * bad * (rows - bad) / rows if rows else 0.0
    return spread(n, pos) - spread(n_left, pos_left) - spread(n - n_left, pos - pos_left)


def fit_extra_trees(df: DataFrame, features: Sequence[str], label: str, trees: int = 100, depth: int = 12,
                    min_split: int = 2, most_features: int | None = None, seed: int = 42,
                    folds: Sequence[int | None] = (None,)) -> list[RandomForest]:
    """One forest for each entry of ``folds``, trained on rows of other folds (None: all rows).

    Of the drawn cuts of a node the one that lowers Gini impurity most is taken, of equal ones the
    first drawn. Every tree sees all rows.
    """
    width = len(features)
    most = min(most_features or max(1, int(width ** 0.5)), width)
    fold = F.col("fold").cast("int") if any(f is not None for f in folds) else F.lit(-1)
    rows = df.select(F.col(label).cast("int").alias("label"), fold.alias("fold"), *known(features, df))
    rows = materialize(dealt(rows.select("label", "fold", F.array(*features).alias("x")), df.count(), max(1, trees // 4)), "rows")
    counts = {r["fold"]: (r["n"], r["bad"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).collect()}
    grown: list[tuple[int | None, int, RandomTree]] = []
    for left_out in folds:
        n, bad = (sum(c[k] for f, c in counts.items() if left_out is None or f != left_out) for k in (0, 1))
        if not n:
            raise ValueError("no rows to learn from")
        grown += [(left_out, t, RandomTree([-1], [0.0], [0], [n], [bad], [0])) for t in range(trees)]
    frontier = {i: [0] for i in range(len(grown))}

    for level in range(depth):
        for i, nodes in frontier.items():
            t = grown[i][2]
            frontier[i] = [n for n in nodes if t.rows[n] >= min_split and 0 < t.positives[n] < t.rows[n]]
        frontier = {i: nodes for i, nodes in frontier.items() if nodes}
        if not frontier:
            break
        drawn = {(i, n): draws(seed, grown[i][1], n, width) for i, nodes in frontier.items() for n in nodes}
        cuts = {}
        # The first features of a node's order; all of them only where these are constant.
        for asked in (most, width):
            ranges = node_ranges(rows, plan(grown, {at: drawn[at][0][:asked] for at in drawn if at not in cuts}), width)
            for at, (low, high) in ranges.items():
                if found := cuts_within(*drawn[at], low, high, most):
                    cuts[at] = found
            if asked == width or len(cuts) == len(drawn):
                break
        left = left_counts(rows, plan(grown, {at: [f for f, _ in found] for at, found in cuts.items()}), cuts, width)
        frontier = {}
        for (i, n), candidates in sorted(cuts.items()):
            t, counted = grown[i][2], left[i, n]
            gains = [gini_gain(t.rows[n], t.positives[n], a, b) for a, b in counted]
            best = int(np.argmax(gains))
            t.feature[n], t.cut[n] = candidates[best]
            t.left[n] = len(t.feature)
            a, b = counted[best]
            for rows_in, bad in ((a, b), (t.rows[n] - a, t.positives[n] - b)):
                frontier.setdefault(i, []).append(len(t.feature))
                for values, value in ((t.feature, -1), (t.cut, 0.0), (t.left, 0), (t.rows, rows_in), (t.positives, bad), (t.depth, level + 1)):
                    values.append(value)
    forests = [RandomForest(list(features), [(*t.arrays(), t.shares()) for _, _, t in grown[k * trees:(k + 1) * trees]])
               for k in range(len(folds))]
    return forests


@dataclass(frozen=True)
class Group:
    """Some trees trained on the same rows: their open nodes (tree, node), the place of each node among
    these (-1: closed), where each tree's begin and end, and the features asked for in each."""

    left_out: int | None
    trees: list[int]
    abreast: Abreast
    nodes: list[tuple[int, int]]
    place: np.ndarray
    ends: np.ndarray
    names: np.ndarray

    def open_rows(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the open nodes that hold rows, where each one's rows begin, how many, and all these rows by node."""
        place = self.place.take(self.abreast.nodes(x))
        row = np.broadcast_to(np.arange(len(x)), place.shape).ravel()
        place = place.ravel()
        if (place < 0).any():
            some = np.flatnonzero(place >= 0)
            place, row = place[some], row[some]
        order = np.argsort(place.astype(np.uint16) if len(self.nodes) < 1 << 16 else place, kind="stable")
        place = place.take(order)
        begin = np.flatnonzero(np.append(True, place[1:] != place[:-1])[:len(place)])
        return place[begin], begin, np.diff(np.append(begin, len(place))), row.take(order)


def plan(grown: list[tuple[int | None, int, RandomTree]], asked: dict[tuple[int, int], Sequence[int]]) -> list[Group]:
    """Trees with open nodes in groups, and of each open node the features it asks for (filled up with its first)."""
    nodes: dict[tuple, dict[int, list[int]]] = {}
    for i, n in sorted(asked):
        nodes.setdefault((grown[i][0] is not None, grown[i][0]), {}).setdefault(i, []).append(n)
    most = max((len(a) for a in asked.values()), default=0)
    groups = []
    for (_, left_out), of in sorted(nodes.items(), key=lambda item: (item[0][0], item[0][1] or 0)):
        for low in range(0, len(of), TREES):
            trees = list(of)[low:low + TREES]
            abreast = Abreast.of([grown[i][2].arrays() for i in trees])
            held = [(i, n) for i in trees for n in of[i]]
            place = np.full(len(abreast.feature), -1, np.int64)
            place[np.repeat(abreast.roots, [len(of[i]) for i in trees]) + [n for _, n in held]] = np.arange(len(held))
            names = np.array([[*asked[at], *[asked[at][0]] * (most - len(asked[at]))] for at in held], np.int64)
            groups.append(Group(left_out, trees, abreast, held, place, np.cumsum([len(of[i]) for i in trees]), names))
    return groups


def blocks(batches: Iterator[pa.RecordBatch], groups: list[Group], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of a group, features, labels) of every block of the rows that the group learns from."""
    for chunk in chunks(batches, {"x": width}):
        label = np.nan_to_num(chunk["label"]).astype(np.int64)
        for left_out in dict.fromkeys(g.left_out for g in groups):
            x, y = chunk["x"], label
            if left_out is not None:
                use = chunk["fold"] != left_out
                x, y = x[use], y[use]
            for at in range(0, len(y), BLOCK):
                for k, g in enumerate(groups):
                    if g.left_out == left_out:
                        yield k, np.ascontiguousarray(x[at:at + BLOCK]), y[at:at + BLOCK]


def by_tree(groups: list[Group], arrays: list[np.ndarray], longs: bool) -> pa.RecordBatch:
    """One row for each tree: the numbers of its open nodes."""
    return packed([i for g in groups for i in g.trees],
                  [part for g, array in zip(groups, arrays) for part in np.split(array, g.ends[:-1])], longs)


def by_node(groups: list[Group], found: DataFrame, shape: tuple[int, ...]) -> dict[tuple[int, int], np.ndarray]:
    trees = {r["key"]: np.array(r["numbers"]) for r in found.collect()}
    return {at: numbers for g in groups if trees for at, numbers in zip(
        g.nodes, np.concatenate([trees[i] for i in g.trees]).reshape(len(g.nodes), *shape))}


def node_ranges(rows: DataFrame, groups: list[Group], width: int) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value in every open node of the features it asks for; of others 0 and 0."""
    most = groups[0].names.shape[1]

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.full((len(g.nodes), 2, most), np.inf) for g in groups]
        for k, x, _ in blocks(batches, groups, width):
            held, begin, sizes, row = groups[k].open_rows(x)
            if not len(held):
                continue
            cells, row = x.ravel(), row * width
            for j, names in enumerate(groups[k].names[held].T):
                values = cells.take(row + np.repeat(names, sizes))
                ends[k][held, 0, j] = np.minimum(ends[k][held, 0, j], np.minimum.reduceat(values, begin))
                ends[k][held, 1, j] = np.minimum(ends[k][held, 1, j], -np.maximum.reduceat(values, begin))
        yield by_tree(groups, ends, False)
    found = by_node(groups, combined(rows, ranges, False, smallest=True), (2, most))
    ranges_of = {}
    for g in groups:
        for at, names in zip(g.nodes, g.names):
            low, high = np.zeros(width), np.zeros(width)
            low[names], high[names] = found[at][0], -found[at][1]
            ranges_of[at] = low, high
    return ranges_of


def left_counts(rows: DataFrame, groups: list[Group], cuts: dict, width: int) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Rows and positives that each candidate cut of a node sends left."""
    if not groups:
        return {}
    most = groups[0].names.shape[1]
    limits = [np.array([[*[c for _, c in cuts[at]], *[-np.inf] * (most - len(cuts[at]))] for at in g.nodes]) for g in groups]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(g.nodes), most, 2), np.int64) for g in groups]
        for k, x, y in blocks(batches, groups, width):
            held, begin, sizes, row = groups[k].open_rows(x)
            if not len(held):
                continue
            both = (1 + (y << 32)).take(row)  # rows and positives in one sum
            cells, row = x.ravel(), row * width
            for j, (names, cut) in enumerate(zip(groups[k].names[held].T, limits[k][held].T)):
                goes = cells.take(row + np.repeat(names, sizes)) <= np.repeat(cut, sizes)
                found = np.add.reduceat(both * goes, begin)
                sums[k][held, j, 0] += found & 0xFFFFFFFF
                sums[k][held, j, 1] += found >> 32
        yield by_tree(groups, sums, True)
    found = by_node(groups, combined(rows, count, True), (most, 2))
    return {at: [(int(a), int(b)) for a, b in found[at][:len(candidates)]] for at, candidates in cuts.items()}
