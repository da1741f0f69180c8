"""Leaf-wise boosted trees from second-order histograms.

Features become codes of quantile bins, written once. A pass over the rows sums gradients and
hessians per open leaf, feature and bin; sums are whole numbers of a fixed unit, so they do not
depend on the order in which tasks finish. Splits are chosen where the sums of a leaf meet; the
driver gets one row per leaf. Of all open leaves the one of most gain is split next, until there are
``max_leaves``. A pass also sums for the children of leaves that may be split soon. The rows of a leaf
of at most ``FEW`` rows meet in one task instead, which splits it on, best first, as far as the tree
could ask for; so a tree takes as many passes as its large leaves are deep, and one more. Several
models (folds, points of a search) grow in the same passes.

Rows that fill at most ``PARTS`` such leaves are read whole by each task, and every task grows some of the models
from their first tree to their last, with the same sums and the same trees.

Margins are kept with the rows and written anew every ``KEEP`` trees; trees since then are applied
inside the passes.
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

from lendlens.operators.bins import Bins, fit_bins, score_column
from lendlens.operators.cells import Cells, dealt_models, with_all_rows
from lendlens.operators.passes import Chunk, chunks, dealt, known, packed, task_count, unpacked
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNIT = float(1 << 24)
KEEP = 10
FEW = 1 << 16
PARTS = 32
# Rows from which on a block goes down a tree by dividing it at the nodes.
MANY = 1 << 11
# Bytes of histograms that a task may hold: models beyond it take passes of their own.
HELD = 256 << 20


@dataclass(frozen=True)
class Boosting:
    """How to grow: ``depth`` 0 is unlimited; ``subsample`` is the share of rows that each tree sees."""

    rounds: int = 100
    max_leaves: int = 31
    rate: float = 0.1
    l2: float = 0.0
    min_child: int = 20
    min_hessian: float = 1e-3
    depth: int = 0
    subsample: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Arrays over nodes; a row goes left where its code is at most ``cut``. Leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def places(self, codes: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int32)
        open_ = np.arange(len(codes)) if len(self.feature) and self.feature[0] >= 0 else np.zeros(0, np.int64)
        while len(open_):
            node = at[open_]
            at[open_] = np.where(codes[open_, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            open_ = open_[self.feature[at[open_]] >= 0]
        return at

    def scores(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.places(codes)]


@dataclass
class Leaf:
    """A node while its tree grows."""

    depth: int
    gain: float | None = None  # of its best split, None while unknown
    feature: int = -1
    cut: int = -1
    children: tuple[int, int] | None = None  # prepared, split only once `split` is set
    split: bool = False
    sums: tuple[int, int, int] = (0, 0, 0)


@dataclass
class Growth:
    """One model while it grows."""

    how: Boosting
    fold: int | None
    base: float = 0.0
    rows: int = 0
    trees: list[Tree] = field(default_factory=list)
    nodes: list[Leaf] = field(default_factory=list)
    kept: int = 0  # trees whose scores are in the written margins

    def start(self) -> None:
        self.nodes = [Leaf(0, sums=(0, 0, self.rows))]

    def wanted(self) -> list[int]:
        """Open leaves without a known split, and the children that the best open leaves would have."""
        open_ = [i for i, n in enumerate(self.nodes) if not n.split and self.reached(i)]
        unknown = [i for i in open_ if self.nodes[i].gain is None]
        if not unknown:
            return []
        room = self.how.max_leaves - len(open_)
        ready = sorted((i for i in open_ if self.nodes[i].children), key=lambda i: -self.nodes[i].gain)[:max(room, 0)]
        return unknown + [c for i in ready for c in self.nodes[i].children if self.nodes[c].gain is None]

    def reached(self, node: int) -> bool:
        return node == 0 or node in self.parents and self.nodes[self.parents[node]].split

    @property
    def parents(self) -> dict[int, int]:
        return {c: i for i, n in enumerate(self.nodes) if n.children for c in n.children}

    def learn(self, node: int, gain: float, feature: int, cut: int, left: tuple, sums: tuple) -> None:
        n = self.nodes[node]
        n.gain, n.sums = gain, sums
        if gain > 0 and (not self.how.depth or n.depth < self.how.depth):
            n.feature, n.cut, n.children = feature, cut, (len(self.nodes), len(self.nodes) + 1)
            for part in (left, tuple(a - b for a, b in zip(sums, left))):
                self.nodes.append(Leaf(n.depth + 1, sums=part))

    def learn_all(self, node: int, found: dict | None) -> None:
        """Takes over the splits of a leaf and of what was grown below it; no rows, no split."""
        if not found:
            self.nodes[node].gain = 0.0
            return
        open_ = [(node, 0)]
        while open_:
            at, place = open_.pop(0)
            r = found[place]
            self.learn(at, r["gain"], r["feature"], r["cut"], (r["gl"], r["hl"], r["nl"]), (r["g"], r["h"], r["n"]))
            if r["below"] and self.nodes[at].children:
                open_ += zip(self.nodes[at].children, (r["below"], r["below"] + 1))

    def advance(self) -> None:
        """Splits the open leaf of most gain, as long as all gains are known."""
        while True:
            open_ = [i for i, n in enumerate(self.nodes) if not n.split and self.reached(i)]
            if len(open_) >= self.how.max_leaves or any(self.nodes[i].gain is None for i in open_):
                return
            ready = [i for i in open_ if self.nodes[i].children]
            if not ready:
                return
            self.nodes[max(ready, key=lambda i: (self.nodes[i].gain, -i))].split = True

    def grown(self) -> bool:
        open_ = [i for i, n in enumerate(self.nodes) if not n.split and self.reached(i)]
        return len(open_) >= self.how.max_leaves or all(self.nodes[i].gain is not None and not self.nodes[i].children for i in open_)

    def tree(self, prepared: bool) -> Tree:
        """The tree as it stands, or with all prepared splits."""
        nodes = self.nodes
        go = [n.children is not None and (prepared or n.split) for n in nodes]
        g, h = (np.array([n.sums[k] for n in nodes]) / UNIT for k in (0, 1))
        value = -self.how.rate * g / np.maximum(h + self.how.l2, 1e-12)
        return Tree(np.array([n.feature if s else -1 for n, s in zip(nodes, go)], np.int32), np.array([n.cut for n in nodes], np.int32),
                    np.array([n.children[0] if s else 0 for n, s in zip(nodes, go)], np.int32),
                    np.array([n.children[1] if s else 0 for n, s in zip(nodes, go)], np.int32), value)


@dataclass(frozen=True)
class BoostedModel:
    bins: Bins
    base: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        codes = np.stack([np.searchsorted(e, x[:, i], side="left").astype(np.uint8) for i, e in enumerate(self.bins.edges)])
        total, every = np.zeros(len(x)), np.arange(len(x))
        if len(x) < MANY:
            codes = np.ascontiguousarray(codes.T)
            for t in self.trees:
                total += t.scores(codes)
            return self.base + total
        for t in self.trees:
            for part, value in zip(routed(t, codes, every), t.value):
                if part is not None:
                    total[part] += value
        return self.base + total

    def score(self, df: DataFrame, output: str) -> DataFrame:
        scorer = BoostedScorer(self)
        return df.withColumn(output, score_column(self.bins.features, scorer))

    def table(self, spark) -> DataFrame:
        """One row per node: (tree, node, feature, threshold, left, right, value); leaves have no feature."""
        names, edges = self.bins.features, self.bins.edges
        rows = [(t, i, names[f] if f >= 0 else None, float(edges[f][tree.cut[i]]) if f >= 0 else None,
                 int(tree.left[i]) if f >= 0 else None, int(tree.right[i]) if f >= 0 else None, float(tree.value[i]))
                for t, tree in enumerate(self.trees) for i, f in enumerate(tree.feature.tolist())]
        return spark.createDataFrame(rows, "tree int, node int, feature string, threshold double, left int, right int, value double")


@dataclass(frozen=True)
class BoostedScorer:
    model: BoostedModel

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.model.margins(x), -500, 500)))


def trimmed(tree: Tree) -> Tree:
    """Without nodes that no row can reach."""
    order = [0]
    for i in order:
        if tree.feature[i] >= 0:
            order += [int(tree.left[i]), int(tree.right[i])]
    place = {n: k for k, n in enumerate(order)}
    link = lambda to: np.array([place[int(to[i])] if tree.feature[i] >= 0 else 0 for i in order], np.int32)
    return Tree(tree.feature[order], tree.cut[order], link(tree.left), link(tree.right), tree.value[order])


def seen(order: np.ndarray, how: Boosting, tree: int) -> np.ndarray:
    """The rows that a tree sees: those whose mixed number lies below the share."""
    if how.subsample >= 1:
        return np.ones(len(order), bool)
    with np.errstate(over="ignore"):
        z = order.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(how.seed * 100_003 + tree + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53) < how.subsample


def margins_of(chunk: dict, model: int, base: float, trees: Sequence[Tree]) -> np.ndarray:
    stored = chunk["margins"][:, model] if chunk["margins"].shape[1] else 0.0
    return stored + base + sum((t.scores(chunk["codes"]) for t in trees), np.zeros(len(chunk["codes"])))


ROWS = "key long, numbers array<long>, codes binary"
SPLIT_NAMES = ["model", "node", "place", "gain", "feature", "cut", "gl", "hl", "nl", "g", "h", "n", "below"]
SPLIT = ("model long, node long, place long, gain double, feature long, cut long, gl long, hl long, nl long, "
         "g long, h long, n long, below long")


def leaf_splits(rows: DataFrame, plans: list[tuple], sizes: list[int], models: int, tasks: int) -> list:
    """Per model and wanted leaf its best split and sums; of a small leaf also those of the nodes below it.

    A plan is (number of the model, base, trees since the margins, tree with prepared splits, wanted
    nodes, whether each is small, how, fold, number of the tree). ``place`` numbers the nodes below a
    leaf (itself 0), ``below`` is the place of a node's left child, the right one follows; 0 if unsplit.
    """
    width = len(sizes)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(sizes)
        totals = [{n: np.zeros((3, cells.total)) for n, few in zip(plan[4], plan[5]) if not few} for plan in plans]
        for chunk in chunks(batches, {"codes": width, "margins": models}):
            codes, y = chunk["codes"], chunk["label"]
            joint = cells.joint(codes.T) if any(totals) else []
            keys, arrays, bodies = [], [], []
            for total, (model, base, trees, tree, wanted, few, how, fold, number) in zip(totals, plans):
                slot = np.full(len(tree.feature), -1, np.int64)
                slot[wanted] = np.arange(len(wanted))
                at = slot[tree.places(codes)]
                use = np.flatnonzero((at >= 0) & seen(chunk["place"], how, number) & ((chunk["fold"] != fold) if fold is not None else True))
                if not len(use):
                    continue
                g, h = slopes(margins_of(chunk, model, base, trees)[use], y[use])
                order = np.argsort(at[use], kind="stable")
                ends = np.searchsorted(at[use][order], np.arange(len(wanted) + 1))
                for s, node in enumerate(wanted):
                    mine = order[ends[s]:ends[s + 1]]
                    if not len(mine):
                        continue
                    if few[s]:
                        keys.append(model << 32 | node)
                        arrays.append(np.concatenate([g[mine], h[mine]]).astype(np.int64))
                        bodies.append(codes[use[mine]].tobytes())
                    else:
                        total[node] += cells.sums(joint, (g[mine], h[mine], None), use[mine])
            if keys:
                yield with_codes(packed(keys, arrays, True), bodies)
        keys, arrays = [], []
        for total, plan in zip(totals, plans):
            for node, part in total.items():
                if part[2].any():
                    keys.append(plan[0] << 32 | node)
                    arrays.append(part.astype(np.int64))
        if keys:
            yield with_codes(packed(keys, arrays, True), [None] * len(keys))

    def with_codes(batch: pa.RecordBatch, bodies: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.binary())], names=["key", "numbers", "codes"])

    plan_of = {plan[0]: plan for plan in plans}
    left = {plan[0]: depth_left(plan[3], plan[6].depth) for plan in plans}

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(sizes)
        held: dict[int, np.ndarray] = {}
        parts: dict[int, list] = {}
        for batch in batches:
            for (key, numbers), body in zip(unpacked(batch), batch.column("codes").to_pylist()):
                if body is not None:
                    parts.setdefault(key, []).append((numbers, np.frombuffer(body, np.uint8).reshape(-1, width)))
                elif key in held:
                    held[key] += numbers
                else:
                    held[key] = numbers.copy()
        found = [(key >> 32, key & 0xFFFFFFFF, 0, *best_split(numbers.reshape(3, -1), plan_of[key >> 32][6], cells), 0) for key, numbers in held.items()]
        for key, pieces in parts.items():
            g, h = (np.concatenate([n.reshape(2, -1)[k] for n, _ in pieces]).astype(np.float64) for k in (0, 1))
            codes = np.ascontiguousarray(np.concatenate([c for _, c in pieces]).T)
            model, node = key >> 32, key & 0xFFFFFFFF
            grown, below, _ = grown_here(codes, cells.joint(codes), g, h, np.arange(len(g)), cells, plan_of[model][6], left[model][node])
            found += [(model, node, i, *split, b) for i, (split, b) in enumerate(zip(grown, below))]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=SPLIT_NAMES)
    partial = rows.mapInArrow(sums, ROWS)
    return (partial if tasks == 1 else partial.repartition("key")).mapInArrow(splits, SPLIT).collect()


def slopes(margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and hessian of each row in whole units."""
    p = 1 / (1 + np.exp(-margins))
    return np.rint((p - y) * UNIT), np.rint(p * (1 - p) * UNIT)


def depth_left(tree: Tree, most: int) -> list[int]:
    """How many levels may follow each node."""
    depth = [0] * len(tree.feature)
    for i, f in enumerate(tree.feature.tolist()):  # children come after their parent
        if f >= 0:
            depth[tree.left[i]] = depth[tree.right[i]] = depth[i] + 1
    return [most - d if most else 1 << 30 for d in depth]


def grown_here(codes: np.ndarray, joint: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, cells: Cells,
               how: Boosting, levels: int) -> tuple[list[tuple], list[int], list[np.ndarray | None]]:
    """The rows of one leaf split best first, as far as a whole tree of ``max_leaves`` could ask for: per node its best
    split and sums, the place of its left child and, unless it is split, its rows.

    ``codes`` (one array per feature), ``joint`` codes, ``g`` and ``h`` are those of all rows, ``rows`` the places of the leaf's.
    Of two children the smaller one is summed up, the other gets what is left. Nodes that cannot be split get no split.
    """
    def sums_of(rows: np.ndarray) -> np.ndarray:
        return cells.sums(joint, (g.take(rows), h.take(rows), None), rows)

    def may_split(n: int, level: int) -> bool:
        return level < levels and n >= 2 * max(how.min_child, 1)

    def best(sums: np.ndarray | None, total: Sequence[int]) -> tuple:
        return (0.0, -1, -1, 0, 0, 0, *total) if sums is None else best_split(sums, how, cells)
    total = int(g.take(rows).sum()), int(h.take(rows).sum()), len(rows)
    rows_of, depth, below = [rows], [0], [0]
    held = [sums_of(rows) if may_split(len(rows), 0) and how.max_leaves > 1 else None]
    splits = [best(held[0], total)]
    leaves = [0]
    while len(leaves) < how.max_leaves:
        ready = [i for i in leaves if splits[i][0] > 0 and depth[i] < levels]
        if not ready:
            break
        i = max(ready, key=lambda j: (splits[j][0], -j))
        leaves.remove(i)
        goes = codes[splits[i][1]].take(rows_of[i]) <= splits[i][2]
        parts = rows_of[i][goes], rows_of[i][~goes]
        totals = splits[i][3:6], tuple(a - b for a, b in zip(splits[i][6:9], splits[i][3:6]))
        more = [len(leaves) + 2 < how.max_leaves and may_split(len(part), depth[i] + 1) for part in parts]
        sums: list[np.ndarray | None] = [None, None]
        if any(more):
            small = int(len(parts[1]) < len(parts[0]))
            sums[small] = sums_of(parts[small])
            sums[1 - small] = held[i] - sums[small]
        below[i] = len(splits)
        for part, own, found, go in zip(parts, totals, sums, more):
            leaves.append(len(splits))
            rows_of.append(part), depth.append(depth[i] + 1), below.append(0), held.append(found if go else None)
            splits.append(best(held[-1], own))
        rows_of[i] = held[i] = None
    return splits, below, rows_of


def best_split(sums: np.ndarray, how: Boosting, cells: Cells) -> tuple:
    """Greatest gain over features and cuts; of equal gains the first feature, then the lowest cut."""
    total = sums[:, :cells.sizes[0]].sum(1)
    left = cells.upto(sums)
    right = total[:, None] - left
    allowed = (left[2] >= max(how.min_child, 1)) & (right[2] >= max(how.min_child, 1)) \
        & (left[1] >= how.min_hessian * UNIT) & (right[1] >= how.min_hessian * UNIT)

    def worth(part: np.ndarray) -> np.ndarray:
        return (part[0] / UNIT) ** 2 / np.maximum(part[1] / UNIT + how.l2, 1e-12)
    gain = np.where(allowed, worth(left) + worth(right) - worth(total), 0.0)
    at = int(gain.argmax())
    best, feature = float(gain[at]), int(cells.feature[at])
    if best <= 1e-9:
        return 0.0, -1, -1, 0, 0, 0, *map(int, total)
    return best, feature, at - int(cells.starts[feature]), *map(int, left[:, at]), *map(int, total)


def whole_model(codes: np.ndarray, joint: list[np.ndarray], y: np.ndarray, place: np.ndarray, rows: np.ndarray, base: float,
                how: Boosting, cells: Cells) -> list[Tree]:
    """All trees of a model; margins are added up as in the passes, so sums and trees are the same."""
    stored: np.ndarray | float = 0.0
    since, trees = np.zeros(len(y)), []
    for number in range(how.rounds):
        g, h = slopes(stored + base + since, y)
        some = rows[seen(place[rows], how, number)] if how.subsample < 1 else rows
        splits, below, parts = grown_here(codes, joint, g, h, some, cells, how, how.depth or 1 << 30)
        go = np.array(below) > 0
        sums = np.array([split[6:8] for split in splits], np.float64).T / UNIT
        value = -how.rate * sums[0] / np.maximum(sums[1] + how.l2, 1e-12)
        feature, cut = (np.where(go, [split[k] for split in splits], k - 2).astype(np.int32) for k in (1, 2))
        tree = Tree(feature, cut, np.array(below, np.int32), np.where(go, np.array(below) + 1, 0).astype(np.int32), value)
        if how.subsample < 1:
            parts = routed(tree, codes, rows)
        for part, v in zip(parts, value):
            if part is not None:
                since[part] += v
        trees.append(trimmed(tree))
        if (number + 1) % KEEP == 0:
            stored, base, since = stored + base + since, 0.0, np.zeros(len(y))
    return trees


def routed(tree: Tree, codes: np.ndarray, rows: np.ndarray) -> list[np.ndarray | None]:
    """The rows that end in each node."""
    found: list[np.ndarray | None] = [None] * len(tree.feature)
    found[0] = rows
    for i, f in enumerate(tree.feature.tolist()):  # children come after their parent
        if f >= 0:
            goes = codes[f].take(found[i]) <= tree.cut[i]
            found[tree.left[i]], found[tree.right[i]], found[i] = found[i][goes], found[i][~goes], None
    return found


def fit_whole(rows: DataFrame, models: list[Growth], sizes: list[int]) -> None:
    """Grows all models in tasks that hold all rows, some models in each."""
    width = len(sizes)
    tasks = min(len(models), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    deal = dealt_models([m.rows * m.how.rounds for m in models], tasks)
    plans = [(m.how, m.fold, m.base) for m in models]

    def fit(task: int, chunk: Chunk) -> Iterator[pa.RecordBatch]:
        cells = Cells(sizes)
        codes = np.ascontiguousarray(chunk.pop("codes").reshape(-1, width).T)
        joint = cells.joint(codes)
        for i in deal[task]:
            how, fold, base = plans[i]
            use = np.flatnonzero(chunk["fold"] != fold) if fold is not None else np.arange(codes.shape[1])
            trees = whole_model(codes, joint, chunk["label"], chunk["place"], use, base, how, cells)
            body = pickle.dumps([(t.feature, t.cut, t.left, t.right, t.value) for t in trees])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([body], pa.binary())], names=["model", "trees"])
    for r in with_all_rows(rows.select("label", "fold", "place", "codes"), tasks, fit, "model long, trees binary"):
        models[r["model"]].trees = [Tree(*arrays) for arrays in pickle.loads(r["trees"])]


def with_margins(rows: DataFrame, models: list[Growth], width: int) -> DataFrame:
    """The rows with the margins of all trees so far."""
    plans, held = [(m.base if not m.kept else 0.0, m.trees[m.kept:]) for m in models], len(models) if models[0].kept else 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for chunk in chunks(iter([batch]), {"codes": width, "margins": held}):
                found = np.stack([margins_of(chunk, i, base, trees) for i, (base, trees) in enumerate(plans)], 1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(plans))
            lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("label", "fold", "place", "codes")], lists],
                                             names=["label", "fold", "place", "codes", "margins"])
    written = materialize(rows.mapInArrow(add, "label int, fold int, place long, codes binary, margins array<double>"), "margins")
    for m in models:
        m.kept = len(m.trees)
    return written


def fit_boosting(df: DataFrame, features: Sequence[str], label: str, points: Sequence[Boosting] = (Boosting(),),
                 folds: Sequence[int | None] = (None,), row_id: str | None = None, max_bins: int = 255,
                 bins: Bins | None = None) -> list[list[BoostedModel]]:
    """Per point one model for each entry of ``folds``: trained on rows of other folds (None: all rows).

    ``row_id`` numbers rows for ``subsample``, which needs it; ``df`` holds ``fold`` if folds are named.
    """
    if any(p.subsample < 1 for p in points) and row_id is None:
        raise ValueError("subsample needs row_id")
    bins = bins or fit_bins(df, features, max_bins)
    place = F.xxhash64(F.col(row_id)) if row_id else F.lit(0).cast("long")
    fold = F.col("fold").cast("int") if any(f is not None for f in folds) else F.lit(-1)
    rows = df.select(F.col(label).cast("int").alias("label"), fold.alias("fold"), place.alias("place"), *known(features, df))
    coded = rows.select("label", "fold", "place", bins.codes().alias("codes"), F.array().cast("array<double>").alias("margins"))
    n = df.count()
    whole = n <= PARTS * FEW
    rows = materialize(coded if whole else dealt(coded, n, len(points) * len(folds)), "codes")
    counts = {r["fold"]: (r["n"], r["bad"]) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("bad")).collect()}
    models = [Growth(how, fold) for how in points for fold in folds]
    for m in models:
        n, bad = (sum(c[k] for f, c in counts.items() if m.fold is None or f != m.fold) for k in (0, 1))
        if not 0 < bad < n:
            raise ValueError("both classes are needed")
        m.base, m.rows = float(np.log(bad / (n - bad))), n
    if whole:
        fit_whole(rows, models, bins.sizes)
    else:
        fit_in_passes(rows, models, bins.sizes)
    fitted = [BoostedModel(bins, m.base, m.trees) for m in models]
    return [fitted[i:i + len(folds)] for i in range(0, len(fitted), len(folds))]


def fit_in_passes(rows: DataFrame, models: list[Growth], sizes: list[int]) -> None:
    """Grows all models by passes over the rows, wherever these are."""
    width, rounds, tasks = len(sizes), max(m.how.rounds for m in models), task_count(rows)
    for number in range(rounds):
        active = [(i, m) for i, m in enumerate(models) if number < m.how.rounds]
        for _, m in active:
            m.start()
        while True:
            plans = []
            for i, m in active:
                if wanted := m.wanted():
                    few = [m.nodes[n].sums[2] <= FEW for n in wanted]
                    plans.append((i, m.base if not m.kept else 0.0, m.trees[m.kept:], m.tree(True), wanted, few, m.how, m.fold, number))
            if not plans:
                break
            for group in grouped(plans, 24 * sum(sizes)):
                found: dict[tuple[int, int], dict] = {}
                for r in leaf_splits(rows, group, sizes, len(models) if models[0].kept else 0, tasks):
                    found.setdefault((r["model"], r["node"]), {})[r["place"]] = r
                for plan in group:
                    for node in plan[4]:
                        models[plan[0]].learn_all(node, found.get((plan[0], node)))
            for _, m in active:
                m.advance()
        for _, m in active:
            m.trees.append(trimmed(m.tree(False)))
        if (number + 1) % KEEP == 0 and number + 1 < rounds:
            rows = with_margins(rows, models, width)
            tasks = task_count(rows)


def grouped(plans: list[tuple], bytes_per_leaf: int) -> Iterator[list[tuple]]:
    """Plans whose histograms a task can hold together."""
    group, size = [], 0
    for plan in plans:
        need = plan[5].count(False) * bytes_per_leaf
        if group and size + need > HELD:
            yield group
            group, size = [], 0
        group.append(plan)
        size += need
    if group:
        yield group
