"""Sums by feature and bin over rows of codes.

The cells of all features lie end to end. Features of few bins are counted together: the codes of a group
make one joint code of at most ``MOST`` values, whose sums are added up to those of each feature.
Sums of whole numbers below 2^53 are exact, whatever the grouping.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F

from lendlens.operators.passes import Chunk, chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST = 1 << 10
# Whether a union of tables of one partition each has one partition; copies of a table must stay apart.
ZIPS = "spark.sql.unionOutputPartitioning"


class Cells:
    """Where the bins of features of these numbers of bins lie."""

    def __init__(self, sizes: Sequence[int]):
        self.sizes = np.array(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.total = int(self.sizes.sum())
        self.feature = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.groups: list[list[int]] = []
        cells: list[int] = []
        for f in np.argsort(-self.sizes, kind="stable").tolist():
            at = next((i for i, n in enumerate(cells) if n * sizes[f] <= MOST), len(cells))
            if at == len(cells):
                self.groups.append([]), cells.append(1)
            self.groups[at].append(f)
            cells[at] *= sizes[f]
        self.parts: list[tuple[int, np.ndarray, np.ndarray]] = []
        for group, n in zip(self.groups, cells):
            numbers, digits = np.arange(n), []
            for f in group:
                numbers, digit = np.divmod(numbers, sizes[f])
                digits.append(digit[:, None] == np.arange(sizes[f]))
            self.parts.append((n, np.concatenate([np.arange(self.starts[f], self.ends[f]) for f in group]), np.hstack(digits).astype(np.float64)))

    def joint(self, codes: Sequence[np.ndarray]) -> list[np.ndarray]:
        """The joint codes of each group; ``codes`` are those of each feature."""
        found = []
        for group in self.groups:
            value, step = np.zeros(len(codes[0]), np.uint16), 1
            for f in group:
                value += codes[f].astype(np.uint16) * np.uint16(step)
                step *= int(self.sizes[f])
            found.append(value)
        return found

    def sums(self, joint: Sequence[np.ndarray], weights: Sequence[np.ndarray | None], rows: np.ndarray | None = None) -> np.ndarray:
        """Sums of each of the weights (None: rows) per cell. ``rows`` are the places in the codes that the weights belong to."""
        found = np.empty((len(weights), self.total))
        for codes, (n, places, members) in zip(joint, self.parts):
            codes = (codes if rows is None else codes.take(rows)).astype(np.intp)
            found[:, places] = np.stack([np.bincount(codes, w, n) for w in weights]).astype(np.float64) @ members
        return found

    def upto(self, sums: np.ndarray) -> np.ndarray:
        """Per cell the sums of its feature's cells up to it."""
        whole = np.cumsum(sums, 1)
        before = whole[:, self.starts] - sums[:, self.starts]
        return whole - before[:, self.feature]

    def padded(self, sums: np.ndarray, bins: int) -> np.ndarray:
        """(weight, feature, bin) with as many bins for each feature."""
        found = np.zeros((len(sums), len(self.sizes), bins), sums.dtype)
        found[:, self.feature, np.arange(self.total) - self.starts[self.feature]] = sums
        return found


def with_all_rows(rows: DataFrame, tasks: int, work: Callable[[int, Chunk], Iterator[pa.RecordBatch]], schema: str) -> list[Row]:
    """The rows that ``work`` (number of a task, one chunk of all rows) gives in ``tasks`` tasks, each of which reads
    the written table; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, {}, 1 << 62):
            task = chunk.pop("task")
            if (task != task[0]).any():
                raise RuntimeError("copies of the table met in one task")
            yield from work(int(task[0]), chunk)
    copies = reduce(DataFrame.unionAll, [rows.coalesce(1).withColumn("task", F.lit(i)) for i in range(tasks)])
    spark = rows.sparkSession
    kept = spark.conf.get(ZIPS, None)
    spark.conf.set(ZIPS, "false")
    try:
        return copies.mapInArrow(run, schema).collect()
    finally:
        spark.conf.unset(ZIPS) if kept is None else spark.conf.set(ZIPS, kept)


def dealt_models(costs: Sequence[float], tasks: int) -> list[list[int]]:
    """Models for each task: the dearest first, each to the task that has least to do."""
    load, found = [0.0] * tasks, [[] for _ in range(tasks)]
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        at = min(range(tasks), key=lambda t: (load[t], t))
        load[at] += costs[i]
        found[at].append(i)
    return found

