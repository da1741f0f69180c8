"""Exact nearest neighbours over all rows by pivots.

Every labelled row belongs to the cell of its nearest pivot. By the triangle inequality a cell whose
pivot is at distance d and whose rows are at most r from it holds nothing nearer than d - r. A query
first meets the nearest cells that hold k rows together, which bounds the distance of its k-th
neighbour, and then only cells that can hold something as near. Nearest cells and the queries that
meet them are dealt in blocks of bounded size. All other cells are dealt to parts of bounded size that
meet bounded groups of queries, so a row travels once per part or group, not once per cell; the bound
of a query falls from cell to cell.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.hashing import order_key
from lendlens.operators.passes import column_values, known
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_PIVOTS = 1024
BLOCK = 4096
AT_A_TIME = 256
# Labelled rows and queries that meet in one task after the nearest cells, in blocks.
PART_BLOCKS, GROUP_BLOCKS = 16, 8
# Distances are compared as rounded to this many places, so that equal ones are equal however summed.
PLACES = 9
SLACK = 1e-6


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """All distances, to about eight digits."""
    square = (x ** 2).sum(1)[:, None] + (points ** 2).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def nearest_in(x: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, place in points, distance) of the k nearest; equal distances go to the smaller id.

    A matrix product finds the candidates with a margin for its rounding; their distances are exact.
    """
    rows, places, found = [], [], []
    for at in range(0, len(x), AT_A_TIME):
        block = x[at:at + AT_A_TIME]
        rough = distances(block, points)
        limit = np.partition(rough, min(k, len(points)) - 1, axis=1)[:, min(k, len(points)) - 1]
        row, place = np.nonzero(rough <= limit[:, None] + SLACK * (1 + rough.max(1, keepdims=True)))
        exact = np.round(np.sqrt(((points[place] - block[row]) ** 2).sum(1)), PLACES)
        order = np.lexsort((ids[place], exact, row))
        rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
        order = order[rank < k]
        rows.append(row[order] + at), places.append(place[order]), found.append(exact[order])
    return tuple(np.concatenate(c) for c in (rows, places, found))


@dataclass(frozen=True)
class Cells:
    """The pivots, and per cell its number of rows and the least and greatest distance from the pivot."""

    pivots: np.ndarray
    rows: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def first(self, x: np.ndarray, k: int) -> np.ndarray:
        """Flags of the nearest cells that hold k rows together."""
        away = np.where(self.rows > 0, distances(x, self.pivots), np.inf)
        order = np.argsort(away, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        flags = np.zeros(away.shape, bool)
        np.put_along_axis(flags, order, before < k, axis=1)
        return flags & (self.rows > 0)

    def least(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Distances below which the cells hold no row, with a margin for rounding."""
        away = distances(x, self.pivots[cells])
        return np.maximum(np.maximum(away - self.outer[cells], self.inner[cells] - away), 0) - SLACK * (1 + away)


def near_pairs(x: np.ndarray, points: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, place in points) within the limits of the rows, by a margin for rounding; squares by one product."""
    own, other = (x ** 2).sum(1), (points ** 2).sum(1)
    square = np.hstack([x, own[:, None], np.ones((len(x), 1))]) @ np.hstack([-2 * points, np.ones((len(points), 1)), other[:, None]]).T
    most = limit + SLACK * (1 + np.sqrt(own) + np.sqrt(other.max()))
    return np.divmod(np.flatnonzero(square <= (most ** 2)[:, None]), len(points))


def nearest_within(x: np.ndarray, bound: np.ndarray, met_before: np.ndarray, points: np.ndarray, ids: np.ndarray, cell: np.ndarray,
                   held: Cells, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, place in points, distance) of the k nearest within the bound of each row, and the pairs compared.

    ``points`` are in order of ``cell``; ``met_before`` (row, cell) flags cells to leave out. A cell is met by
    the rows of x that it can hold something for, and lowers their bounds.
    """
    here, start = np.unique(cell, return_index=True)
    ends = np.append(start[1:], len(cell))
    rows, places, found = [], [], []
    compared = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 4 * AT_A_TIME):
        block, limit = x[at:at + 4 * AT_A_TIME], bound[at:at + 4 * AT_A_TIME].copy()
        least = np.where(met_before[at:at + 4 * AT_A_TIME][:, here], np.inf, held.least(block, here))
        best = np.repeat(limit[:, None], k, 1)  # the k least distances so far, none beyond the bound
        for c in np.argsort(least.min(0), kind="stable").tolist():
            use = np.flatnonzero((least[:, c] <= limit) & np.isfinite(least[:, c]))
            for low in range(start[c], ends[c], BLOCK) if len(use) else ():
                some = points[low:min(low + BLOCK, ends[c])]
                row, place = near_pairs(block[use] - held.pivots[here[c]], some - held.pivots[here[c]], limit[use])
                compared[at + use] += len(some)
                if not len(row):
                    continue
                exact = np.round(np.sqrt(((some[place] - block[use[row]]) ** 2).sum(1)), PLACES)
                order = np.lexsort((ids[low + place], exact, row))
                rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                order, rank = order[rank < k], rank[rank < k]
                rows.append(at + use[row[order]]), places.append(low + place[order]), found.append(exact[order])
                new = np.full((len(use), k), np.inf)
                new[row[order], rank] = exact[order]
                best[use] = np.sort(np.hstack([best[use], new]), 1)[:, :k]
                limit = np.minimum(limit, best[:, -1])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), compared
    row, place, distance = (np.concatenate(c) for c in (rows, places, found))
    order = np.lexsort((ids[place], distance, row))
    order = order[np.arange(len(order)) - np.searchsorted(row[order], row[order]) < k]
    return row[order], place[order], distance[order], compared


def lists(flags: np.ndarray) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum(flags.sum(1))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(flags)[1].astype(np.int32)))


def fit_cells(rows: DataFrame, row_id: str, most: int, seed: int) -> tuple[DataFrame, Cells]:
    """Rows (id, label, x, cell), written, and their cells. Pivots are a bounded seeded sample."""
    wanted = min(most, int(np.ceil(max(rows.count(), 1) ** 0.5)))
    sample = rows.orderBy(order_key(seed, F.col("id")), "id").limit(wanted).select("x").collect()
    pivots = np.unique(np.array([r["x"] for r in sample]), axis=0)

    @F.arrow_udf("struct<cell:int,away:double>")
    def placed(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            x = column_values(part, pivots.shape[1])
            cell = np.concatenate([distances(x[i:i + AT_A_TIME * 8], pivots).argmin(1) for i in range(0, len(x), AT_A_TIME * 8)] or [np.zeros(0, np.int64)])
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.StructArray.from_arrays([pa.array(cell.astype(np.int32)), pa.array(away)], names=["cell", "away"])
    points = materialize(rows.select("*", placed("x").alias("p")).select("id", "label", "x", "p.*"), "cells")
    n, inner, outer = np.zeros(len(pivots), np.int64), np.full(len(pivots), np.inf), np.zeros(len(pivots))
    for r in points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect():
        n[r["cell"]], inner[r["cell"]], outer[r["cell"]] = r["n"], r["low"], r["high"]
    return points, Cells(pivots, n, inner, outer)


def met(queries: DataFrame, points: DataFrame, cells: Cells, k: int, block: int) -> DataFrame:
    """(id, near, compared): per block that a query meets its k nearest in there and the pairs compared.

    ``queries`` holds (id, x, cells).
    """
    spark = queries.sparkSession
    visits = materialize(queries.select("id", "x", F.explode("cells").alias("cell")), "visits")
    counts = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pivot at most
    sizes = spark.createDataFrame(
        [(int(c), max(1, -(-int(cells.rows[c]) // block)), max(1, -(-n // block))) for c, n in counts.items()],
        "cell int, chunks int, parts int")
    width = cells.pivots.shape[1]
    left = points.join(F.broadcast(sizes), "cell").select(
        "cell", F.pmod(F.xxhash64("id", F.lit(1)), "chunks").cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "label", "x")
    right = visits.join(F.broadcast(sizes), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int").alias("part"), "id", "x")

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"id": pa.array([], asked.schema.field("id").type), "distance": pa.array([], pa.float64()),
                             "other": pa.array([], held.schema.field("id").type), "label": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())})
        x, p = (column_values(pa.concat_arrays(t["x"].chunks), width) for t in (asked, held))
        ids = held["id"].to_numpy()
        row, place, distance = nearest_in(x, p, ids, k)
        first = np.append(True, row[1:] != row[:-1])
        return pa.table({"id": asked["id"].take(pa.array(row)), "distance": distance, "other": held["id"].take(pa.array(place)),
                         "label": held["label"].take(pa.array(place)), "pairs": np.where(first, len(p), 0)})
    kinds = points.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    schema = f"id {kinds[1]}, distance double, other {kinds[0]}, label double, pairs long"
    key = ["cell", "chunk", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema)


def met_elsewhere(queries: DataFrame, points: DataFrame, cells: Cells, k: int, part_rows: int, group_rows: int) -> DataFrame:
    """(id, near, compared) as ``met`` gives them, of the cells that a query has not met and that can hold
    a row within its bound.

    ``queries`` holds (id, x, bound, cells). Cells follow each other into parts; large ones are dealt to
    several by the fingerprint of the row.
    """
    spark = points.sparkSession
    plan, part, filled = [], 0, 0
    for cell, n in enumerate(cells.rows.tolist()):  # one row per pivot at most
        if filled and filled + n > part_rows:
            part, filled = part + 1, 0
        shares = max(1, -(-n // part_rows))
        plan.append((cell, part, shares))
        part, filled = (part + shares, 0) if shares > 1 else (part, filled + n)
    sizes = spark.createDataFrame(plan, "cell int, first int, shares int")
    parts, asked = part + bool(filled), queries.count()
    # Few rows are dealt to smaller groups, so that there are two tasks for each core.
    spread = -(-2 * spark.sparkContext.defaultParallelism // max(parts, 1))
    groups = max(1, -(-asked // group_rows), min(spread, -(-asked // AT_A_TIME)))
    width = cells.pivots.shape[1]
    left = points.join(F.broadcast(sizes), "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("id", F.lit(1)), "shares").cast("int")).alias("part"),
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "cell", "id", "label", "x")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                           F.pmod(F.xxhash64("id", F.lit(2)), F.lit(groups)).cast("int").alias("group"), "id", "x", "bound", "cells")

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"id": pa.array([], asked.schema.field("id").type), "distance": pa.array([], pa.float64()),
                             "other": pa.array([], held.schema.field("id").type), "label": pa.array([], pa.float64()), "pairs": pa.array([], pa.int64())})
        x, p = (column_values(pa.concat_arrays(t["x"].chunks), width) for t in (asked, held))
        order = np.argsort(held["cell"].to_numpy(), kind="stable")
        here = np.unique(held["cell"].to_numpy())
        near = np.argsort(np.concatenate([distances(x[i:i + BLOCK], cells.pivots[here]).argmin(1) for i in range(0, len(x), BLOCK)]), kind="stable")
        before = pa.concat_arrays(asked["cells"].chunks).take(pa.array(near))
        met_before = np.zeros((len(x), len(cells.rows)), bool)
        met_before[np.repeat(np.arange(len(x)), before.value_lengths().to_numpy()), before.flatten().to_numpy()] = True
        row, place, distance, compared = nearest_within(
            x[near], asked["bound"].to_numpy()[near], met_before, p[order], held["id"].to_numpy()[order], held["cell"].to_numpy()[order], cells, k)
        # A row of its own carries the pairs of each query, which may have found nothing.
        row, place = near[row], order[place]
        nothing = np.flatnonzero(compared)
        ids = pa.concat_arrays([asked["id"].take(pa.array(r)).combine_chunks() for r in (row, near[nothing])])
        none = pa.nulls(len(nothing), held.schema.field("id").type)
        return pa.table({
            "id": ids, "distance": pa.concat_arrays([pa.array(distance, pa.float64()), pa.nulls(len(nothing), pa.float64())]),
            "other": pa.concat_arrays([held["id"].take(pa.array(place)).combine_chunks(), none]),
            "label": pa.concat_arrays([held["label"].take(pa.array(place)).combine_chunks(), pa.nulls(len(nothing), pa.float64())]),
            "pairs": np.concatenate([np.zeros(len(row), np.int64), compared[nothing]])})
    kinds = points.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    schema = f"id {kinds[1]}, distance double, other {kinds[0]}, label double, pairs long"
    key = ["part", "group"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, schema)


def merged(found: DataFrame, k: int) -> DataFrame:
    """(id, near, compared): the k nearest of all blocks, nearest first."""
    near = F.sort_array(F.collect_list(F.when(F.col("distance").isNotNull(), F.struct("distance", "other", "label"))))  # k of each block that a query met
    return found.groupBy("id").agg(F.slice(near, 1, k).alias("near"), F.sum("pairs").alias("compared"))


def nearest_rows(train: DataFrame, queries: DataFrame, features: Sequence[str], label: str, row_id: str, k: int,
                 most_pivots: int = MOST_PIVOTS, block: int = BLOCK, seed: int = 42) -> DataFrame:
    """Per query (id) its k nearest of all labelled rows, ``near`` (distance, other, label), and the pairs compared.

    Ids are numbers, unique in each table. Distances are Euclidean; equal ones go to the smaller id.
    """
    rows = train.select(F.col(row_id).alias("id"), F.col(label).cast("double").alias("label"), *known(features, train))
    points, cells = fit_cells(rows.select("id", "label", F.array(*features).alias("x")), row_id, most_pivots, seed)
    if not cells.rows.sum():
        raise ValueError("no rows to learn from")
    asked = materialize(queries.select(F.col(row_id).alias("id"), *known(features, queries)).select("id", F.array(*features).alias("x")), "queries")
    width = cells.pivots.shape[1]

    @F.arrow_udf("array<int>")
    def first(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield lists(cells.first(column_values(part, width), k))

    asked = materialize(asked.withColumn("cells", first("x")), "first")
    near = materialize(merged(met(asked, points, cells, k, block), k), "near")
    bounds = asked.join(near.select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).otherwise(float("inf")).alias("bound")), "id")
    more = met_elsewhere(materialize(bounds.select("id", "x", "bound", "cells"), "bounds"), points, cells, k, PART_BLOCKS * block, GROUP_BLOCKS * block)
    before = near.select("id", F.explode("near").alias("n"), "compared").select(
        "id", "n.distance", "n.other", "n.label", F.lit(0).cast("long").alias("pairs"))
    counted = near.select("id", F.col("compared").alias("earlier"))
    return merged(before.unionByName(more), k).join(counted, "id").select("id", "near", (F.col("compared") + F.col("earlier")).alias("compared"))


def vote(near: Column, by_distance: bool = False) -> Column:
    """Mean label of the neighbours; by distance each counts one over it, and only those at 0 if there are any."""
    total = lambda x, f: F.aggregate(x, F.lit(0.0), lambda a, n: a + f(n))
    if not by_distance:
        return total(near, lambda n: n["label"]) / F.size(near)
    same = F.filter(near, lambda n: n["distance"] == 0)
    weighted = total(near, lambda n: F.try_divide(n["label"], n["distance"])) / total(near, lambda n: F.try_divide(F.lit(1.0), n["distance"]))
    return F.when(F.size(same) > 0, total(same, lambda n: n["label"]) / F.size(same)).otherwise(weighted)


@dataclass(frozen=True)
class ExactNeighbours:
    """Labelled rows that vote; scores rows by ``row_id``."""

    train: DataFrame
    features: list[str]
    label: str
    row_id: str
    k: int
    by_distance: bool = False

    def score(self, df: DataFrame, output: str) -> DataFrame:
        near = nearest_rows(self.train, df, self.features, self.label, self.row_id, self.k)
        votes = near.select(F.col("id").alias(self.row_id), vote(F.col("near"), self.by_distance).alias(output))
        return df.join(votes, self.row_id)
