"""Embedding whitening by spectrum slicing.

The covariance of the distinct vectors is summed by Spark, one row of the matrix per group, so the
driver gets no more than the matrix: as many doubles as the square of a vector's width. There the
inertia of LDL' factors of the shifted matrix counts the eigenvalues above a shift. Bisection by such
counts encloses each leading eigenvalue alone, Rayleigh quotient iteration inside the enclosure
converges cubically to it, and the counts at both ends certify its number.

Defined cases: vectors that are null, empty, or hold null or non-finite entries are left out, as are
vectors of another length than the most frequent (of several, the longest). 64 times an entry is
limited to 2^52 in size, far beyond any embedding. Components of no variance are not returned, so
equal vectors, one vector or none give no rows. A deviation beyond a long is null. Null ids and
repeated rows stay. Eigenvectors of equal eigenvalues are any orthonormal basis of their space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lendlens.session import materialize

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LIMIT = float(1 << 52)
LOW_BITS = 26
EPS = float(np.finfo(float).eps)


# Spectrum slicing ----------------------------------------------------------------------------


def positive_pivots(a: np.ndarray) -> int:
    """Number of positive eigenvalues, read off the LDL' factors with pivots of one or two rows."""
    a, n, k, found = a.copy(), len(a), 0, 0
    bound = (1 + np.sqrt(17)) / 8

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
    while k < n:
        below = np.abs(a[k + 1:, k])
        most = below.max() if len(below) else 0.0
        two = False
        if max(abs(a[k, k]), most) == 0:
            k += 1
            continue
        if abs(a[k, k]) < bound * most:
            r = k + 1 + int(below.argmax())
            row = np.abs(a[k:, r])
            row[r - k] = 0
            other = row.max()
            if abs(a[k, k]) * other >= bound * most * most:
                pass
            elif abs(a[r, r]) >= bound * other:
                swap(k, r)
            else:
                swap(k + 1, r)
                two = True
        if two:
            block, rest = a[k:k + 2, k:k + 2], a[k + 2:, k:k + 2]
            found += 1 if block[0, 0] * block[1, 1] < block[0, 1] ** 2 else 2 * int(block[0, 0] > 0)
            a[k + 2:, k + 2:] -= rest @ np.linalg.solve(block, rest.T)
            k += 2
        else:
            found += int(a[k, k] > 0)
            rest = a[k + 1:, k]
            a[k + 1:, k + 1:] -= np.outer(rest, rest / a[k, k])
            k += 1
    return found


@dataclass
class Slices:
    """Counts of eigenvalues above shifts, kept so that enclosures of neighbours share them."""

    matrix: np.ndarray

    def __post_init__(self) -> None:
        self.norm = float(np.abs(self.matrix).sum(1).max()) if len(self.matrix) else 0.0
        self.known = {-2 * self.norm - 1: len(self.matrix), 2 * self.norm + 1: 0}

    def above(self, shift: float) -> int:
        if shift not in self.known:
            self.known[shift] = positive_pivots(self.matrix - shift * np.eye(len(self.matrix)))
        return self.known[shift]

    def enclosure(self, number: int) -> tuple[float, float]:
        """Ends of an interval with the eigenvalue of this number alone in it, if any is wide enough."""
        low = max(s for s, n in self.known.items() if n >= number)
        high = min(s for s, n in self.known.items() if n < number)
        while high - low > 32 * EPS * self.norm and self.above(low) - self.above(high) > 1:
            low, high = self.halved(low, high, number)
        return low, high

    def halved(self, low: float, high: float, number: int) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, high) if self.above(middle) >= number else (low, middle)


def nearly_solved(matrix: np.ndarray, shift: float, right: np.ndarray, step: float) -> np.ndarray:
    """(matrix - shift) \\ right, the shift moved by a rounding error where the matrix is singular."""
    for moved in (0.0, step, -step, 3 * step):
        try:
            found = np.linalg.solve(matrix - (shift + moved) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    return right


def leading_pair(slices: Slices, number: int, before: np.ndarray, rng: np.random.Generator) -> tuple[float, np.ndarray]:
    """Eigenvalue and unit vector of one number, whose enclosure holds no other eigenvalue."""
    matrix, norm = slices.matrix, slices.norm
    low, high = slices.enclosure(number)
    for _ in range(200):
        x = rng.normal(size=len(matrix))
        x -= before @ (before.T @ x)
        x /= np.linalg.norm(x)
        for _ in range(2):
            x = nearly_solved(matrix, (low + high) / 2, x, EPS * norm)
            x /= np.linalg.norm(x)
        best = None
        for _ in range(12):
            value = float(x @ matrix @ x)
            rest = float(np.linalg.norm(matrix @ x - value * x))
            if not low - EPS * norm <= value <= high + EPS * norm:
                break
            if best is None or rest < best[0]:
                best = (rest, value, x)
            elif best[0] <= 64 * EPS * norm:
                break
            x = nearly_solved(matrix, value, x, EPS * norm)
            x /= np.linalg.norm(x)
        if best and best[0] <= 256 * EPS * norm:
            return best[1], best[2]
        if high - low <= 32 * EPS * norm:
            return (best[1], best[2]) if best else (float(x @ matrix @ x), x)
        low, high = slices.halved(low, high, number)
    raise ArithmeticError(f"no convergence to eigenvalue {number}")


def cluster_pairs(slices: Slices, low: float, high: float, size: int, before: np.ndarray,
                  rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Values and vectors of eigenvalues that no shift of this precision can part."""
    x = rng.normal(size=(len(slices.matrix), size))
    for _ in range(6):
        x -= before @ (before.T @ x)
        x = np.linalg.qr(nearly_solved(slices.matrix, (low + high) / 2, x, 8 * EPS * slices.norm))[0]
    return np.einsum("ij,ij->j", x, slices.matrix @ x), x


def leading_eigenpairs(matrix: np.ndarray, most: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues, falling, and their unit vectors; those of no size are left out."""
    matrix = (matrix + matrix.T) / 2
    width = len(matrix)
    slices, rng = Slices(matrix), np.random.default_rng(seed)
    values, vectors = [], np.zeros((width, 0))
    floor = 8 * width * EPS * slices.norm
    wanted = min(most, slices.above(floor)) if slices.norm > 0 else 0
    while len(values) < wanted:
        number = len(values) + 1
        low, high = slices.enclosure(number)
        alone = slices.above(low) - slices.above(high)
        if alone > 1:
            value, vector = cluster_pairs(slices, low, high, alone, vectors, rng)
            values += list(value)
            vectors = np.hstack([vectors, vector])
            continue
        value, vector = leading_pair(slices, number, vectors, rng)
        slack = 64 * EPS * slices.norm
        if not (slices.above(value - slack) >= number > slices.above(value + slack)):
            raise ArithmeticError(f"eigenvalue {number} is not certified")
        values.append(value)
        vectors = np.hstack([vectors, vector[:, None]])
    values, vectors = np.array(values[:wanted]), vectors[:, :wanted]
    heads = vectors[np.abs(vectors).argmax(0), np.arange(wanted)] if wanted else np.ones(0)
    return values, vectors * np.where(heads < 0, -1.0, 1.0)


# Sums over all vectors -----------------------------------------------------------------------


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def exact_sums(distinct: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and their sum per dimension, from sums of high and low parts."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            y = matrix_of(batch.column(0), width)
            rows += len(y)
            high += (y >> LOW_BITS).sum(0)
            low += (y & ((1 << LOW_BITS) - 1)).sum(0)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width)), pa.array(np.full(width, rows)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])
    parts = distinct.mapInArrow(partial, "i long, n long, high long, low long")
    found = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).orderBy("i").collect()
    return (found[0]["n"] if found else 0), [(r["high"] << LOW_BITS) + r["low"] for r in found]


def summed_products(distinct: DataFrame, width: int, project: Callable[[np.ndarray], np.ndarray], out: int) -> np.ndarray:
    """Sum over all vectors of the outer product of `project(vector)`, an `out` by `out` matrix.

    Tasks send one row per row of the matrix; rows of one number meet in one task and are added there.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros((out, out)), False
        for batch in batches:
            if batch.num_rows:
                z, some = project(matrix_of(batch.column(0), width)), True
                total += z.T @ z
        if some:
            yield rows_of(np.arange(out), total)

    def rows_of(index: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(index) + 1, dtype=np.int32) * out), pa.array(total.ravel()))
        return pa.RecordBatch.from_arrays([pa.array(index.astype(np.int64)), lists], names=["i", "row"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = batch.column("row").flatten().to_numpy(zero_copy_only=False).reshape(-1, out)
            for i, row in zip(batch.column("i").to_pylist(), rows):
                sums[i] = sums[i] + row if i in sums else row.copy()
        if sums:
            yield rows_of(np.array(list(sums)), np.stack(list(sums.values())))
    schema = "i long, row array<double>"
    found = distinct.mapInArrow(partial, schema).repartition("i").mapInArrow(added, schema).collect()
    total = np.zeros((out, out))
    for r in found:
        total[r["i"]] = r["row"]
    return total


def scaled_vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Adds `_y`, floor(64 * entry) per entry, to the rows that stay, and returns the width."""
    entries = F.col(vector).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(entries, lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-LIMIT)), F.lit(LIMIT))).cast("long"))
    rows = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(finite).withColumn("_y", whole)
    facts = rows.groupBy(F.size("_y").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.greatest(F.array_max("_y"), -F.array_min("_y"))).alias("most")) \
        .orderBy(F.desc("n"), F.desc("width")).first()
    if facts is None:
        return rows, 0
    # The narrowest type that holds all values, for the shuffle of the distinct vectors.
    kind = "smallint" if facts["most"] < 1 << 15 else "int" if facts["most"] < 1 << 31 else "bigint"
    return rows.where(F.size("_y") == facts["width"]).withColumn("_y", F.col("_y").cast(f"array<{kind}>")), facts["width"]


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error of each vector and leading component.

    All statistics are over the distinct scaled vectors, x = floor(64 * entry) + 1000000; the shift
    cancels in every result, so the sums are taken without it.
    """
    kind = df.schema[key].dataType.simpleString()
    rows, width = scaled_vectors(df.select(key, vector), vector)
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return df.sparkSession.createDataFrame([], schema)
    distinct = materialize(rows.select("_y").distinct(), "distinct")
    n, sums = exact_sums(distinct, width)
    mean = np.array([float(Fraction(s, n)) for s in sums])
    covariance = summed_products(distinct, width, lambda y: y - mean, width) / n
    values, vectors = leading_eigenpairs(covariance, most)
    trace, scale = float(np.trace(covariance)), vectors / np.sqrt(values)
    size = len(values)
    identity = summed_products(distinct, width, lambda y: (y - mean) @ scale, size) / n if size else np.zeros((0, 0))
    error = float(np.abs(identity - np.eye(size)).max()) if size else 0.0
    explained = values / trace if size else values

    def deviations(y: np.ndarray) -> list[int | None]:
        largest = max(n * int(np.abs(y).max()) + max(abs(s) for s in sums), 1)
        if largest ** 2 * width < 1 << 63:
            return ((n * y - np.array(sums, np.int64)) ** 2).sum(1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in y]
        return [v if v < 1 << 63 else None for v in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (batch.num_rows and size):
                continue
            y = matrix_of(batch.column(1), width)
            again = pa.array(np.repeat(np.arange(len(y)), size))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(again), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(y))),
                pa.array(np.full(len(y) * size, n)), pa.array(deviations(y), pa.int64()).take(again),
                pa.array(((y - mean) @ scale).ravel()), pa.array(np.tile(explained, len(y))),
                pa.array(np.full(len(y) * size, error))],
                names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.select(key, "_y").mapInArrow(project, schema)
