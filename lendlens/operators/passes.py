"""Passes over all rows: tasks reduce their rows to small arrays, which are combined on executors.

Functions of the learning modules are pickled by value, so executors need the installed libraries only.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_ROWS = 1 << 16
ROWS_PER_TASK = 100_000
# A row of partial results: which array, and its numbers.
LONGS, DOUBLES = "key long, numbers array<long>", "key long, numbers array<double>"

Chunk = dict[str, np.ndarray]


def packed(keys: Sequence[int], arrays: Sequence[np.ndarray], longs: bool) -> pa.RecordBatch:
    kind = pa.int64() if longs else pa.float64()
    flat = np.concatenate([np.asarray(a).ravel() for a in arrays]) if arrays else np.zeros(0)
    ends = np.concatenate([[0], np.cumsum([np.size(a) for a in arrays])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(keys, np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))],
        names=["key", "numbers"])


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    numbers = batch.column("numbers")
    flat, ends = numbers.flatten().to_numpy(zero_copy_only=False), numbers.offsets.to_numpy()
    for i, key in enumerate(batch.column("key").to_pylist()):
        yield key, flat[ends[i] - ends[0]:ends[i + 1] - ends[0]]


def column_values(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A column as numbers; lists and binaries (of bytes) of equal width as a matrix."""
    if pa.types.is_binary(column.type):
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
        return data.reshape(len(column), -1 if width is None else width)
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1 if width is None else width)
    return column.to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch], widths: dict[str, int], rows: int = CHUNK_ROWS) -> Iterator[Chunk]:
    """Batches joined to larger chunks of columns as numpy arrays."""
    held, size = [], 0

    def made() -> Chunk:
        table = pa.Table.from_batches(held)
        return {n: column_values(pa.concat_arrays(table[n].chunks), widths.get(n)) for n in table.column_names}
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= rows:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def dealt(df: DataFrame, rows: int, models: int = 1) -> DataFrame:
    """Rows in tasks of a sensible size: few for few rows, else as large as Spark's advisory size."""
    most = df.sparkSession.sparkContext.defaultParallelism
    if rows >= most * ROWS_PER_TASK:
        return df.hint("rebalance")
    return df.repartition(min(most, max(1, -(-rows * models // ROWS_PER_TASK))))


def task_count(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()


def combined(df: DataFrame, reduce_task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], longs: bool,
             finish: Callable[[dict[int, np.ndarray]], Iterator[pa.RecordBatch]] | None = None,
             schema: str | None = None, smallest: bool = False, tasks: int | None = None) -> DataFrame:
    """Adds (or takes the smallest of) the arrays of all tasks by key, on executors.

    ``finish`` turns the arrays of the keys that met in a task into rows of ``schema``. Arrays are
    bounded by what one key holds, not by the rows. With a single one of ``tasks`` nothing is shuffled.
    """
    kind = LONGS if longs else DOUBLES
    partial = df.mapInArrow(reduce_task, kind)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, numbers in unpacked(batch):
                if key not in held:
                    held[key] = numbers.copy()
                elif smallest:
                    np.minimum(held[key], numbers, out=held[key])
                else:
                    held[key] += numbers
        if held:
            yield from finish(held) if finish else [packed(list(held), list(held.values()), longs)]
    return (partial if tasks == 1 else partial.repartition("key")).mapInArrow(merge, schema or kind)


def known(features: Sequence[str], df: DataFrame) -> list[Column]:
    """Feature columns as doubles; a missing value fails, as in the other fits."""
    found = []
    for f in features:
        x = F.col(f).cast("double")
        bad = F.raise_error(F.lit(f"{f} is missing")).cast("double")
        found.append(F.when(x.isNull() | F.isnan(x), bad).otherwise(x).alias(f))
    return found
