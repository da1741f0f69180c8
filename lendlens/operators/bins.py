"""Features as codes of quantile bins."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from lendlens.operators.passes import DOUBLES, known, packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_BINS = 255
ACCURACY = 10_000


@dataclass(frozen=True)
class Bins:
    """A value's code is the number of edges below it: code <= i means value <= edges[i]."""

    features: list[str]
    edges: list[np.ndarray]

    @property
    def sizes(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]

    @property
    def size(self) -> int:
        return max((len(e) for e in self.edges), default=0) + 1

    def codes(self) -> Column:
        """The codes of all features, one byte each."""
        edges = self.edges

        @F.arrow_udf("binary")
        def code(rows: pa.Array) -> pa.Array:
            found = np.empty((len(rows), len(edges)), np.uint8)
            for i, e in enumerate(edges):
                found[:, i] = np.searchsorted(e, rows.field(i).to_numpy(zero_copy_only=False), side="left")
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(edges)
            return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(found.tobytes())])
        return code(F.struct(*self.features))


def few_values(rows: DataFrame, features: Sequence[str], most: int) -> dict[str, np.ndarray]:
    """All distinct values of the features that have at most ``most`` of them, ``rows`` being doubles.

    Tasks hold and send no more than ``most`` + 1 values of a feature.
    """
    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0)] * len(features)
        for batch in batches:
            for i, column in enumerate(batch.columns):
                if len(held[i]) <= most:
                    held[i] = np.unique(np.concatenate([held[i], column.to_numpy(zero_copy_only=False)]))[:most + 1]
        yield packed(range(len(features)), held, False)
    values = rows.mapInArrow(distinct, DOUBLES).select("key", F.explode("numbers").alias("value")).distinct()
    found = values.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("value")).alias("values"))
    lists = {r["key"]: r["values"] for r in found.select("key", F.when(F.col("n") <= most, F.col("values")).alias("values")).collect()}
    return {f: np.unique(np.array(lists.get(i, []), np.float64)) for i, f in enumerate(features) if lists.get(i, []) is not None}


def fit_bins(df: DataFrame, features: Sequence[str], most: int = MOST_BINS) -> Bins:
    """Edges at all values of a feature with at most ``most`` of them, else at quantiles.

    Quantiles come from sketches that tasks build and Spark merges.
    """
    if not 2 <= most <= 256:
        raise ValueError("a code has one byte: 2 to 256 bins")
    rows = df.select(*known(features, df))
    few = few_values(rows, features, most)
    many = [f for f in features if f not in few]
    shares = [i / most for i in range(1, most)]
    found = rows.agg(
        *[F.array_union(F.array(F.min(f)), F.percentile_approx(f, shares, ACCURACY)).alias(f) for f in many],
        *[F.max(f).alias(f"{f}__top") for f in many]).first() if many else {}
    edges = []
    for f in features:
        values = few[f][:-1] if f in few else np.unique([v for v in found[f] if v != found[f"{f}__top"]])
        if len(values) >= most:  # the least value comes on top of the quantiles
            values = values[np.unique(np.linspace(0, len(values) - 1, most - 1).astype(int))]
        edges.append(values.astype(np.float64))
    return Bins(list(features), edges)


def code_matrix(frame: pa.Array, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Codes of a struct of features, row by row."""
    return np.stack([np.searchsorted(e, frame.field(i).to_numpy(zero_copy_only=False), side="left")
                     for i, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(frame), 0), np.int64)


def score_column(features: Sequence[str], scorer) -> Column:
    """Applies ``scorer`` (matrix of doubles to scores) to the features, block by block."""
    @F.arrow_udf("double")
    def score(frames: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for frame in frames:
            x = np.stack([frame.field(i).to_numpy(zero_copy_only=False) for i in range(len(features))], 1).astype(np.float64)
            yield pa.array(scorer(x), pa.float64())
    return score(F.struct(*[F.col(f).cast("double").alias(f) for f in features]))
