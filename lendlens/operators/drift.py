"""Drift of distributions: population stability index and Kolmogorov-Smirnov distance.

A baseline holds, per feature, a mergeable quantile sketch and the counts of its bins. Sketches of
days or shards merge before the bins are cut; counts of equal bins add up. Missing values are a bin of
their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from lendlens.operators.passes import combined, packed
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BINS = 10
SIZE = 4096  # of a sketch; quantiles of at most about this many rows are exact
FLOOR = 1e-4  # least share of a bin, so that empty ones keep the index finite
PSI_LIMIT, KS_LIMIT = 0.2, 0.1


def sketches(df: DataFrame, features: Sequence[str], size: int = SIZE) -> DataFrame:
    """(feature, sketch) of the known values; a feature without any has no sketch."""
    def value(f: str):
        x = F.col(f).cast("double")
        return F.when(~F.isnan(x), x)
    found = df.agg(*[F.kll_sketch_agg_double(value(f), F.lit(size)).alias(f) for f in features], *[F.count(value(f)).alias(f"{f}__n") for f in features])
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("sketch"), F.col(f"{f}__n").alias("n")) for f in features]))
    return found.select(cells.alias("c")).select("c.feature", "c.sketch", "c.n").where("n > 0").drop("n")


def merge_sketches(parts: DataFrame) -> DataFrame:
    return parts.groupBy("feature").agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def cut_bins(parts: DataFrame, bins: int = BINS) -> dict[str, list[float]]:
    """Rising distinct quantiles per feature; bin i holds values up to edge i, the last one the rest."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    rows = parts.select("feature", F.kll_sketch_get_quantile_double("sketch", shares).alias("edges")).collect()
    return {r["feature"]: sorted(set(r["edges"])) for r in rows}


def bin_counts(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(feature, bin, n): bin -1 counts missing values, every bin has a row."""
    features = list(edges)
    cuts = [np.array(edges[f]) for f in features]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(c) + 2, np.int64) for c in cuts]
        for batch in batches:
            for i, c in enumerate(cuts):
                x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.where(np.isnan(x), 0, np.searchsorted(c, x, side="left") + 1)
                totals[i] += np.bincount(at, minlength=len(c) + 2)
        yield packed(range(len(cuts)), totals, True)
    sums = combined(df.select([F.col(f).cast("double").alias(f) for f in features]), count, True)
    names = F.array(*[F.lit(f) for f in features])
    return sums.select(F.get(names, F.col("key").cast("int")).alias("feature"), F.posexplode("numbers").alias("at", "n")).select(
        "feature", (F.col("at") - 1).cast("int").alias("bin"), "n")


def distribution_baseline(df: DataFrame, features: Sequence[str], bins: int = BINS, size: int = SIZE) -> tuple[dict[str, list[float]], DataFrame]:
    """Edges and the written counts per bin of the training rows."""
    edges = cut_bins(sketches(df, features, size), bins)
    return edges, materialize(bin_counts(df, edges), "baseline")


def distribution_drift(batch: DataFrame, edges: dict[str, list[float]], baseline: DataFrame, psi_limit: float = PSI_LIMIT,
                       ks_limit: float = KS_LIMIT) -> DataFrame:
    """Per feature the stability index over all bins, the greatest distance of the cumulated shares of
    known values at an edge, and the shares of missing values."""
    both = baseline.withColumnRenamed("n", "a").join(bin_counts(batch, edges).withColumnRenamed("n", "b"), ["feature", "bin"])
    whole = Window.partitionBy("feature")  # as many rows as a feature has bins
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    known = lambda c: F.when(F.col("bin") >= 0, F.col(c)).otherwise(0)
    share = lambda c: F.try_divide(F.col(c).cast("double"), F.sum(c).over(whole))
    cumulated = lambda c: F.try_divide(F.sum(known(c)).over(upto).cast("double"), F.sum(known(c)).over(whole))
    rows = both.select("feature", "bin", share("a").alias("p"), share("b").alias("q"), F.abs(cumulated("a") - cumulated("b")).alias("gap"))
    p, q = F.greatest("p", F.lit(FLOOR)), F.greatest("q", F.lit(FLOOR))
    found = rows.groupBy("feature").agg(
        F.sum((q - p) * F.log(q / p)).alias("psi"), F.max("gap").alias("ks"),
        F.max(F.when(F.col("bin") < 0, F.col("p"))).alias("baseline_missing"), F.max(F.when(F.col("bin") < 0, F.col("q"))).alias("batch_missing"))
    return found.withColumn("drifted", (F.col("psi") > psi_limit) | F.coalesce(F.col("ks") > ks_limit, F.lit(False)))
