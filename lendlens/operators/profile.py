"""Profiling: summaries, correlations, validation and drift."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lendlens.functions.numeric import adjusted_skewness, half_even, safe_corr
from lendlens.operators.clean import (
    SURE_FACTOR, estimated_cardinalities, missing_report, numeric_columns,
)
from lendlens.operators.encode import level_counts
from lendlens.operators.ordered import exact_quantiles, unpivot_numeric
from lendlens.session import sized_table, with_scalars

QUARTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75}


def per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """One aggregate pass, one output row per column; ``measures``: name -> function of column name."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[m(c).alias(name) for name, m in measures.items()])
        for c in columns
    ])
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("cell")).select("cell.*")


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    moments = per_column(df, columns, {
        "count": F.count, "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(F.col(c).cast("double")),
        "max": lambda c: F.max(F.col(c).cast("double")),
    })
    cells = unpivot_numeric(df, columns).withColumnRenamed("column", "feature")
    return moments.join(exact_quantiles(cells, "value", QUARTILES, ["feature"]), "feature", "left")


def business_metrics(df: DataFrame, exact: bool = True) -> DataFrame:
    """Totals over all transactions; quartiles exact or estimated in the same pass."""
    names = {f"{q}_transaction_amount": p for q, p in QUARTILES.items()}
    totals = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.count_distinct("customer_id").alias("unique_customers"),
        F.avg("amount").alias("avg_transaction_amount"),
        F.stddev_samp("amount").alias("std_transaction_amount"),
        F.min("amount").alias("min_transaction_amount"),
        F.max("amount").alias("max_transaction_amount"),
        F.min("transaction_timestamp").alias("earliest_transaction"),
        F.max("transaction_timestamp").alias("latest_transaction"),
        *[] if exact else [F.percentile_approx("amount", p).alias(q) for q, p in names.items()])
    return with_scalars(totals, exact_quantiles(df, "amount", names)) if exact else totals


def categorical_candidates(df: DataFrame, max_ratio: float = 0.1, max_levels: int = 50,
                           examples: int = 5) -> DataFrame:
    """Columns with few levels, with their most frequent values in order.

    Columns that are far beyond the limit by estimate are not counted value by value.
    """
    estimates = estimated_cardinalities(df, df.columns)
    counts = level_counts(df, [c for c in df.columns if estimates[c] <= max_levels * SURE_FACTOR])
    columns = counts.groupBy("column").agg(
        F.count("value").alias("unique_count"), F.sum("n").alias("rows"))
    ratio = F.try_divide(F.col("unique_count").cast("double"), F.col("rows").cast("double"))
    few = columns.where((ratio < max_ratio) & (F.col("unique_count") < max_levels)).select(
        "column", "unique_count", half_even(ratio, 3).alias("unique_ratio"))
    # Only columns with few levels reach this window, so a partition stays below max_levels rows.
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    top = (
        counts.where(F.col("value").isNotNull()).join(sized_table(few.select("column")), "column")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= examples)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("top"))
        .select("column", F.concat_ws("|", F.col("top.value")).alias("sample_values"))
    )
    return few.join(top, "column", "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Frequency and share per level, nulls left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(column).alias("total"))
    return with_scalars(counts, total).select(
        F.lit(column).alias("feature"), F.col(column).cast("string").alias("level"), "count",
        (F.col("count") / F.col("total")).alias("share"))


def uniformity_cv(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spread over mean of the level counts per column."""
    counts = level_counts(df, columns).where(F.col("value").isNotNull())
    return counts.groupBy("column").agg(
        F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("coefficient_of_variation"))


def pair_correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    cells = F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                 safe_corr(F.col(a), F.col(b)).alias("correlation")) for a, b in pairs
    ])
    return df.agg(cells.alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def target_correlations(df: DataFrame, target: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every numeric column with the target, strongest first."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    rows = per_column(df, columns, {"correlation": lambda c: safe_corr(F.col(c), F.col(target))})
    strength = F.abs("correlation")
    return rows.withColumns({
        "above_10": F.coalesce(strength > 0.1, F.lit(False)),
        "above_05": F.coalesce(strength > 0.05, F.lit(False)),
    }).orderBy(F.desc_nulls_last(strength), "feature")


def topk_abs_correlation(correlations: DataFrame, k: int) -> DataFrame:
    return correlations.orderBy(F.desc_nulls_last(F.abs("correlation")), "feature").limit(k)


GRAM_SUMS = ("n", "si", "sj", "sij", "sii", "sjj")


def gram_partials(df: DataFrame, columns: Sequence[str], shifts: Sequence[float],
                  part: str | None = None) -> DataFrame:
    """Per pair of columns (and per value of ``part``) the sums over rows where both are known.

    Each task folds its Arrow batches into a few small matrices and emits one row per
    pair; only these partial sums are shuffled. Shifting by the means keeps the sums small.
    ``part`` is a small integer such as a fold number.
    """
    columns, shift = list(columns), np.asarray(shifts, dtype="float64")
    width = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.triu_indices(width)
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.column_stack([
                batch.column(i + 1).to_numpy(zero_copy_only=False).astype("float64")
                for i in range(width)
            ])
            parts = batch.column(0).to_numpy(zero_copy_only=False)
            for number in np.unique(parts):
                rows = values[parts == number]
                known = ~np.isnan(rows)
                mask = known.astype("float64")
                x = np.where(known, rows - shift, 0.0)
                squares = x * x
                acc = sums.setdefault(int(number), np.zeros((len(GRAM_SUMS), width, width)))
                for total, (a, b) in zip(acc, [(mask, mask), (x, mask), (mask, x), (x, x),
                                               (squares, mask), (mask, squares)]):
                    total += a.T @ b
        for number, acc in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(pairs[0]), number), pa.int32()),
                 pa.array(pairs[0], pa.int32()), pa.array(pairs[1], pa.int32()),
                 *[pa.array(a[pairs], pa.float64()) for a in acc]],
                names=["part", "i", "j", *GRAM_SUMS])

    number = F.col(part).cast("int") if part else F.lit(0)
    partials = df.select(number.alias("part"), *[F.col(c).cast("double") for c in columns]).mapInArrow(
        fold, "part int, i int, j int, " + ", ".join(f"{c} double" for c in GRAM_SUMS))
    return partials.groupBy("part", "i", "j").agg(*[F.sum(c).alias(c) for c in GRAM_SUMS])


def column_means(df: DataFrame, columns: Sequence[str]) -> list[float]:
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return [0.0 if v is None else float(v) for v in row]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature_a, feature_b, correlation) for all pairs a < b in column order."""
    columns = list(columns or numeric_columns(df))
    sums = gram_partials(df, columns, column_means(df, columns)).where("i < j")
    n = F.nullif(F.col("n"), F.lit(0.0))
    cov = F.col("sij") - F.col("si") * F.col("sj") / n
    var_a = F.col("sii") - F.col("si") * F.col("si") / n
    var_b = F.col("sjj") - F.col("sj") * F.col("sj") / n
    # What rounding leaves of a constant column's variance counts as zero.
    spread = F.when((var_a > 1e-12 * F.col("sii")) & (var_b > 1e-12 * F.col("sjj")),
                    F.sqrt(F.abs(var_a)) * F.sqrt(F.abs(var_b)))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select(
        F.element_at(names, F.col("i") + 1).alias("feature_a"),
        F.element_at(names, F.col("j") + 1).alias("feature_b"),
        F.try_divide(cov, spread).alias("correlation"))


def high_correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None,
                           limit: float = 0.8) -> DataFrame:
    matrix = correlation_matrix(df, columns).withColumn("correlation", F.abs("correlation"))
    return matrix.where(F.col("correlation") > limit).withColumn(
        "correlation", half_even(F.col("correlation"), 3))


def constant_features(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns whose deviation is zero: at least two rows, all alike."""
    columns = list(columns or numeric_columns(df))
    rows = per_column(df, columns, {
        "constant": lambda c: (F.count(c) > 1) & (F.min(c) == F.max(c))})
    return rows.where("constant").select("feature")


def skew_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: float = 5.0) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    rows = per_column(df, columns, {"skewness": lambda c: adjusted_skewness(F.col(c))})
    return rows.where(F.abs("skewness") > limit).withColumn(
        "skewness", half_even(F.col("skewness"), 2))


def validate_features(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Long report (check, feature, other, value) over a customer feature table."""
    features = df.drop(key)
    columns = numeric_columns(features)
    nothing = F.lit(None).cast("string")

    def lines(rows: DataFrame, check: str, value, other=nothing) -> DataFrame:
        return rows.select(F.lit(check).alias("check"), F.col("feature"), other.alias("other"),
                           value.cast("double").alias("value"))

    sizes = features.agg(F.count(F.lit(1)).alias("rows"))
    report = sizes.select(
        F.lit("feature_count").alias("check"), nothing.alias("feature"), nothing.alias("other"),
        F.lit(float(len(features.columns))).alias("value"),
    ).unionByName(sizes.select(
        F.lit("customer_count").alias("check"), nothing.alias("feature"), nothing.alias("other"),
        F.col("rows").cast("double").alias("value")))
    missing = missing_report(features).withColumnRenamed("column", "feature")
    report = report.unionByName(lines(missing, "missing_percent", F.col("missing_percent")))
    report = report.unionByName(lines(constant_features(features, columns), "constant", F.lit(0.0)))
    report = report.unionByName(lines(
        skew_outliers(features, columns), "skewness", F.col("skewness")))
    if len(columns) > 1:
        pairs = high_correlation_pairs(features, columns).withColumnRenamed("feature_a", "feature")
        report = report.unionByName(lines(
            pairs, "high_correlation", F.col("correlation"), F.col("feature_b")))
    return report


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line and Pearson correlation of two columns."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    slope = F.try_divide(F.covar_pop(a, b), F.var_pop(F.when(b.isNotNull(), a)))
    both = a.isNotNull() & b.isNotNull()
    return df.agg(
        slope.alias("slope"),
        (F.avg(F.when(both, b)) - slope * F.avg(F.when(both, a))).alias("intercept"),
        safe_corr(a, b).alias("correlation"))


def drift_baseline(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Mean, deviation and range per feature on the training rows, with target rate and size."""
    rows = per_column(df, columns, {
        "mean": F.avg, "std": F.stddev_samp,
        "min": lambda c: F.min(F.col(c).cast("double")),
        "max": lambda c: F.max(F.col(c).cast("double")),
        "default_rate": lambda c: F.avg(target), "total_samples": lambda c: F.count(F.lit(1)),
    })
    return rows


def drift_check(batch: DataFrame, baseline: DataFrame, columns: Sequence[str],
                limit: float = 0.1) -> DataFrame:
    """Shift of each mean in baseline deviations, and values outside the baseline range."""
    current = per_column(batch, columns, {
        "batch_mean": F.avg,
        "batch_min": lambda c: F.min(F.col(c).cast("double")),
        "batch_max": lambda c: F.max(F.col(c).cast("double")),
    })
    shift = F.try_divide(F.col("batch_mean") - F.col("mean"), F.col("std"))
    return current.join(baseline, "feature").select(
        "feature", "mean", "batch_mean", shift.alias("shift"),
        F.coalesce(F.abs(shift) > limit, F.lit(False)).alias("drifted"),
        ((F.col("batch_min") < F.col("min")) | (F.col("batch_max") > F.col("max"))).alias("out_of_range"))
