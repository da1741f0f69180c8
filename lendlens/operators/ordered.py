"""Running totals, ranks and exact quantiles without a single-task sort.

Rows are first collapsed to one per distinct value, then cut into value ranges of
similar size. Running totals are taken inside each range and shifted by the totals
of the ranges before it, so no task ever orders a whole group. Quantiles collapse
all rows but those near them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlens.session import materialize, sized_table, with_scalars

ROWS_PER_RANGE = 1_000_000
ACCURACY = 10_000


def cut_points(df: DataFrame, value: str, rows_per_range: float = ROWS_PER_RANGE) -> list[float]:
    """Boundaries that split the values into similar parts; any boundaries give right results.

    The number of parts follows the number of rows, so a part stays as large as one task may sort.
    """
    values = df.select(F.col(value).cast("double").alias("v"))
    ranges = int(-(-values.agg(F.count("v")).first()[0] // rows_per_range))
    if ranges <= 1:
        return []
    shares = ", ".join(f"{i / ranges}D" for i in range(1, ranges))
    found = values.agg(F.expr(f"percentile_approx(v, array({shares}), {4 * ranges})").alias("grid")).first()
    return sorted(set(found["grid"]))


def with_range(df: DataFrame, value: str, rows_per_range: int = ROWS_PER_RANGE,
               points: list[float] | None = None) -> DataFrame:
    """Adds ``range_id``, the number of the value range, rising with the value."""
    if points is None:
        points = cut_points(df, value, rows_per_range)
    if not points:
        return df.withColumn("range_id", F.lit(0))
    ranged = Bucketizer(
        splits=[float("-inf"), *points, float("inf")], inputCol="range_value",
        outputCol="range_id", handleInvalid="keep",
    ).transform(df.withColumn("range_value", F.col(value).cast("double")))
    return ranged.withColumn("range_id", F.col("range_id").cast("int")).drop("range_value")


def running_totals(ranged: DataFrame, order: Sequence[Column], sums: dict[str, str],
                   by: Sequence[str] = (), descending: bool = False,
                   group_totals: dict[str, str] | None = None) -> DataFrame:
    """Adds inclusive running totals of ``sums`` (source column -> new column).

    ``ranged`` carries ``range_id``; ``order`` must follow it, in the same direction.
    ``group_totals`` adds whole-group sums. Both travel on the small table of one row per
    group and range, which is joined on the partitioning the window already made.
    """
    by, group_totals = list(by), group_totals or {}
    wanted = sorted({*sums, *group_totals})
    per_range = ranged.groupBy(*by, "range_id").agg(*[F.sum(c).alias(f"{c}__sum") for c in wanted])
    group = Window.partitionBy(*by)
    before = group.orderBy(F.desc("range_id") if descending else F.asc("range_id")).rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = per_range.select(
        *by, "range_id",
        *[F.coalesce(F.sum(f"{c}__sum").over(before), F.lit(0)).alias(f"{t}__shift")
          for c, t in sums.items()],
        *[F.sum(f"{c}__sum").over(group).alias(t) for c, t in group_totals.items()])
    inside = Window.partitionBy(*by, "range_id").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = ranged.select(
        "*", *[F.sum(c).over(inside).alias(f"{t}__inside") for c, t in sums.items()])
    joined = rows.join(shifts, [*by, "range_id"])
    return joined.withColumns({
        t: F.col(f"{t}__inside") + F.col(f"{t}__shift") for t in sums.values()
    }).drop(*[f"{t}__{part}" for t in sums.values() for part in ("inside", "shift")])


def brackets(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str],
             accuracy: int) -> DataFrame:
    """Per group and named quantile a lower and an upper value around it, from one pass of sketches.

    An estimate errs by one part in ``accuracy`` of the rows; the bracket reaches twice as far.
    """
    reach = 2.0 / accuracy
    ends = [min(max(p + side, 0.0), 1.0) for p in probabilities.values() for side in (-reach, reach)]
    found = df.groupBy(*by).agg(F.percentile_approx(value, ends, accuracy).alias("__ends"))
    return found.select(*by, *[F.col("__ends")[2 * i + j].alias(f"__{side}_{name}")
                               for i, name in enumerate(probabilities) for j, side in enumerate(("low", "high"))])


def near_quantiles(df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str],
                   accuracy: int) -> DataFrame:
    """Per group and named quantile the counts of the distinct values inside its bracket.

    All values below the bracket are one row at the greatest of them, all above one row at the
    smallest: a quantile lies at most one rank outside its bracket. Only these rows are shuffled.
    """
    ends = brackets(df, value, probabilities, by, accuracy)
    placed = df.join(sized_table(ends), list(by)) if by else with_scalars(df, ends)
    around = F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.col(f"__low_{name}").alias("low"), F.col(f"__high_{name}").alias("high"))
        for name in probabilities]))
    cells = placed.select(*by, value, around.alias("__around")).select(*by, value, "__around.*")
    x = F.col(value)
    side = F.when(x < F.col("low"), -1).when(x > F.col("high"), 1).otherwise(0)
    collapsed = cells.groupBy(*by, "name", side.alias("side"), F.when(side == 0, x).alias("inside")).agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"))
    return collapsed.select(*by, "name", "n", F.when(F.col("side") < 0, F.col("most")).otherwise(F.col("least")).alias(value))


def collapsed_ranges(counts: DataFrame, value: str, rows_per_range: int,
                     points: list[float] | None) -> DataFrame:
    """Counts per distinct value with their ranges.

    Without known cut points the counts are written once, so the rows below them are read
    only once; the cut points then balance distinct values, however often one occurs.
    """
    if points is not None:
        return with_range(counts, value, rows_per_range, points)
    return with_range(materialize(counts, "counts"), value, rows_per_range)


def quantile_parts(name: str, p: float, value: Column) -> tuple[list[Column], Column]:
    """Aggregates over value totals, and the interpolated quantile made from them."""
    place = (F.col("size") - 1) * F.lit(float(p))
    low, high = F.col(f"{name}__lo"), F.col(f"{name}__hi")
    aggregates = [
        F.min(F.when(F.col("upto") > F.floor(place), value)).alias(f"{name}__lo"),
        F.min(F.when(F.col("upto") > F.ceil(place), value)).alias(f"{name}__hi"),
    ]
    return aggregates, low + (high - low) * (place - F.floor(place))


def exact_quantiles(df: DataFrame, value: str, probabilities: dict[str, float],
                    by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE,
                    accuracy: int = ACCURACY) -> DataFrame:
    """Linearly interpolated quantiles, one column per named probability; null and NaN are missing.

    A first pass brackets each quantile, a second one counts what lies below and keeps the values
    inside, so neither pass shuffles or writes the column. The result does not depend on ``accuracy``.
    """
    by, number = list(by), F.col(value).cast("double")
    known = df.select(*by, number.alias(value)).where(number.isNotNull() & ~F.isnan(number))
    counts = near_quantiles(known, value, probabilities, by, accuracy)
    ranged = collapsed_ranges(counts, value, rows_per_range, None)
    totals = running_totals(ranged, [F.asc(value)], {"n": "upto"}, [*by, "name"], group_totals={"n": "size"})
    aggregates, results = [], []
    for name, p in probabilities.items():
        parts, result = quantile_parts(name, p, F.when(F.col("name") == name, F.col(value)))
        aggregates += parts
        results.append(result.alias(name))
    return totals.groupBy(*by).agg(F.max("size").alias("size"), *aggregates).select(*by, *results)


def unpivot_numeric(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (column, value) of numeric columns."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ]))
    return df.select(*keep, parts.alias("cell")).select(*keep, "cell.column", "cell.value")


def unpivot_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    parts = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    return df.select(parts.alias("cell")).select("cell.column", "cell.value")
