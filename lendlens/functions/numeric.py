"""Arithmetic that behaves like the expected results under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed pattern: what counts as a number written as text.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def clipped(value: Column, lower: float, upper: float) -> Column:
    return (
        F.when(value.isNull() | F.isnan(value), F.lit(None).cast("double"))
        .when(value < lower, F.lit(float(lower)))
        .when(value > upper, F.lit(float(upper)))
        .otherwise(value)
    )


def bounded_ratio(numerator: Column, denominator: Column, upper: float) -> Column:
    """Ratio limited to [0, upper]; x/0 goes to the limit in the sign of x, unknown is 0."""
    by_sign = F.when(numerator > 0, F.lit(float(upper))).otherwise(F.lit(0.0))
    value = F.when(denominator == 0, by_sign).otherwise(
        clipped(ratio(numerator, denominator), 0.0, upper)
    )
    return F.coalesce(value, F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end rounded down, so one hour before is -1."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86400 * 1000000)).cast("long")


def parse_number(text: Column) -> Column:
    text = text.cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; null when one side is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def adjusted_skewness(value: Column) -> Column:
    """Bias-adjusted skewness: null below three rows, 0 for a constant."""
    n = F.count(value).cast("double")
    spread = F.stddev_pop(value.cast("double"))
    # The built-in skewness divides by the spread, so constants are answered before it matters.
    raw = F.skewness(value.cast("double"))
    return F.when(n < 3, F.lit(None).cast("double")).when(spread == 0, F.lit(0.0)).otherwise(
        raw * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    )


def sigmoid(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
