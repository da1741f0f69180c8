"""Category encoders, split into a fit that reads data and a transform that is a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.constants import BOOLEAN_COLUMNS, NOMINAL_COLUMNS, ORDINAL_LEVELS, UNKNOWN_CODE
from lendlens.operators.ordered import unpivot_text
from lendlens.session import sized_table

MAX_LEVELS = 10_000
MISSING_LEVEL = "None"


def ordinal_code(column: str, levels: Sequence[str]) -> Column:
    code = F.lit(UNKNOWN_CODE)
    for i, level in reversed(list(enumerate(levels))):
        code = F.when(F.col(column) == level, F.lit(float(i))).otherwise(code)
    return code


def ordinal_encode(df: DataFrame, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds ``<column>_encoded``; unknown levels and nulls become -1."""
    levels = levels or ORDINAL_LEVELS
    return df.withColumns({
        f"{c}_encoded": ordinal_code(c, known) for c, known in levels.items() if c in df.columns
    })


def bool_to_int(df: DataFrame, columns: Sequence[str] = tuple(BOOLEAN_COLUMNS)) -> DataFrame:
    """Booleans to 0/1; a null fails, because the target must be known."""
    def strict(c: str) -> Column:
        return F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null")).cast("int")).otherwise(
            F.col(c).cast("int"))
    return df.withColumns({c: strict(c) for c in columns if c in df.columns})


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) with nulls as a value; the counts combine before the shuffle."""
    return unpivot_text(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class OneHotLevels:
    """Sorted levels per column, null last; the first is the base and gets no output column.

    The null level is named ``None``, or ``<null>`` where a real level has that name.
    """

    levels: dict[str, list[str | None]]

    def dummies(self) -> list[tuple[str, str, str | None]]:
        return [
            (f"{column}_{level_name(level, levels)}", column, level)
            for column, levels in self.levels.items() for level in levels[1:]
        ]

    def columns(self) -> list[str]:
        return [name for name, _, _ in self.dummies()]

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds 0/1 columns; unknown levels are 0 everywhere."""
        def dummy(column: str, level: str | None) -> Column:
            hit = F.col(column).isNull() if level is None else F.col(column) == level
            return F.coalesce(hit, F.lit(False)).cast("double")
        return df.withColumns({name: dummy(c, level) for name, c, level in self.dummies()})


def level_name(level: str | None, levels: Sequence[str | None]) -> str:
    if level is None:
        return "<null>" if MISSING_LEVEL in levels else MISSING_LEVEL
    return level


def sorted_levels(found: list[tuple[str, str | None]]) -> dict[str, list[str | None]]:
    levels: dict[str, list[str | None]] = {}
    for column, value in found:
        levels.setdefault(column, []).append(value)
    return {c: sorted(v for v in vs if v is not None) + [None] * (None in vs) for c, vs in levels.items()}


def collected_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str | None, int]]:
    """Counts per column and level on the driver; an error when a column has too many to be levels."""
    rows = level_counts(df, columns).limit(MAX_LEVELS * len(columns) + 1).collect()
    counts: dict[str, dict[str | None, int]] = {}
    for r in rows:
        counts.setdefault(r["column"], {})[r["value"]] = r["n"]
    for column, levels in counts.items():
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{column}: more than {MAX_LEVELS} levels, not categories to encode as columns")
    return counts


def onehot_fit(df: DataFrame, columns: Sequence[str] = tuple(NOMINAL_COLUMNS)) -> OneHotLevels:
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return OneHotLevels({})
    counts = collected_levels(df, columns)
    levels = sorted_levels([(c, v) for c, values in counts.items() for v in values])
    return OneHotLevels({c: levels[c] for c in columns if c in levels})


def onehot_levels_table(df: DataFrame, columns: Sequence[str] = tuple(NOMINAL_COLUMNS)) -> DataFrame:
    """(column, level, position, is_base) of every level, as a table."""
    fitted = onehot_fit(df, columns)
    rows = [
        (column, level_name(level, levels), i, i == 0)
        for column, levels in fitted.levels.items() for i, level in enumerate(levels)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, level string, position int, is_base boolean")


@dataclass(frozen=True)
class TargetMeans:
    """Mean target per level as a table, with the overall mean for unseen levels."""

    column: str
    means: DataFrame
    overall: float

    def transform(self, df: DataFrame) -> DataFrame:
        name = f"{self.column}_target_mean"
        table = self.means.select(F.col(self.column), F.col("level_mean"))
        return df.join(table, self.column, "left").withColumn(
            name, F.coalesce("level_mean", F.lit(self.overall))).drop("level_mean")


def target_encode_fit(df: DataFrame, column: str, target: str) -> TargetMeans:
    y = F.col(target).cast("double")
    overall = df.agg(F.avg(y).alias("mean")).first()["mean"]
    means = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(y).alias("level_mean"))
    return TargetMeans(column, sized_table(means), overall)
