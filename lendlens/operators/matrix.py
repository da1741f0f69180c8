"""Model matrix and standardisation with fitted parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from lendlens.constants import LEAKAGE_COLUMNS, SCALED_FEATURES, TARGET


def feature_names(df: DataFrame, ids: Sequence[str] = ()) -> list[str]:
    """All columns but the target, columns known only after default, and identifiers."""
    return [c for c in df.columns if c not in {TARGET, *LEAKAGE_COLUMNS, *ids}]


def model_matrix(df: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Scaled features first, then the others, as doubles; identifiers in front."""
    names = feature_names(df, ids)
    scaled = [c for c in SCALED_FEATURES if c in names]
    return df.select(*ids, *[
        F.col(c).cast("double").alias(c) for c in [*scaled, *[c for c in names if c not in scaled]]
    ])


@dataclass(frozen=True)
class Scaler:
    means: dict[str, float]
    deviations: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c) - F.lit(self.means[c])) / F.lit(self.deviations[c] or 1.0)
            for c in self.means
        })


def standard_scale_fit(df: DataFrame, columns: Sequence[str] = tuple(SCALED_FEATURES)) -> Scaler:
    """Mean and population deviation; a constant column is divided by 1."""
    columns = [c for c in columns if c in df.columns]
    seen = df.agg(*[f for c in columns for f in (
        F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__dev"))]).first()
    return Scaler({c: seen[f"{c}__mean"] for c in columns}, {c: seen[f"{c}__dev"] for c in columns})


def assemble(df: DataFrame, features: Sequence[str], keep: Sequence[str], output: str = "features") -> DataFrame:
    """Feature columns into one vector, in the order given."""
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df).select(*keep, output)
