"""Reading tables with time-zone aware timestamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def normalize_timestamps(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants in the session zone, as watermarks need them."""
    return df.select([
        F.col(f.name).cast("timestamp") if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return normalize_timestamps(df.select(columns) if columns else df)
