"""Screening, dropping, imputing and converting columns; fit first, then a plain projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlens.constants import (
    HIGH_CARDINALITY, IDENTIFIER_COLUMNS, NOMINAL_COLUMNS, ORDINAL_LEVELS, RAW_TEMPORAL_COLUMNS,
    TARGET, TEXT_NUMBER_COLUMNS, UNNEEDED_COLUMNS,
)
from lendlens.functions.numeric import half_even, parse_number
from lendlens.operators.encode import (
    OneHotLevels, bool_to_int, collected_levels, level_counts, ordinal_encode, sorted_levels,
)
from lendlens.operators.ordered import exact_quantiles, unpivot_numeric
from lendlens.operators.temporal import temporal_features
from lendlens.session import with_scalars
from lendlens.sources.transactions import load_transactions

# Above this estimate a column is surely beyond the cut; below it the count is taken exactly.
SURE_FACTOR = 3
# Medians of columns with at most so many values come from their counts.
FEW_VALUES = 1_000
FALLBACK_FILL = "unknown"


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def null_count(column: str) -> Column:
    return F.count_if(F.col(column).isNull())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Not-a-number is a missing value like null."""
    return df.withColumns({
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    })


def missing_report(df: DataFrame, only_missing: bool = True) -> DataFrame:
    """(column, missing_count, missing_percent), most missing first; one pass, no shuffle of rows."""
    df = nan_to_null(df)
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.array(*[
            F.struct(F.lit(c).alias("column"), null_count(c).alias("missing_count"))
            for c in df.columns
        ]).alias("cells"))
    rows = counts.select("total", F.explode("cells").alias("cell")).select(
        "cell.column", "cell.missing_count",
        half_even(F.try_divide(F.col("cell.missing_count") * F.lit(100.0),
                               F.col("total").cast("double")), 2).alias("missing_percent"))
    if only_missing:
        rows = rows.where(F.col("missing_count") > 0)
    return rows.orderBy(F.desc("missing_percent"), "column")


def single_value_table(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct non-null value: smallest equals largest."""
    flags = df.agg(F.array(*[
        F.struct(F.lit(c).alias("column"),
                 F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("single"))
        for c in df.columns
    ]).alias("cells"))
    return flags.select(F.explode("cells").alias("cell")).where("cell.single").select("cell.column")


def cardinality_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-null counts per column, counted per (column, value) across the cluster."""
    columns = list(columns or df.columns)
    pairs = level_counts(df, columns)
    return pairs.groupBy("column").agg(F.count("value").alias("distinct_count"))


def estimated_cardinalities(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    return df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()


def high_cardinality_table(df: DataFrame, limit: int = HIGH_CARDINALITY,
                           columns: Sequence[str] | None = None) -> DataFrame:
    """String columns with more than ``limit`` distinct values."""
    columns = list(columns or text_columns(df))
    estimates = estimated_cardinalities(df, columns)
    sure = [c for c, n in estimates.items() if n > limit * SURE_FACTOR]
    near = [c for c in columns if c not in sure]
    result = df.sparkSession.createDataFrame([(c,) for c in sure], "column string")
    if near:
        exact = cardinality_report(df, near).where(F.col("distinct_count") > limit).select("column")
        result = result.unionByName(exact)
    return result


def static_drops(columns: Sequence[str]) -> list[str]:
    """Columns never kept: encoded categories, identifiers, raw time parts, unneeded fields."""
    unwanted = {*ORDINAL_LEVELS, *NOMINAL_COLUMNS, *IDENTIFIER_COLUMNS, *RAW_TEMPORAL_COLUMNS,
                *UNNEEDED_COLUMNS}
    return [c for c in columns if c in unwanted]


def drop_columns(df: DataFrame, extra: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in [*static_drops(df.columns), *extra] if c not in keep])


def exact_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Medians by column."""
    if not columns:
        return {}
    cells = unpivot_numeric(df, columns)
    rows = exact_quantiles(cells, "value", {"median": 0.5}, ["column"]).collect()
    return {r["column"]: r["median"] for r in rows}


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column as text, the smallest among equals."""
    if not columns:
        return {}
    best = (
        level_counts(df, columns).where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(F.max(F.col("n")).alias("top"), F.min_by("value", F.struct(-F.col("n"), F.col("value")))
             .alias("mode"))
    )
    return {r["column"]: r["mode"] for r in best.collect()}


@dataclass(frozen=True)
class FillValues:
    values: dict[str, object]

    def transform(self, df: DataFrame) -> DataFrame:
        types = {f.name: f.dataType for f in df.schema.fields}

        def filled(column: str, value: object) -> Column:
            kind = types[column]
            whole = isinstance(kind, T.IntegralType)
            kept = F.col(column).cast("double") if whole and isinstance(value, float) else F.col(column)
            literal = F.lit(value)
            if isinstance(kind, T.BooleanType):
                literal = literal.cast("boolean")
            return F.coalesce(kept, literal)

        return df.withColumns({
            c: filled(c, v) for c, v in self.values.items() if c in df.columns and v is not None
        })


def impute_fit(df: DataFrame, columns: Sequence[str] | None = None) -> FillValues:
    """Median for numbers, most frequent value otherwise, for the columns with nulls."""
    columns = list(columns or df.columns)
    if not columns:
        return FillValues({})
    nulls = df.agg(*[null_count(c).alias(c) for c in columns]).first().asDict()
    missing = [c for c in columns if nulls[c] > 0]
    numbers = [c for c in missing if c in numeric_columns(df)]
    others = [c for c in missing if c not in numbers]
    common = modes(df, others)
    return FillValues({
        **exact_medians(df, numbers), **{c: common.get(c, FALLBACK_FILL) for c in others}
    })


def string_to_numeric(df: DataFrame, columns: Sequence[str] = tuple(TEXT_NUMBER_COLUMNS)) -> DataFrame:
    """Text to double; anything that is not a plain number becomes null."""
    present = [c for c in columns if c in text_columns(df)]
    return df.withColumns({c: parse_number(F.col(c)) for c in present})


@dataclass(frozen=True)
class FeaturePipeline:
    """Fitted row-level pipeline: time features, encoding, dropping, imputing, conversion.

    ``order='impute_first'`` imputes before converting text to numbers, so unreadable
    values stay null; ``'convert_first'`` converts first and leaves no nulls.
    """

    levels: OneHotLevels
    removed: list[str]
    fills: FillValues
    order: str = "impute_first"
    statistics: dict = field(default_factory=dict)

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """A single projection; works on any batch, one row or a stream."""
        rows = encode_rows(df)
        rows = self.levels.transform(rows)
        rows = rows.drop(*[c for c in self.removed if c not in keep])
        if self.order == "convert_first":
            return self.fills.transform(string_to_numeric(rows))
        return string_to_numeric(self.fills.transform(rows))


def encode_rows(df: DataFrame) -> DataFrame:
    """The part of the pipeline that needs no fitted state."""
    return bool_to_int(ordinal_encode(temporal_features(nan_to_null(df))))


def fit_pipeline(df: DataFrame, order: str = "impute_first", keep: Sequence[str] = ()) -> FeaturePipeline:
    """Two passes over the data, plus one for numeric columns with nulls and many values.

    Columns that are dropped anyway are not looked at, apart from the levels of the
    categories that become 0/1 columns.
    """
    rows = encode_rows(df)
    if order == "convert_first":
        rows = string_to_numeric(rows)
    dropped = [c for c in static_drops(rows.columns) if c not in keep]
    candidates = [c for c in rows.columns if c not in dropped]
    texts = [c for c in text_columns(rows) if c in candidates]
    nominal = [c for c in NOMINAL_COLUMNS if c in rows.columns]

    # Codes and flags cannot be null by construction, which their type tells.
    nullable = [f.name for f in rows.schema.fields if f.nullable and f.name in candidates]
    checks = [null_count(c).alias(f"{c}__nulls") for c in nullable]
    checks += [(F.min(c) == F.max(c)).alias(f"{c}__same") for c in candidates if c not in texts]
    numeric = numeric_columns(rows)
    checks += [F.approx_count_distinct(c).alias(f"{c}__levels")
               for c in candidates if c in texts or (c in nullable and c in numeric)]
    seen = rows.agg(
        *checks, F.count(F.lit(1)).alias("__rows"), F.avg(TARGET).alias("__target")).first().asDict()

    wide = [c for c in texts if seen[f"{c}__levels"] > HIGH_CARDINALITY * SURE_FACTOR]
    narrow = [c for c in texts if c not in wide]
    few = [c for c in nullable if c in numeric and seen[f"{c}__nulls"] > 0 and seen[f"{c}__levels"] <= FEW_VALUES]
    per_column = counted_levels(rows, sorted({*narrow, *nominal, *few}))
    known = {c: set(per_column.get(c, {})) - {None} for c in narrow}
    wide += [c for c in narrow if len(known[c]) > HIGH_CARDINALITY]
    single = [c for c in candidates
              if (len(known[c]) <= 1 if c in known else seen.get(f"{c}__same", False) in (True, None))]

    removed = [c for c in rows.columns if c in dropped or (c not in keep and c in {*single, *wide})]
    missing = [c for c in nullable if c not in removed and seen[f"{c}__nulls"] > 0]
    numbers = [c for c in missing if c in numeric]
    fills: dict[str, object] = {c: median_of_counts(per_column[c]) for c in numbers if c in few}
    fills |= exact_medians(rows, [c for c in numbers if c not in few])
    for c in [c for c in missing if c not in numbers]:
        values = {v: n for v, n in per_column.get(c, {}).items() if v is not None}
        fills[c] = min(values, key=lambda v: (-values[v], v)) if values else FALLBACK_FILL
    found = sorted_levels([(c, v) for c in nominal for v in per_column.get(c, {})])
    return FeaturePipeline(
        OneHotLevels({c: found[c] for c in nominal if c in found}), removed, FillValues(fills),
        order, {"rows": seen["__rows"], "default_rate": seen["__target"]})


def median_of_counts(counts: dict[str | None, int]) -> float | None:
    """Exact median of a column from the counts of its few values."""
    values = sorted((float(v), n) for v, n in counts.items() if v is not None)
    size = sum(n for _, n in values)
    if not size:
        return None

    def at(rank: int) -> float:
        for value, n in values:
            rank -= n
            if rank < 0:
                return value
        return values[-1][0]

    return (at((size - 1) // 2) + at(size // 2)) / 2


def counted_levels(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str | None, int]]:
    """Counts per column and level on the driver, each column for itself."""
    if not columns:
        return {}
    return collected_levels(df, columns)


def clean_and_select(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Fit on the batch and transform it."""
    return fit_pipeline(df, keep=keep).transform(df, keep)


def engineer_features(df: DataFrame, sample_size: int | None = None, seed: int = 42,
                      renames: dict[str, str] | None = None) -> tuple[DataFrame, FeaturePipeline]:
    """The whole row-level pipeline: load, optionally sample customers, fit, transform.

    Returns the features and the fitted pipeline, which transforms later rows alike.
    """
    rows = load_transactions(df, sample_size, seed, renames, ordered=False)
    pipeline = fit_pipeline(rows)
    return pipeline.transform(rows), pipeline


def feature_metadata(pipeline: FeaturePipeline, features: DataFrame, source: DataFrame,
                     customer: str = "customer_id") -> DataFrame:
    """One row per kept or removed feature, with the row count, customers and default rate."""
    def kind(data_type: T.DataType) -> str:
        if isinstance(data_type, T.NumericType):
            return "numeric"
        return "boolean" if isinstance(data_type, T.BooleanType) else "categorical"

    rows = [(f.name, kind(f.dataType), f.name == TARGET, False) for f in features.schema.fields]
    rows += [(c, None, False, True) for c in pipeline.removed]
    listed = features.sparkSession.createDataFrame(
        rows, "feature string, kind string, is_target boolean, removed boolean")
    customers = source.agg(F.count_distinct(customer).alias("unique_customers"))
    return with_scalars(listed, customers).select(
        "*", F.lit(pipeline.statistics["rows"]).cast("long").alias("total_transactions"),
        F.lit(pipeline.statistics["default_rate"]).alias("default_rate"))
