"""Loading, sampling and summarising the transaction table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lendlens.constants import TRANSACTION_COLUMNS
from lendlens.functions.hashing import order_key


def select_transactions(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """The transaction projection; ``renames`` maps source names to ours."""
    named = df.withColumnsRenamed(renames or {})
    return named.select(*[c for c in TRANSACTION_COLUMNS if c in named.columns])


def sort_history(df: DataFrame) -> DataFrame:
    return df.orderBy("customer_id", "transaction_timestamp", "transaction_id")


def load_transactions(df: DataFrame, sample_size: int | None = None, seed: int = 42,
                      renames: dict[str, str] | None = None, ordered: bool = True) -> DataFrame:
    """Projected transactions, optionally of a fixed pseudo-random set of customers."""
    rows = select_transactions(df, renames)
    if sample_size:
        rows = join_sample(rows, sample_customers(rows, sample_size, seed))
    return sort_history(rows) if ordered else rows


def distinct_customers(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    return df.select(customer).distinct()


def sample_customers(df: DataFrame, size: int, seed: int = 42,
                     customer: str = "customer_id") -> DataFrame:
    """The first ``size`` customers in the order of a seeded fingerprint."""
    key = order_key(seed, F.col(customer))
    return (
        distinct_customers(df.where(F.col(customer).isNotNull()), customer)
        .orderBy(key, customer).limit(size)
    )


def join_sample(df: DataFrame, sample: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Rows of the sampled customers; a limit has a known size, by which Spark picks the join."""
    return df.join(sample, customer)


def sample_rows(df: DataFrame, size: int, seed: int = 42, row_id: str = "transaction_id") -> DataFrame:
    """``size`` rows in the order of a seeded fingerprint."""
    key = order_key(seed, F.col(row_id))
    return df.orderBy(key, row_id).limit(size)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_records"))


def load_summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_distinct("customer_id").alias("customers"),
        F.avg(F.col("will_default").cast("int")).alias("default_rate"))


def schema_profile(df: DataFrame) -> DataFrame:
    """Column name, type, declared nullability in order, and whether nulls occur."""
    seen = df.agg(F.array(*[
        F.struct(F.lit(i + 1).alias("ordinal_position"), F.lit(f.name).alias("column_name"),
                 F.lit(f.dataType.simpleString()).alias("data_type"),
                 F.lit(f.nullable).alias("is_nullable"),
                 (F.count_if(F.col(f.name).isNull()) > 0).alias("has_nulls"))
        for i, f in enumerate(df.schema.fields)
    ]).alias("cells"))
    return seen.select(F.explode("cells").alias("cell")).select("cell.*")
