"""Customer-level features: every family from one grouping by customer.

All aggregates combine before the shuffle, so a customer with very many rows
costs no more than its partial results.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions import calendar as cal
from lendlens.functions.numeric import bounded_ratio, clipped, half_even, ratio, whole_days

MONTHS_IN_WINDOW = 3
MONTH_END_FROM = 26

DATES = ["transaction_date", "payment_date", "payment_due_date"]
RISK_PROFILE = ["credit_score", "annual_income", "customer_age"]
FAILURE_COUNTS = ["failed_payment_count", "dispute_count", "chargeback_count"]
DEMOGRAPHICS = [
    "customer_age", "credit_score", "annual_income", "employment_status", "home_ownership_status",
]


@dataclass
class FeatureFamily:
    """Aggregates per customer and the columns derived from them."""

    aggregates: dict[str, Column] = field(default_factory=dict)
    derived: dict[str, Column] = field(default_factory=dict)


def parse_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp") for c in DATES if c in df.columns})


def payment_timing(df: DataFrame) -> DataFrame:
    """Adds days to payment, days early (negative: late) and the late flag."""
    df = parse_dates(df)
    added: dict[str, Column] = {}
    if {"payment_date", "transaction_date"} <= set(df.columns):
        added["days_to_payment"] = whole_days(F.col("transaction_date"), F.col("payment_date"))
    if {"payment_date", "payment_due_date"} <= set(df.columns):
        early = whole_days(F.col("payment_date"), F.col("payment_due_date"))
        added["days_early_late"] = early
        added["is_late_payment"] = cal.flag(early < 0)
    return df.withColumns(added)


def first_known(column: str) -> Column:
    """The earliest non-null value by time, then transaction."""
    value = F.col(column)
    when = F.when(value.isNotNull(), F.struct("transaction_date", "transaction_id"))
    return F.min_by(value, when)


def total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0).cast("long"))


def amount_variation() -> Column:
    """Spread over mean of the amounts; null for one row or a zero mean."""
    return ratio(F.stddev_samp("transaction_amount"),
                 F.nullif(F.avg("transaction_amount"), F.lit(0.0)))


def velocity_family(columns: set[str]) -> FeatureFamily:
    timed, due = "days_to_payment" in columns, "days_early_late" in columns
    # The count is named without its suffix when it is the only aggregate.
    count_name = "velocity_transaction_id_count" if timed or due else "velocity_transaction_id"
    family = FeatureFamily({count_name: F.count("transaction_id")})
    if timed:
        days = F.col("days_to_payment")
        family.aggregates |= {
            "velocity_days_to_payment_mean": F.avg(days),
            "velocity_days_to_payment_std": F.stddev_samp(days),
            "velocity_days_to_payment_min": F.min(days),
            "velocity_days_to_payment_max": F.max(days),
        }
        family.derived["velocity_payment_consistency"] = half_even(
            F.lit(1.0) / (F.lit(1.0) + F.coalesce("velocity_days_to_payment_std", F.lit(0.0))), 3)
    if due:
        family.aggregates |= {
            "velocity_days_early_late_mean": F.avg("days_early_late"),
            "velocity_days_early_late_std": F.stddev_samp("days_early_late"),
            "velocity_is_late_payment_sum": total("is_late_payment"),
        }
        family.derived["velocity_late_payment_rate"] = half_even(F.coalesce(
            ratio(F.col("velocity_is_late_payment_sum"), F.col("velocity_transaction_id_count")),
            F.lit(0.0)), 3)
    return family


def risk_family(columns: set[str]) -> FeatureFamily:
    amount = F.col("transaction_amount")
    family = FeatureFamily({
        "risk_transaction_amount_sum": F.coalesce(F.sum(amount), F.lit(0.0)),
        "risk_transaction_amount_mean": F.avg(amount),
        "risk_transaction_amount_max": F.max(amount),
        "risk_transaction_amount_std": F.stddev_samp(amount),
        "risk_transaction_amount_count": F.count(amount),
    })
    family.aggregates |= {f"risk_{c}_first": first_known(c) for c in RISK_PROFILE if c in columns}
    family.aggregates |= {f"risk_{c}_sum": total(c) for c in FAILURE_COUNTS if c in columns}
    if "annual_income" in columns:
        income = F.col("risk_annual_income_first")
        family.derived["risk_debt_to_income_ratio"] = half_even(
            bounded_ratio(F.col("risk_transaction_amount_sum"), income, 1.0), 3)
        family.derived["risk_transaction_to_monthly_income"] = half_even(
            bounded_ratio(F.col("risk_transaction_amount_mean"), income / 12, 2.0), 3)
    family.derived["risk_monthly_transaction_frequency"] = half_even(
        F.col("risk_transaction_amount_count") / F.lit(float(MONTHS_IN_WINDOW)), 2)
    family.aggregates["__variation"] = amount_variation()
    family.derived["risk_spending_volatility"] = half_even(
        F.coalesce("__variation", F.lit(0.0)), 3)
    return family


def temporal_family(month_end_from: int = MONTH_END_FROM) -> FeatureFamily:
    ts = F.col("transaction_date")
    shares = {
        "temporal_is_weekend_mean": cal.is_weekend(ts),
        "temporal_is_month_end_mean": cal.is_month_end(ts, month_end_from),
        "temporal_is_holiday_season_mean": cal.is_holiday_season(ts),
        "temporal_is_business_hours_mean": cal.is_business_hours(ts),
        "temporal_hour_mean": F.hour(ts),
    }
    family = FeatureFamily({name: half_even(F.avg(part), 3) for name, part in shares.items()})
    family.aggregates["temporal_hour_std"] = half_even(F.stddev_samp(F.hour(ts)), 3)
    family.aggregates["temporal_day_of_week_mode"] = F.coalesce(
        F.mode(F.weekday(ts), True), F.lit(0))
    return family


def profile_family(columns: set[str]) -> FeatureFamily:
    amount, ts = F.col("transaction_amount"), F.col("transaction_date")
    family = FeatureFamily({
        "profile_transaction_amount_count": F.count(amount),
        "profile_transaction_amount_sum": F.coalesce(F.sum(amount), F.lit(0.0)),
        "profile_transaction_amount_mean": F.avg(amount),
        "profile_transaction_amount_std": F.stddev_samp(amount),
        "profile_transaction_amount_min": F.min(amount),
        "profile_transaction_amount_max": F.max(amount),
        "profile_transaction_date_min": F.min(ts),
        "profile_transaction_date_max": F.max(ts),
    })
    family.aggregates |= {f"profile_{c}_first": first_known(c) for c in DEMOGRAPHICS if c in columns}
    family.derived["profile_customer_tenure_days"] = whole_days(
        F.col("profile_transaction_date_min"), F.col("profile_transaction_date_max"))
    family.aggregates["__variation"] = amount_variation()
    family.derived["profile_spending_consistency"] = half_even(
        clipped(F.coalesce(F.lit(1.0) - F.col("__variation"), F.lit(0.0)), 0.0, 1.0), 3)
    return family


def _aggregate(df: DataFrame, families: list[FeatureFamily], customer: str) -> DataFrame:
    aggregates: dict[str, Column] = {}
    derived: dict[str, Column] = {}
    for family in families:
        aggregates |= family.aggregates
        derived |= family.derived
    known = df.where(F.col(customer).isNotNull())
    grouped = known.groupBy(customer).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.withColumns(derived).drop("__variation")


def velocity_features(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    timed = payment_timing(df)
    return _aggregate(timed, [velocity_family(set(timed.columns))], customer)


def risk_indicator_features(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    return _aggregate(parse_dates(df), [risk_family(set(df.columns))], customer)


def temporal_profile(df: DataFrame, customer: str = "customer_id",
                     timestamp: str = "transaction_date") -> DataFrame:
    renamed = df.withColumnRenamed(timestamp, "transaction_date")
    return _aggregate(parse_dates(renamed), [temporal_family()], customer)


def customer_profile(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    return _aggregate(parse_dates(df), [profile_family(set(df.columns))], customer)


def engineer_customer_features(df: DataFrame, customer: str = "customer_id",
                               customer_profile: bool = True, velocity_features: bool = True,
                               risk_indicators: bool = True, temporal_features: bool = True) -> DataFrame:
    """The enabled families side by side, from a single shuffle on the customer."""
    timed = payment_timing(df)
    columns = set(timed.columns)
    families = []
    if customer_profile:
        families.append(profile_family(columns))
    if velocity_features:
        families.append(velocity_family(columns))
    if risk_indicators:
        families.append(risk_family(columns))
    if temporal_features:
        families.append(temporal_family())
    if not families:
        raise ValueError("enable at least one feature family")
    return _aggregate(timed, families, customer)


def join_feature_sets(first: DataFrame, *others: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Outer alignment of customer frames that were built separately."""
    for other in others:
        first = first.join(other, customer, "full_outer")
    return first


def customer_history(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    """Count, mean and spread of amounts, category diversity, share of the usual device.

    Devices are counted per level first, so the second grouping sees one row per
    customer and device; both sides of the join are already partitioned by customer.
    """
    known = df.where(F.col(customer).isNotNull())
    amounts = known.groupBy(customer).agg(
        F.count(F.lit(1)).alias("transaction_count"), F.avg("amount").alias("avg_amount"),
        F.stddev_samp("amount").alias("amount_volatility"),
        F.size(F.collect_set("product_category")).cast("long").alias("category_diversity"))
    devices = known.groupBy(customer, "device_type").agg(F.count("device_type").alias("n")).groupBy(
        customer).agg(ratio(F.max("n"), F.sum("n")).alias("device_consistency"))
    return amounts.join(devices, customer)
