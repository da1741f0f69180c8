"""Further row-level features: ratios, interactions, products."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.constants import INCOME_MIDPOINTS
from lendlens.functions.numeric import ratio


def bracket_midpoint(column: str) -> Column:
    value = F.lit(None).cast("double")
    for level, middle in INCOME_MIDPOINTS.items():
        value = F.when(F.col(column) == level, F.lit(middle)).otherwise(value)
    return value


def context_ratio_features(df: DataFrame, score_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Amount against income and credit limit, and the risk score scaled to its range."""
    low, high = score_range
    return df.withColumns({
        "amount_to_income_ratio": ratio(F.col("amount"), bracket_midpoint("customer_income_bracket")),
        "amount_to_credit_ratio": ratio(F.col("amount"), F.col("payment_credit_limit")),
        "risk_score_normalized": (F.col("risk_score") - F.lit(low)) / F.lit(high - low),
    })


def interaction_features(df: DataFrame, high_amount: float, young: Sequence[str] = ("18-24",)) -> DataFrame:
    """Combinations that together raise risk; the amount limit comes from the training data."""
    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("int")

    return df.withColumns({
        "young_customer_high_amount": flag(
            F.col("customer_age_bracket").isin(list(young)) & (F.col("amount") > high_amount)),
        "unverified_high_risk_product": flag(
            (F.col("customer_verification_level") == "unverified")
            & (F.col("product_risk_category") == "high")),
        "mobile_impulse_purchase": flag(
            (F.col("device_type") == "mobile") & (F.col("risk_scenario") == "impulse_purchase")),
        "risk_score_x_amount": F.col("risk_score") * F.col("amount"),
    })


def polynomial_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Squares and pairwise products of numeric columns."""
    return df.withColumns({
        f"{a}_x_{b}" if a != b else f"{a}_squared": F.col(a).cast("double") * F.col(b).cast("double")
        for a, b in combinations_with_replacement(columns, 2)
    })
