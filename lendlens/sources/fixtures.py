"""Inputs for the registered queries, derived from the star-schema test tables.

Each column is one SQL expression that reads the same in Spark and in the
checking engine; only timestamps are written differently in the two.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from lendlens.functions.numeric import safe_corr
from lendlens.sources.tables import read_table

K, C = "o_orderkey", "c_custkey"
SCORE = f"(({K}*37)%101)"

TRANSACTIONS = {
    "customer_id": "o_custkey",
    "transaction_id": K,
    "amount": "o_totalprice",
    "will_default": f"({K}*53)%1000 < 20 + {SCORE}",
    "transaction_timestamp": None,
    "days_to_first_missed_payment":
        f"CASE WHEN ({K}*53)%1000 < 20 + {SCORE} THEN 1 + {K}%60 END",
    "customer_credit_score_range":
        "CASE WHEN c_acctbal < 1000 THEN 'poor' WHEN c_acctbal < 4000 THEN 'fair' "
        "WHEN c_acctbal < 7000 THEN 'good' ELSE 'excellent' END",
    "customer_age_bracket":
        f"CASE {C}%5 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' "
        "WHEN 3 THEN '45-54' ELSE '55+' END",
    "customer_income_bracket":
        f"CASE ({C}*7)%5 WHEN 0 THEN '<25k' WHEN 1 THEN '25k-50k' WHEN 2 THEN '50k-75k' "
        "WHEN 3 THEN '75k-100k' ELSE '100k+' END",
    "customer_verification_level":
        f"CASE {C}%3 WHEN 0 THEN 'unverified' WHEN 1 THEN 'partial' ELSE 'verified' END",
    "customer_tenure_days": f"{C}%1000",
    "customer_state": "n_name",
    "product_category": "c_mktsegment",
    "product_risk_category":
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' "
        "WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END",
    "product_price": "o_totalprice",
    "device_type": f"CASE {K}%3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END",
    "device_is_trusted": f"{K}%4 <> 0",
    "risk_score": f"{SCORE}/100",
    "risk_level":
        f"CASE WHEN {SCORE} < 40 THEN 'low' WHEN {SCORE} < 70 THEN 'medium' "
        f"WHEN {SCORE} < 90 THEN 'high' ELSE 'very_high' END",
    "risk_scenario":
        f"CASE {K}%5 WHEN 0 THEN 'high_risk_behavior' WHEN 1 THEN 'impulse_purchase' "
        "WHEN 2 THEN 'low_risk_purchase' ELSE 'base_scenario' END",
    "payment_provider":
        f"CASE {K}%7 WHEN 0 THEN 'afterpay' WHEN 1 THEN 'klarna' WHEN 2 THEN 'sezzle' "
        "ELSE 'affirm' END",
    "installment_count": f"CASE WHEN {K}%2 = 0 THEN 4 ELSE 6 END",
    "payment_credit_limit": f"CAST(500 + 100*({C}%30) AS double)",
    "payment_type": "'bnpl'",
    "time_on_site_seconds": f"CAST(({K}*11)%600 AS string)",
    "purchase_context":
        f"CASE {K}%6 WHEN 0 THEN 'rushed' WHEN 1 THEN 'normal' ELSE 'browsing' END",
    "price_comparison_time":
        f"CASE WHEN {K}%17 = 0 THEN NULL WHEN {K}%13 = 0 THEN 'n/a' "
        f"ELSE CAST(({K}%19)*5 AS string) END",
}

PAYMENTS = {
    "transaction_id": "l_orderkey",
    "customer_id": "o_custkey",
    "transaction_date": None,
    "transaction_amount": "l_extendedprice",
    "payment_date": None,
    "payment_due_date": None,
    "credit_score": f"CASE WHEN {C}%11 = 0 THEN NULL ELSE 500 + {C}%350 END",
    "annual_income": f"CASE WHEN {C}%9 = 0 THEN CAST(0 AS double) ELSE c_acctbal*12 END",
    "customer_age": f"18 + {C}%60",
    "failed_payment_count": "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END",
    "dispute_count": "CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END",
    "chargeback_count": "CASE WHEN l_tax >= CAST(0.08 AS double) THEN 1 END",
    "employment_status": f"CASE {C}%3 WHEN 0 THEN 'employed' WHEN 1 THEN 'self' ELSE 'none' END",
    "home_ownership_status": f"CASE WHEN {C}%2 = 0 THEN 'own' ELSE 'rent' END",
}

# Fixed values: (model, weight of the risk digit, weight of the second digit).
SCORE_MODELS = [("ridge", 60, 30), ("logistic", 50, 35), ("elastic", 55, 33)]

DUMMIES = {
    "device_type": ["mobile", "tablet"],
    "payment_provider": ["afterpay", "klarna", "sezzle"],
    "product_category": ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "purchase_context": ["normal", "rushed"],
    "risk_scenario": ["high_risk_behavior", "impulse_purchase", "low_risk_purchase"],
    "time_of_day": ["evening", "morning", "night"],
}

MODEL_FEATURES = [
    "amount", "customer_tenure_days", "device_is_trusted", "risk_score", "installment_count",
    "payment_credit_limit", "price_comparison_time", "week_of_month", "is_weekend",
    "is_month_end", "is_holiday_season", "is_business_hours", "is_late_night",
    "customer_credit_score_range_encoded", "customer_age_bracket_encoded",
    "customer_income_bracket_encoded", "customer_verification_level_encoded",
    "product_risk_category_encoded", "risk_level_encoded",
] + [f"{column}_{level}" for column, levels in DUMMIES.items() for level in levels]

INTERCEPT = "__intercept__"


# Binary scales that bring wide-ranging features near 1.
COEFFICIENT_SCALES = {
    "amount": 2.0 ** -20, "customer_tenure_days": 2.0 ** -10,
    "payment_credit_limit": 2.0 ** -12, "price_comparison_time": 2.0 ** -6,
}


def coefficient_rows() -> list[tuple[str, str, str, str, str, float]]:
    """(domain, model, version, role, feature, coefficient); multiples of 1/64, scaled in binary."""
    rows = []
    for m, (model, role) in enumerate(
            [("ridge", "champion"), ("logistic", "challenger"), ("elastic", "challenger")]):
        for i, feature in enumerate(MODEL_FEATURES):
            weight = ((i * 7 + m * 5) % 23 - 11) / 64 * COEFFICIENT_SCALES.get(feature, 1.0)
            rows.append(("bnpl", model, "v0.1.0", role, feature, weight))
        rows.append(("bnpl", model, "v0.1.0", role, INTERCEPT, -(96 + 8 * m) / 64))
    return rows


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, os.path.join(folder, f"{name}.parquet"))


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    rows = (
        _table(spark, folder, "orders")
        .join(_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(_table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    stamp = F.expr(f"timestampadd(HOUR, CAST({K} % 24 AS int), o_orderdate)")
    return rows.select([
        (stamp if sql is None else F.expr(sql)).alias(name) for name, sql in TRANSACTIONS.items()
    ])


def payments(spark: SparkSession, folder: str) -> DataFrame:
    rows = (
        _table(spark, folder, "lineitem")
        .join(_table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(_table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    )
    stamps = {
        "transaction_date": f"timestampadd(HOUR, CAST({K} % 24 AS int), o_orderdate)",
        "payment_date": "l_shipdate",
        "payment_due_date": "timestampadd(DAY, 30, o_orderdate)",
    }
    return rows.select([
        F.expr(sql or stamps[name]).alias(name) for name, sql in PAYMENTS.items()
    ])


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """One row per model and transaction: model_name, transaction_id, label, score."""
    models = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_name"), F.lit(a).alias("a"), F.lit(b).alias("b"))
        for m, a, b in SCORE_MODELS
    ]))
    base = transactions(spark, folder).select(
        F.col("transaction_id"), F.col("will_default").cast("int").alias("label"),
        models.alias("m"))
    score = ("round(CAST(m.a*((transaction_id*37)%101) + m.b*((transaction_id*71)%97) AS double)"
             "/10000, 6)")
    return base.select("m.model_name", "transaction_id", "label", F.expr(score).alias("score"))


def coefficients(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        coefficient_rows(),
        "domain string, model_name string, version string, role string, feature string, "
        "coefficient double")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "events")


# How strongly each model shrinks the marginal correlations.
MARGINAL_MODELS = {"ridge": (0.0, 1.1), "logistic": (0.0, 1.0), "elastic": (0.005, 1.05)}


def marginal_coefficients(matrix: DataFrame, target: str = "will_default") -> DataFrame:
    """A coefficient table that is read from the data: shrunken correlations with the target."""
    cells = matrix.agg(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.coalesce(
            safe_corr(F.col(f), F.col(target)), F.lit(0.0)).alias("r")) for f in MODEL_FEATURES
    ]).alias("cells")).select(F.explode("cells").alias("cell")).select("cell.feature", "cell.r")
    shrunk = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_name"), F.round(
            F.sign("r") * F.greatest(F.abs("r") - F.lit(cut), F.lit(0.0)) / F.lit(by), 9
        ).alias("coefficient")) for m, (cut, by) in MARGINAL_MODELS.items()
    ]))
    return cells.select("feature", shrunk.alias("m")).select("m.model_name", "feature", "m.coefficient")
