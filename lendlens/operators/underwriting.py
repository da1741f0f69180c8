"""How well the existing risk rules separate good from bad transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.constants import (
    RISK_LEVEL_ORDER, TARGET_DISCRIMINATION, TARGET_PRECISION,
)
from lendlens.functions.binning import equal_width_bin
from lendlens.functions.numeric import half_even, ratio
from lendlens.operators.ordered import exact_quantiles, running_totals, with_range
from lendlens.session import sized_table, with_scalars

DEFAULTED = "will_default"


def _defaults() -> Column:
    return F.col(DEFAULTED).cast("int")


def category_rank(column: str, order: Sequence[str]) -> Column:
    rank = F.lit(len(order))
    for i, level in reversed(list(enumerate(order))):
        rank = F.when(F.col(column) == level, F.lit(i)).otherwise(rank)
    return rank


def ordered_category_sort(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    return df.orderBy(category_rank(column, order), column)


def default_rate_by(df: DataFrame, column: str) -> DataFrame:
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.avg(_defaults()).alias("default_rate"), F.count(DEFAULTED).alias("count"))
    return rows.orderBy(F.desc("default_rate"), column)


def risk_level_performance(df: DataFrame, column: str = "risk_level") -> DataFrame:
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(DEFAULTED).alias("total_transactions"),
        F.sum(_defaults()).alias("actual_defaults"),
        half_even(F.avg(_defaults()), 3).alias("default_rate"),
        half_even(F.avg("risk_score"), 3).alias("avg_risk_score"))
    return ordered_category_sort(rows, column, RISK_LEVEL_ORDER)


def risk_scenario_performance(df: DataFrame, column: str = "risk_scenario") -> DataFrame:
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(DEFAULTED).alias("transaction_count"),
        half_even(F.avg(_defaults()), 3).alias("default_rate"),
        half_even(F.avg("risk_score"), 3).alias("avg_risk_score"),
        half_even(F.avg("amount"), 3).alias("avg_amount"))
    return rows.orderBy(F.desc("default_rate"), column)


def credit_risk(df: DataFrame, column: str = "customer_credit_score_range") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(
        half_even(F.avg("risk_score"), 3).alias("avg_risk_score"),
        half_even(F.stddev_samp("risk_score"), 3).alias("risk_score_std"),
        F.count("risk_score").alias("count"),
        half_even(F.avg(_defaults()), 3).alias("actual_default_rate"))


def active_customers(df: DataFrame, at_least: int, customer: str = "customer_id") -> DataFrame:
    """Rows of customers with enough transactions, by a semi join on counted ids."""
    ids = df.groupBy(customer).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    return df.join(ids, customer, "left_semi")


def customer_risk_spread(df: DataFrame, at_least: int = 3, customer: str = "customer_id") -> DataFrame:
    """Per customer: distinct levels, scores and scenarios, and the spread of the score.

    Only the scores are counted distinct; levels and scenarios are few by nature, so
    their sets stay small.
    """
    known = df.where(F.col(customer).isNotNull())
    spread = known.groupBy(customer).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_distinct("risk_score").alias("unique_risk_scores"),
        F.min("risk_score").alias("min_risk_score"), F.max("risk_score").alias("max_risk_score"),
        F.stddev_samp("risk_score").alias("risk_score_stddev"),
        F.array_sort(F.collect_set("risk_level")).alias("risk_levels"),
        F.array_sort(F.collect_set("risk_scenario")).alias("risk_scenarios"))
    return spread.where(F.col("transaction_count") >= at_least).withColumns({
        "unique_risk_levels": F.size("risk_levels").cast("long"),
        "unique_risk_scenarios": F.size("risk_scenarios").cast("long"),
    })


def risk_variation(df: DataFrame, at_least: int = 3, first: int = 10) -> DataFrame:
    """Averages of the per-customer spread by transaction count, smallest counts first."""
    spread = customer_risk_spread(df, at_least)
    return spread.groupBy("transaction_count").agg(
        F.count(F.lit(1)).alias("customer_count"),
        F.avg("unique_risk_levels").alias("avg_unique_risk_levels"),
        F.avg("unique_risk_scores").alias("avg_unique_risk_scores"),
        F.avg("unique_risk_scenarios").alias("avg_unique_risk_scenarios"),
        F.avg("risk_score_stddev").alias("avg_risk_score_stddev"),
    ).orderBy("transaction_count").limit(first)


def customer_counts(df: DataFrame, customer: str = "customer_id") -> DataFrame:
    return df.where(F.col(customer).isNotNull()).groupBy(customer).agg(
        F.count(F.lit(1)).alias("transactions"))


def topk_customers(df: DataFrame, k: int = 10, customer: str = "customer_id") -> DataFrame:
    return customer_counts(df, customer).orderBy(F.desc("transactions"), customer).limit(k)


def repeat_customers(df: DataFrame, k: int = 10, customer: str = "customer_id") -> DataFrame:
    """The most active repeat customers, with totals over all customers on every row."""
    counts = customer_counts(df, customer)
    totals = counts.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.count_if(F.col("transactions") >= 2).alias("repeat_customers"),
        F.max("transactions").alias("max_transactions"))
    top = counts.where(F.col("transactions") >= 2).orderBy(
        F.desc("transactions"), customer).limit(k)
    return with_scalars(top, totals)


def customer_sequences(df: DataFrame, customers: int = 3, customer: str = "customer_id") -> DataFrame:
    """All rows of the most active customers, numbered in time order, with what each customer had.

    These customers may hold much of the table, so they are numbered by time ranges
    rather than one task each. Levels and outcomes are few and listed; scores are counted.
    """
    top = sized_table(topk_customers(df, customers, customer).select(customer))
    rows = df.join(top, customer).select(
        customer, "transaction_timestamp", "transaction_id", "amount", "risk_level", "risk_score",
        DEFAULTED)
    ranged = with_range(rows.withColumns({
        "__time": F.unix_micros("transaction_timestamp"), "__one": F.lit(1).cast("long")}), "__time")
    numbered = running_totals(
        ranged, [F.asc("transaction_timestamp"), F.asc("transaction_id")], {"__one": "position"}, [customer])
    spans = sized_table(rows.groupBy(customer).agg(
        F.min("transaction_timestamp").alias("first_seen"), F.max("transaction_timestamp").alias("last_seen"),
        F.array_sort(F.collect_set("risk_level")).alias("risk_levels"),
        F.array_sort(F.collect_set(DEFAULTED)).alias("outcomes"),
        F.count_distinct("risk_score").alias("unique_risk_scores")))
    return numbered.join(spans, customer).drop("__time", "__one", "range_id")


def _with_range(df: DataFrame, value: str) -> DataFrame:
    limits = df.agg(F.min(value).cast("double").alias("__low"), F.max(value).cast("double").alias("__high"))
    return with_scalars(df.where(F.col(value).isNotNull()), limits)


def calibration_bins(df: DataFrame, score: str = "risk_score", bins: int = 10) -> DataFrame:
    """Equal-width, right-closed score bins: mean score, default rate, count."""
    where = equal_width_bin(F.col(score), F.col("__low"), F.col("__high"), bins, right_closed=True)
    return _with_range(df, score).groupBy(where.alias("bin")).agg(
        F.avg(score).alias("avg_risk_score"), F.avg(_defaults()).alias("actual_default_rate"),
        F.count("customer_id").alias("count"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Equal-width counts, left-closed with a closed last bin; empty bins are listed with 0."""
    low, high = F.col("__low"), F.col("__high")
    where = equal_width_bin(F.col(value).cast("double"), low, high, bins, right_closed=False)
    counted = _with_range(df, value).groupBy(where.alias("bin"), "__low", "__high").agg(F.count(F.lit(1)).alias("n"))
    filled = counted.groupBy("__low", "__high").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("filled"))
    step = (high - low) / F.lit(float(bins))
    listed = filled.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return listed.select("bin", (F.col("bin") * step + low).alias("lower_edge"),
                         F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0).cast("long")).alias("count"))


def underwriting_effectiveness(df: DataFrame) -> DataFrame:
    """Default rates of the risky and the safe levels and their ratio, in one pass."""
    risky = F.col("risk_level").isin("high", "very_high")
    safe = F.col("risk_level").isin("low", "medium")
    rates = df.agg(
        F.avg(_defaults()).alias("overall_default_rate"),
        F.avg(F.coalesce(risky, F.lit(False)).cast("int")).alias("risk_coverage"),
        F.avg(F.when(risky, _defaults())).alias("high_risk_default_rate"),
        F.avg(F.when(safe, _defaults())).alias("low_risk_default_rate"))
    return rates.withColumn("discrimination_ratio", F.coalesce(
        ratio(F.col("high_risk_default_rate"), F.col("low_risk_default_rate")), F.lit(0.0)))


def underwriting_baseline(df: DataFrame, encoded: str = "risk_level_encoded") -> DataFrame:
    """Rate by encoded level, the ratio of the top to the bottom level, and the targets it sets.

    Codes outside the dictionary are reported but do not enter the ratio.
    """
    rows = df.where(F.col(encoded).isNotNull()).groupBy(encoded).agg(
        F.count(DEFAULTED).alias("transaction_count"),
        half_even(F.avg(_defaults()), 3).alias("default_rate"))
    rates = rows.agg(
        F.max(F.when(F.col(encoded) == 2, F.col("default_rate"))).alias("high"),
        F.max(F.when(F.col(encoded) == 0, F.col("default_rate"))).alias("low"))
    scalars = rates.select(
        F.coalesce(ratio(F.col("high"), F.col("low")), F.lit(0.0)).alias("current_discrimination"))
    return with_scalars(rows, scalars).withColumns({
        "target_discrimination": F.greatest(
            F.col("current_discrimination") * 1.1, F.lit(TARGET_DISCRIMINATION)),
        "target_precision": F.lit(TARGET_PRECISION),
    })


def box_stats_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles and the outermost values within 1.5 interquartile ranges, per group."""
    quartiles = exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group])
    fences = quartiles.withColumns({
        "low_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "high_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")),
    })
    x = F.col(value)
    inside = (x >= F.col("low_fence")) & (x <= F.col("high_fence"))
    return df.where(x.isNotNull()).join(sized_table(fences), group).groupBy(group).agg(
        F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"))


def rule_decision(column: str = "risk_level", declined: Sequence[str] = ("high", "very_high")) -> Column:
    """What the existing rules decide: risky levels are declined."""
    return F.when(F.col(column).isin(list(declined)), "decline").otherwise("approve")


def kpi_rates(df: DataFrame, timestamp: str = "transaction_timestamp", period: str = "month") -> DataFrame:
    """Approval and default rates per period; the default rate also among approved rows."""
    approved = rule_decision() == "approve"
    return df.groupBy(F.date_trunc(period, timestamp).alias("period")).agg(
        F.count(F.lit(1)).alias("transactions"),
        F.avg(approved.cast("int")).alias("approval_rate"),
        F.avg(_defaults()).alias("default_rate"),
        F.avg(F.when(approved, _defaults())).alias("approved_default_rate"))


