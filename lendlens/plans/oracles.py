"""For each registered query the same result as SQL for the checking engine."""

from __future__ import annotations

from lendlens.constants import INCOME_MIDPOINTS, NOMINAL_COLUMNS, ORDINAL_LEVELS, SCALED_FEATURES
from lendlens.operators.evaluate import sweep_thresholds
from lendlens.operators.score import INTERCEPT
from lendlens.plans.views import (
    CODES, DECISION, DUMMY_COLUMNS, TIME_PARTS, VIEWS, feature_structs, linear_margin, needed, parsed,
)
from lendlens.sources import fixtures as fx

ORACLES: dict[str, str] = {}

MODELS = [m for m, _, _ in fx.SCORE_MODELS]
T_TYPES = {
    "customer_id": "bigint", "transaction_id": "bigint", "amount": "double", "will_default": "boolean",
    "transaction_timestamp": "timestamp", "days_to_first_missed_payment": "bigint",
    "customer_tenure_days": "bigint", "product_price": "double", "device_is_trusted": "boolean",
    "risk_score": "double", "installment_count": "int", "payment_credit_limit": "double",
}
T_COLUMNS = list(fx.TRANSACTIONS)
# Columns that the fixtures compute from cases that leave nothing open.
NEVER_NULL = {
    "customer_credit_score_range", "customer_age_bracket", "customer_income_bracket", "customer_verification_level",
    "product_risk_category", "device_type", "risk_level", "risk_scenario", "payment_provider", "installment_count",
    "payment_type", "purchase_context",
}


def oracle(name: str, body: str, doubles: str = "", views: dict[str, str] | None = None) -> None:
    """Registers SQL; ``doubles`` lists the columns to round, as ``column`` or ``column:digits``."""
    parts = []
    for item in doubles.split():
        column, _, digits = item.partition(":")
        scale = f"1e{digits or 6}"
        x = f'CAST("{column}" AS DOUBLE)'
        parts.append(f'CASE WHEN abs({x}) < 1e12 THEN floor({x} * {scale} + CAST(0.501 AS DOUBLE)) / {scale} '
                     f'ELSE {x} END AS "{column}"')
    extra = views or {}
    replace = f" REPLACE ({', '.join(parts)})" if parts else ""
    used = needed(" ".join([body, *extra.values()]))
    ctes = [f"{v} AS ({VIEWS[v]})" for v in used] + [f"{v} AS ({sql})" for v, sql in extra.items()]
    prefix = f"WITH RECURSIVE {', '.join(ctes)} " if ctes else ""
    ORACLES[name] = f"{prefix}SELECT *{replace} FROM ({body})"


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)


def structs(cells: list[str], source: str) -> str:
    return f"SELECT unnest([{', '.join(cells)}], recursive := true) FROM {source}"


def quoted(columns) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def sigmoid(margin: str) -> str:
    return f"1 / (1 + exp(-({margin})))"


# Scans, sources, sinks

oracle("load_transactions", "SELECT * FROM T", "amount product_price risk_score payment_credit_limit")


def sampled(seed: int, size: int) -> str:
    return (f"SELECT customer_id FROM (SELECT DISTINCT customer_id FROM T) "
            f"ORDER BY md5(concat(customer_id, '{seed}')), customer_id LIMIT {size}")


oracle("sample_customers", sampled(42, 100))
oracle("sample_customers_random", sampled(7, 1000))
oracle("sample_rows", "SELECT transaction_id, customer_id, amount, will_default FROM T "
       "ORDER BY md5(concat(transaction_id, '42')), transaction_id LIMIT 1000", "amount")
oracle("schema_profile", structs([
    "{'ordinal_position': CAST(%d AS INTEGER), 'column_name': '%s', 'data_type': '%s', "
    "'is_nullable': %s, 'has_nulls': count(*) > count(%s)}" % (
        i + 1, c, T_TYPES.get(c, "string"), "false" if c in NEVER_NULL else "true", c)
    for i, c in enumerate(T_COLUMNS)], "T"))
oracle("row_count", "SELECT count(*) AS total_records FROM T")
oracle("load_summary", "SELECT count(*) AS transactions, count(DISTINCT customer_id) AS customers, "
       "avg(CAST(will_default AS INTEGER)) AS default_rate FROM T", "default_rate")

E_DOUBLES = ("amount days_to_first_missed_payment risk_score payment_credit_limit price_comparison_time "
             + " ".join([*CODES, *DUMMY_COLUMNS]))
oracle("feature_table_sink", "SELECT * FROM E", E_DOUBLES)

PREDICTIONS = ", ".join(f"{sigmoid(linear_margin(m))} AS {m}_prediction" for m in MODELS)
SCORED = {"SCORED": (
    "SELECT *, (ridge_prediction + logistic_prediction + elastic_prediction) / 3 AS ensemble_prediction "
    f"FROM (SELECT transaction_id, {PREDICTIONS} FROM X)")}
CONSENSUS = "(ridge_prediction + logistic_prediction + elastic_prediction + ensemble_prediction) / 4"
LOG = (
    "SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, transaction_timestamp AS timestamp, "
    f"{DECISION} AS business_decision, risk_score AS business_risk_score, ridge_prediction, "
    f"logistic_prediction, elastic_prediction, ensemble_prediction, {CONSENSUS} AS consensus_prediction, "
    "CAST(NULL AS BOOLEAN) AS actual_default, CAST(NULL AS INTEGER) AS days_to_resolution, "
    "CAST(NULL AS DOUBLE) AS opportunity_cost FROM T JOIN SCORED USING (transaction_id)")
LOG_DOUBLES = ("business_risk_score ridge_prediction logistic_prediction elastic_prediction "
               "ensemble_prediction consensus_prediction")
oracle("shadow_log_sink", LOG, LOG_DOUBLES, SCORED)
oracle("stream_shadow_score", LOG, LOG_DOUBLES, SCORED)

# Row-level features

oracle("temporal_features", f"SELECT transaction_id, {quoted(TIME_PARTS)} FROM R")
oracle("time_of_day", "SELECT time_of_day, min(transaction_hour) AS first_hour, "
       "max(transaction_hour) AS last_hour, count(*) AS count FROM R GROUP BY 1")
oracle("temporal_flag_rates", "SELECT avg(is_weekend) AS weekend_rate, avg(is_month_end) AS month_end_rate, "
       "avg(is_holiday_season) AS holiday_rate, avg(is_business_hours) AS business_hours_rate, "
       "avg(is_late_night) AS late_night_rate FROM R",
       "weekend_rate month_end_rate holiday_rate business_hours_rate late_night_rate")
oracle("ordinal_encode", f"SELECT transaction_id, {quoted(CODES)} FROM R", " ".join(CODES))
oracle("onehot_fit", "SELECT \"column\", level, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY level) - 1 "
       "AS INTEGER) AS position, row_number() OVER (PARTITION BY \"column\" ORDER BY level) = 1 AS is_base FROM ("
       + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS \"column\", {c} AS level FROM R" for c in NOMINAL_COLUMNS)
       + ")")
oracle("onehot_encode", f"SELECT transaction_id, {quoted(DUMMY_COLUMNS)} FROM R", " ".join(DUMMY_COLUMNS))
oracle("bool_to_int", "SELECT transaction_id, CAST(will_default AS INTEGER) AS will_default, "
       "CAST(device_is_trusted AS INTEGER) AS device_is_trusted FROM T")
CARDINALITY = structs(["{'column': '%s', 'distinct_count': count(DISTINCT %s)}" % (c, c) for c in T_COLUMNS], "T")
TEXTS = ", ".join(f"'{c}'" for c in T_COLUMNS if c not in T_TYPES)
oracle("cardinality_report", CARDINALITY)
oracle("single_value_columns", f"SELECT \"column\" FROM ({CARDINALITY}) WHERE distinct_count <= 1")
oracle("high_cardinality_columns",
       f"SELECT \"column\" FROM ({CARDINALITY}) WHERE distinct_count > 20 AND \"column\" IN ({TEXTS})")
oracle("drop_columns", "SELECT transaction_id, amount, will_default, days_to_first_missed_payment, "
       "customer_tenure_days, device_is_trusted, risk_score, installment_count, payment_credit_limit, "
       "price_comparison_time FROM T", "amount risk_score payment_credit_limit")


def missing(columns, source: str, key: str = "column") -> str:
    cells = ["{'%s': '%s', 'missing_count': count(*) - count(\"%s\"), 'missing_percent': "
             "round_even(100.0 * (count(*) - count(\"%s\")) / count(*), 2)}" % (key, c, c, c) for c in columns]
    return f"SELECT * FROM ({structs(cells, source)}) WHERE missing_count > 0"


oracle("missing_report", missing(T_COLUMNS, "T"), "missing_percent")
oracle("impute", "SELECT transaction_id, coalesce(CAST(days_to_first_missed_payment AS DOUBLE), "
       "(SELECT quantile_cont(days_to_first_missed_payment, 0.5) FROM T)) AS days_to_first_missed_payment, "
       "coalesce(price_comparison_time, (SELECT price_comparison_time FROM T WHERE price_comparison_time "
       "IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS price_comparison_time, amount FROM T",
       "days_to_first_missed_payment amount")
oracle("string_to_numeric", f"SELECT transaction_id, {parsed('time_on_site_seconds')} AS time_on_site_seconds, "
       f"{parsed('price_comparison_time')} AS price_comparison_time FROM T",
       "time_on_site_seconds price_comparison_time")
oracle("clean_and_select", "SELECT * FROM E", E_DOUBLES)
oracle("engineer_features_row", "SELECT * EXCLUDE (transaction_id) FROM E", E_DOUBLES)
MATRIX = [f for f in fx.MODEL_FEATURES]
oracle("model_matrix", "SELECT transaction_id, "
       + ", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in MATRIX) + " FROM E", " ".join(MATRIX))
oracle("standard_scale", "SELECT transaction_id, rn <= ceil(0.2 * cnt) AS is_test, is_weekend, "
       + ", ".join(
           f"({c} - avg({c}) FILTER (rn > ceil(0.2 * cnt)) OVER ()) "
           f"/ stddev_pop({c}) FILTER (rn > ceil(0.2 * cnt)) OVER () AS {c}" for c in SCALED_FEATURES)
       + " FROM XS", "is_weekend " + " ".join(SCALED_FEATURES))
oracle("single_txn_transform", f"SELECT transaction_id, {quoted(MATRIX)} FROM "
       "(SELECT X.* REPLACE (CAST(device_is_trusted AS INTEGER) AS device_is_trusted, "
       "CAST(installment_count AS INTEGER) AS installment_count, "
       "CAST(customer_tenure_days AS BIGINT) AS customer_tenure_days, "
       + ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in TIME_PARTS if c in MATRIX) + ") FROM X)",
       " ".join(f for f in MATRIX if f not in {
           "device_is_trusted", "installment_count", "customer_tenure_days", *TIME_PARTS}))
ORACLES["stream_features"] = ORACLES["single_txn_transform"]
MIDPOINT = "CASE customer_income_bracket " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in INCOME_MIDPOINTS.items()) + " END"
oracle("context_ratio_features", f"SELECT transaction_id, amount / {MIDPOINT} AS amount_to_income_ratio, "
       "amount / payment_credit_limit AS amount_to_credit_ratio, risk_score AS risk_score_normalized FROM T",
       "amount_to_income_ratio amount_to_credit_ratio risk_score_normalized")
oracle("interaction_features", "SELECT transaction_id, CAST(customer_age_bracket = '18-24' AND amount > "
       "(SELECT quantile_cont(amount, 0.75) FROM T) AS INTEGER) AS young_customer_high_amount, "
       "CAST(customer_verification_level = 'unverified' AND product_risk_category = 'high' AS INTEGER) "
       "AS unverified_high_risk_product, CAST(device_type = 'mobile' AND risk_scenario = 'impulse_purchase' "
       "AS INTEGER) AS mobile_impulse_purchase, risk_score * amount AS risk_score_x_amount FROM T",
       "risk_score_x_amount")
oracle("polynomial_features", "SELECT transaction_id, amount * amount AS amount_squared, "
       "amount * risk_score AS amount_x_risk_score, amount * payment_credit_limit AS amount_x_payment_credit_limit, "
       "risk_score * risk_score AS risk_score_squared, "
       "risk_score * payment_credit_limit AS risk_score_x_payment_credit_limit, "
       "payment_credit_limit * payment_credit_limit AS payment_credit_limit_squared FROM T",
       "amount_squared:0 amount_x_risk_score:4 amount_x_payment_credit_limit:0 risk_score_squared "
       "risk_score_x_payment_credit_limit payment_credit_limit_squared")
oracle("target_encode", "SELECT transaction_id, customer_state, coalesce(level_mean, (SELECT "
       "avg(CAST(will_default AS INTEGER)) FROM TS WHERE rn > ceil(0.2 * cnt))) AS customer_state_target_mean "
       "FROM TS LEFT JOIN (SELECT customer_state, avg(CAST(will_default AS INTEGER)) AS level_mean FROM TS "
       "WHERE rn > ceil(0.2 * cnt) GROUP BY 1) USING (customer_state) WHERE rn <= ceil(0.2 * cnt)",
       "customer_state_target_mean")

# Joins

oracle("join_inner_sample", "SELECT customer_id, transaction_id, amount, transaction_timestamp FROM T JOIN "
       f"({sampled(42, 100)}) USING (customer_id)", "amount")
oracle("join_semi_active", "SELECT customer_id, transaction_id, risk_score FROM T WHERE customer_id IN "
       "(SELECT customer_id FROM T GROUP BY 1 HAVING count(*) >= 12)", "risk_score")
oracle("join_cross_scalar", "SELECT * FROM (SELECT count(*) AS total_transactions, avg(amount) AS avg_amount FROM T), "
       "(SELECT quantile_cont(amount, 0.25) AS p25, quantile_cont(amount, 0.5) AS median, "
       "quantile_cont(amount, 0.75) AS p75 FROM T)", "avg_amount p25 median p75")
DAYS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000) AS BIGINT)"
PAID = DAYS.format(a="transaction_date", b="payment_date")
EARLY = DAYS.format(a="payment_date", b="payment_due_date")
TIMED = {"TIMED": f"SELECT *, {PAID} AS dp, {EARLY} AS de, CAST({EARLY} < 0 AS INTEGER) AS late FROM P"}
oracle("join_feature_sets", "SELECT coalesce(a.customer_id, b.customer_id) AS customer_id, "
       "velocity_transaction_id_count, velocity_days_to_payment_mean, risk_transaction_amount_count, "
       "risk_transaction_amount_mean FROM (SELECT customer_id, count(transaction_id) AS "
       "velocity_transaction_id_count, avg(dp) AS velocity_days_to_payment_mean FROM TIMED "
       "WHERE payment_date < payment_due_date GROUP BY 1) a FULL JOIN (SELECT customer_id, "
       "count(transaction_amount) AS risk_transaction_amount_count, avg(transaction_amount) AS "
       "risk_transaction_amount_mean FROM P WHERE transaction_amount > 20000 GROUP BY 1) b "
       "ON a.customer_id = b.customer_id", "velocity_days_to_payment_mean risk_transaction_amount_mean", TIMED)
RANKED = ("SELECT model_name, feature, coefficient, abs(coefficient) AS abs_coefficient, "
          "CAST(row_number() OVER (PARTITION BY model_name ORDER BY abs(coefficient) DESC, feature) AS INTEGER) "
          f"AS importance_rank FROM M WHERE feature <> '{INTERCEPT}'")
oracle("join_importances", f"SELECT feature, abs_coefficient, importance_rank, abs(r) AS abs_correlation "
       f"FROM ({RANKED}) JOIN MR USING (feature) WHERE model_name = 'ridge'", "abs_coefficient abs_correlation")
OUTCOMES = {"OUTCOMES": (
    "SELECT transaction_id, will_default AS actual_default, transaction_timestamp + "
    "to_days(CAST(coalesce(days_to_first_missed_payment, 14) AS INTEGER)) AS resolved_at FROM T")}
oracle("join_outcome_backfill", "SELECT T.transaction_id, transaction_timestamp AS timestamp, "
       f"{DECISION} AS business_decision, actual_default, CAST(datediff('day', transaction_timestamp, resolved_at) "
       "AS INTEGER) AS days_to_resolution FROM T LEFT JOIN (SELECT * FROM OUTCOMES WHERE resolved_at < "
       "TIMESTAMP '2000-01-01') o ON T.transaction_id = o.transaction_id", "", OUTCOMES)
oracle("stream_outcome_join", "SELECT T.transaction_id, transaction_timestamp AS timestamp, "
       f"{DECISION} AS business_decision, actual_default, CAST(datediff('day', transaction_timestamp, resolved_at) "
       "AS INTEGER) AS days_to_resolution FROM T JOIN OUTCOMES o ON T.transaction_id = o.transaction_id",
       "", OUTCOMES)

# Customer-level features

oracle("payment_timing", "SELECT customer_id, transaction_id, dp AS days_to_payment, de AS days_early_late, "
       "late AS is_late_payment FROM TIMED", "", TIMED)
VELOCITY = (
    "count(transaction_id) AS velocity_transaction_id_count, avg(dp) AS velocity_days_to_payment_mean, "
    "stddev_samp(dp) AS velocity_days_to_payment_std, min(dp) AS velocity_days_to_payment_min, "
    "max(dp) AS velocity_days_to_payment_max, avg(de) AS velocity_days_early_late_mean, "
    "stddev_samp(de) AS velocity_days_early_late_std, "
    "CAST(sum(late) AS BIGINT) AS velocity_is_late_payment_sum, "
    "round_even(1 / (1 + coalesce(stddev_samp(dp), 0)), 3) AS velocity_payment_consistency, "
    "round_even(sum(late) / CAST(count(transaction_id) AS DOUBLE), 3) AS velocity_late_payment_rate")
VELOCITY_DOUBLES = ("velocity_days_to_payment_mean velocity_days_to_payment_std velocity_days_early_late_mean "
                    "velocity_days_early_late_std velocity_payment_consistency velocity_late_payment_rate")
INCOME = "any_value(annual_income)"


def limited(top: str, upper: int, bottom: str = INCOME) -> str:
    return (f"round_even(coalesce(CASE WHEN {INCOME} = 0 THEN CASE WHEN {top} > 0 THEN {upper}.0 ELSE 0.0 END "
            f"ELSE greatest(0.0, least({upper}.0, {top} / ({bottom}))) END, 0), 3)")


VARIATION = "stddev_samp(transaction_amount) / nullif(avg(transaction_amount), 0)"
RISK = (
    "coalesce(sum(transaction_amount), 0) AS risk_transaction_amount_sum, "
    "avg(transaction_amount) AS risk_transaction_amount_mean, max(transaction_amount) AS risk_transaction_amount_max, "
    "stddev_samp(transaction_amount) AS risk_transaction_amount_std, "
    "count(transaction_amount) AS risk_transaction_amount_count, any_value(credit_score) AS risk_credit_score_first, "
    f"{INCOME} AS risk_annual_income_first, any_value(customer_age) AS risk_customer_age_first, "
    "CAST(coalesce(sum(failed_payment_count), 0) AS BIGINT) AS risk_failed_payment_count_sum, "
    "CAST(coalesce(sum(dispute_count), 0) AS BIGINT) AS risk_dispute_count_sum, "
    "CAST(coalesce(sum(chargeback_count), 0) AS BIGINT) AS risk_chargeback_count_sum, "
    f"{limited('sum(transaction_amount)', 1)} AS risk_debt_to_income_ratio, "
    f"{limited('avg(transaction_amount)', 2, INCOME + ' / 12')} AS risk_transaction_to_monthly_income, "
    "round_even(count(transaction_amount) / 3.0, 2) AS risk_monthly_transaction_frequency, "
    f"round_even(coalesce({VARIATION}, 0), 3) AS risk_spending_volatility")
RISK_DOUBLES = ("risk_transaction_amount_sum:2 risk_transaction_amount_mean risk_transaction_amount_max "
                "risk_transaction_amount_std risk_annual_income_first risk_debt_to_income_ratio "
                "risk_transaction_to_monthly_income risk_monthly_transaction_frequency risk_spending_volatility")
PROFILE = (
    "count(transaction_amount) AS profile_transaction_amount_count, "
    "coalesce(sum(transaction_amount), 0) AS profile_transaction_amount_sum, "
    "avg(transaction_amount) AS profile_transaction_amount_mean, "
    "stddev_samp(transaction_amount) AS profile_transaction_amount_std, "
    "min(transaction_amount) AS profile_transaction_amount_min, "
    "max(transaction_amount) AS profile_transaction_amount_max, "
    "min(transaction_date) AS profile_transaction_date_min, max(transaction_date) AS profile_transaction_date_max, "
    "any_value(customer_age) AS profile_customer_age_first, any_value(credit_score) AS profile_credit_score_first, "
    "any_value(annual_income) AS profile_annual_income_first, "
    "any_value(employment_status) AS profile_employment_status_first, "
    "any_value(home_ownership_status) AS profile_home_ownership_status_first, "
    + DAYS.format(a="min(transaction_date)", b="max(transaction_date)") + " AS profile_customer_tenure_days, "
    f"round_even(greatest(0.0, least(1.0, coalesce(1 - {VARIATION}, 0))), 3) AS profile_spending_consistency")
PROFILE_DOUBLES = ("profile_transaction_amount_sum:2 profile_transaction_amount_mean profile_transaction_amount_std "
                   "profile_transaction_amount_min profile_transaction_amount_max profile_annual_income_first "
                   "profile_spending_consistency")


def temporal_parts(ts: str) -> str:
    return (
        f"round_even(avg(CAST(isodow({ts}) IN (6, 7) AS INTEGER)), 3) AS temporal_is_weekend_mean, "
        f"round_even(avg(CAST(day({ts}) > 25 AS INTEGER)), 3) AS temporal_is_month_end_mean, "
        f"round_even(avg(CAST(month({ts}) IN (11, 12) AS INTEGER)), 3) AS temporal_is_holiday_season_mean, "
        f"round_even(avg(CAST(hour({ts}) BETWEEN 9 AND 17 AS INTEGER)), 3) AS temporal_is_business_hours_mean, "
        f"round_even(avg(hour({ts})), 3) AS temporal_hour_mean, "
        f"round_even(stddev_samp(hour({ts})), 3) AS temporal_hour_std")


def usual_day(source: str, key: str, ts: str) -> str:
    return (f"SELECT {key}, CAST(arg_min(d, (-n, d)) AS INTEGER) AS temporal_day_of_week_mode FROM (SELECT {key}, "
            f"isodow({ts}) - 1 AS d, count(*) AS n FROM {source} GROUP BY 1, 2) GROUP BY 1")


TEMPORAL_DOUBLES = ("temporal_is_weekend_mean temporal_is_month_end_mean temporal_is_holiday_season_mean "
                    "temporal_is_business_hours_mean temporal_hour_mean temporal_hour_std")
oracle("velocity_features", f"SELECT customer_id, {VELOCITY} FROM TIMED GROUP BY 1", VELOCITY_DOUBLES, TIMED)
oracle("risk_indicator_features", f"SELECT customer_id, {RISK} FROM P GROUP BY 1", RISK_DOUBLES)
oracle("customer_profile", f"SELECT customer_id, {PROFILE} FROM P GROUP BY 1", PROFILE_DOUBLES)
oracle("temporal_profile", f"SELECT * FROM (SELECT customer_id, {temporal_parts('transaction_date')} FROM P GROUP BY 1) "
       f"JOIN ({usual_day('P', 'customer_id', 'transaction_date')}) USING (customer_id)", TEMPORAL_DOUBLES)
oracle("temporal_profile_events", f"SELECT * FROM (SELECT user_id, {temporal_parts('ts')} FROM events GROUP BY 1) "
       f"JOIN ({usual_day('events', 'user_id', 'ts')}) USING (user_id)", TEMPORAL_DOUBLES)
CF = {**TIMED, "CF": (
    f"SELECT * FROM (SELECT customer_id, {PROFILE}, {VELOCITY}, {RISK}, {temporal_parts('transaction_date')} "
    f"FROM TIMED GROUP BY 1) JOIN ({usual_day('P', 'customer_id', 'transaction_date')}) USING (customer_id)")}
oracle("engineer_features_customer", "SELECT * FROM CF",
       " ".join([PROFILE_DOUBLES, VELOCITY_DOUBLES, RISK_DOUBLES, TEMPORAL_DOUBLES]), CF)
oracle("customer_history", "SELECT * FROM (SELECT customer_id, count(*) AS transaction_count, avg(amount) AS avg_amount, "
       "stddev_samp(amount) AS amount_volatility, count(DISTINCT product_category) AS category_diversity FROM T "
       "GROUP BY 1) JOIN (SELECT customer_id, CAST(max(n) AS DOUBLE) / sum(n) AS device_consistency FROM (SELECT "
       "customer_id, device_type, count(*) AS n FROM T GROUP BY 1, 2) GROUP BY 1) USING (customer_id)",
       "avg_amount amount_volatility device_consistency")

# Profiling and underwriting

oracle("business_metrics", "SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS unique_customers, "
       "avg(amount) AS avg_transaction_amount, stddev_samp(amount) AS std_transaction_amount, "
       "min(amount) AS min_transaction_amount, max(amount) AS max_transaction_amount, "
       "min(transaction_timestamp) AS earliest_transaction, max(transaction_timestamp) AS latest_transaction, "
       "quantile_cont(amount, 0.25) AS p25_transaction_amount, quantile_cont(amount, 0.5) AS "
       "median_transaction_amount, quantile_cont(amount, 0.75) AS p75_transaction_amount FROM T",
       "avg_transaction_amount std_transaction_amount min_transaction_amount max_transaction_amount "
       "p25_transaction_amount median_transaction_amount p75_transaction_amount")
oracle("business_metrics_approx", "SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS unique_customers, "
       "avg(amount) AS avg_transaction_amount, stddev_samp(amount) AS std_transaction_amount, "
       "min(amount) AS min_transaction_amount, max(amount) AS max_transaction_amount, "
       "min(transaction_timestamp) AS earliest_transaction, max(transaction_timestamp) AS latest_transaction, "
       "true AS p25_transaction_amount_within, true AS median_transaction_amount_within, "
       "true AS p75_transaction_amount_within FROM T",
       "avg_transaction_amount std_transaction_amount min_transaction_amount max_transaction_amount")
NUMBERS = ["amount", "product_price", "risk_score", "payment_credit_limit", "customer_tenure_days",
           "installment_count"]
oracle("describe_numeric", structs([
    "{'feature': '%s', 'count': count({c}), 'mean': avg({c}), 'std': stddev_samp({c}), "
    "'min': CAST(min({c}) AS DOUBLE), 'max': CAST(max({c}) AS DOUBLE), 'p25': quantile_cont({c}, 0.25), "
    "'median': quantile_cont({c}, 0.5), 'p75': quantile_cont({c}, 0.75)}".replace("{c}", c) % c
    for c in ["transaction_id", "customer_id", "days_to_first_missed_payment", *NUMBERS]], "T"), "mean std min max p25 median p75")
LEVELS = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM T GROUP BY 2" for c in T_COLUMNS)
oracle("categorical_candidates", "SELECT \"column\", unique_count, round_even(CAST(unique_count AS DOUBLE) / rows_n, 3) "
       "AS unique_ratio, sample_values FROM (SELECT \"column\", count(value) AS unique_count, sum(n) AS rows_n FROM "
       "LEVELS GROUP BY 1) LEFT JOIN (SELECT \"column\", string_agg(value, '|' ORDER BY place) AS sample_values FROM "
       "(SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS place FROM LEVELS WHERE "
       "value IS NOT NULL) WHERE place <= 5 GROUP BY 1) USING (\"column\") WHERE unique_count < 50 AND "
       "CAST(unique_count AS DOUBLE) / rows_n < 0.1", "unique_ratio", {"LEVELS": LEVELS})
oracle("value_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS level, count(*) AS count, "
    f"CAST(count(*) AS DOUBLE) / (SELECT count({c}) FROM T) AS share FROM T WHERE {c} IS NOT NULL GROUP BY 2"
    for c in ("customer_age_bracket", "customer_income_bracket", "product_category", "will_default")), "share")
oracle("uniformity_cv", "SELECT \"column\", stddev_samp(n) / avg(n) AS coefficient_of_variation FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS n FROM T GROUP BY {c}"
    for c in ("customer_income_bracket", "product_category")) + ") GROUP BY 1", "coefficient_of_variation")
BAD = "CAST(will_default AS INTEGER)"
oracle("default_rate_by", f"SELECT customer_credit_score_range, avg({BAD}) AS default_rate, count(*) AS count "
       "FROM T GROUP BY 1", "default_rate")
oracle("risk_level_performance", f"SELECT risk_level, count(*) AS total_transactions, CAST(sum({BAD}) AS BIGINT) AS "
       f"actual_defaults, round_even(avg({BAD}), 3) AS default_rate, round_even(avg(risk_score), 3) AS avg_risk_score "
       "FROM T GROUP BY 1", "default_rate avg_risk_score")
oracle("risk_scenario_performance", f"SELECT risk_scenario, count(*) AS transaction_count, round_even(avg({BAD}), 3) AS "
       "default_rate, round_even(avg(risk_score), 3) AS avg_risk_score, round_even(avg(amount), 3) AS avg_amount "
       "FROM T GROUP BY 1", "default_rate avg_risk_score avg_amount")
oracle("credit_risk", "SELECT customer_credit_score_range, round_even(avg(risk_score), 3) AS avg_risk_score, "
       "round_even(stddev_samp(risk_score), 3) AS risk_score_std, count(risk_score) AS count, "
       f"round_even(avg({BAD}), 3) AS actual_default_rate FROM T GROUP BY 1",
       "avg_risk_score risk_score_std actual_default_rate")
SPREAD = {"SPREAD": (
    "SELECT customer_id, count(*) AS transaction_count, count(DISTINCT risk_level) AS unique_risk_levels, "
    "count(DISTINCT risk_score) AS unique_risk_scores, count(DISTINCT risk_scenario) AS unique_risk_scenarios, "
    "min(risk_score) AS min_risk_score, max(risk_score) AS max_risk_score, stddev_samp(risk_score) AS "
    "risk_score_stddev, array_to_string(list_sort(list(DISTINCT risk_level)), '|') AS risk_levels, "
    "array_to_string(list_sort(list(DISTINCT risk_scenario)), '|') AS risk_scenarios FROM T "
    "GROUP BY 1 HAVING count(*) >= 3")}
oracle("customer_risk_spread", "SELECT * FROM SPREAD", "min_risk_score max_risk_score risk_score_stddev", SPREAD)
oracle("risk_variation", "SELECT transaction_count, count(*) AS customer_count, avg(unique_risk_levels) AS "
       "avg_unique_risk_levels, avg(unique_risk_scores) AS avg_unique_risk_scores, avg(unique_risk_scenarios) AS "
       "avg_unique_risk_scenarios, avg(risk_score_stddev) AS avg_risk_score_stddev FROM SPREAD GROUP BY 1 "
       "ORDER BY 1 LIMIT 10", "avg_unique_risk_levels avg_unique_risk_scores avg_unique_risk_scenarios "
       "avg_risk_score_stddev", SPREAD)
COUNTS = {"COUNTS": "SELECT customer_id, count(*) AS transactions FROM T GROUP BY 1"}
oracle("topk_customers", "SELECT * FROM COUNTS ORDER BY transactions DESC, customer_id LIMIT 10", "", COUNTS)
oracle("repeat_customers", "SELECT * FROM (SELECT * FROM COUNTS WHERE transactions >= 2 ORDER BY transactions DESC, "
       "customer_id LIMIT 10), (SELECT count(*) AS total_customers, count(*) FILTER (transactions >= 2) AS "
       "repeat_customers, max(transactions) AS max_transactions FROM COUNTS)", "", COUNTS)
LIMITS = {"LIMITS": "SELECT min(risk_score) AS rlo, max(risk_score) AS rhi, min(amount) AS alo, max(amount) AS ahi FROM T"}
oracle("calibration_bins", "SELECT CAST(len(list_filter(range(1, 10), lambda i: i * ((rhi - rlo) / 10.0) + rlo < "
       f"risk_score)) AS INTEGER) AS bin, avg(risk_score) AS avg_risk_score, avg({BAD}) AS actual_default_rate, "
       "count(*) AS count FROM T, LIMITS GROUP BY 1", "avg_risk_score actual_default_rate", LIMITS)


def bars(column: str, lo: str, hi: str, bins: int) -> str:
    step = f"(({hi} - {lo}) / {bins}.0)"
    return (f"SELECT '{column}' AS feature, bin, bin * {step} + {lo} AS lower_edge, count FROM (SELECT "
            f"CAST(len(list_filter(range(1, {bins}), lambda i: i * {step} + {lo} <= {column})) AS INTEGER) AS bin, "
            f"{lo}, {hi}, count(*) AS count FROM T, LIMITS GROUP BY ALL)")


oracle("histogram", bars("amount", "alo", "ahi", 50) + " UNION ALL " + bars("risk_score", "rlo", "rhi", 30),
       "lower_edge", LIMITS)
oracle("underwriting_effectiveness", "SELECT *, high_risk_default_rate / low_risk_default_rate AS discrimination_ratio "
       f"FROM (SELECT avg({BAD}) AS overall_default_rate, avg(CAST(risk_level IN ('high', 'very_high') AS INTEGER)) AS "
       f"risk_coverage, avg({BAD}) FILTER (risk_level IN ('high', 'very_high')) AS high_risk_default_rate, "
       f"avg({BAD}) FILTER (risk_level IN ('low', 'medium')) AS low_risk_default_rate FROM T)",
       "overall_default_rate risk_coverage high_risk_default_rate low_risk_default_rate discrimination_ratio")
oracle("underwriting_baseline", "SELECT *, greatest(current_discrimination * 1.1, 4.0) AS target_discrimination, "
       "0.4 AS target_precision FROM RATES, (SELECT max(default_rate) FILTER (risk_level_encoded = 2) / "
       "max(default_rate) FILTER (risk_level_encoded = 0) AS current_discrimination FROM RATES)",
       "risk_level_encoded default_rate current_discrimination target_discrimination target_precision",
       {"RATES": f"SELECT risk_level_encoded, count(*) AS transaction_count, round_even(avg({BAD}), 3) AS default_rate "
                 "FROM R GROUP BY 1"})
oracle("box_stats_by", "SELECT customer_age_bracket, q1, median, q3, min(amount) FILTER (amount >= q1 - 1.5 * (q3 - q1) "
       "AND amount <= q3 + 1.5 * (q3 - q1)) AS whisker_low, max(amount) FILTER (amount >= q1 - 1.5 * (q3 - q1) AND "
       "amount <= q3 + 1.5 * (q3 - q1)) AS whisker_high, count(*) FILTER (amount < q1 - 1.5 * (q3 - q1) OR amount > "
       "q3 + 1.5 * (q3 - q1)) AS outliers FROM T JOIN (SELECT customer_age_bracket, quantile_cont(amount, 0.25) AS q1, "
       "quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) AS q3 FROM T GROUP BY 1) "
       "USING (customer_age_bracket) GROUP BY 1, 2, 3, 4", "q1 median q3 whisker_low whisker_high")
oracle("pair_correlation", structs([
    "{'feature_a': 'amount', 'feature_b': '%s', 'correlation': corr(amount, %s)}" % (c, c)
    for c in ("product_price", "risk_score")], "T"), "correlation")
STRENGTH = ("SELECT feature, r AS correlation, abs(r) > 0.1 AS above_10, abs(r) > 0.05 AS above_05 FROM MR")
oracle("target_correlations", STRENGTH, "correlation")
oracle("topk_abs_correlation", f"SELECT * FROM ({STRENGTH}) ORDER BY abs(correlation) DESC, feature LIMIT 10", "correlation")


def all_pairs(columns: list[str], source: str) -> str:
    cells = [
        "{'feature_a': '%s', 'feature_b': '%s', 'correlation': corr(%s, %s)}" % (a, b, a, b)
        for i, a in enumerate(columns) for b in columns[i + 1:]]
    return (f"SELECT feature_a, feature_b, CASE WHEN isnan(correlation) THEN NULL ELSE correlation END AS correlation "
            f"FROM ({structs(cells, source)})")


oracle("correlation_matrix", all_pairs(MATRIX, "X"), "correlation")
CF_TEXT = {"profile_employment_status_first", "profile_home_ownership_status_first",
           "profile_transaction_date_min", "profile_transaction_date_max"}
CF_COLUMNS = [
    "profile_transaction_amount_count", "profile_transaction_amount_sum", "profile_transaction_amount_mean",
    "profile_transaction_amount_std", "profile_transaction_amount_min", "profile_transaction_amount_max",
    "profile_transaction_date_min", "profile_transaction_date_max", "profile_customer_age_first",
    "profile_credit_score_first", "profile_annual_income_first", "profile_employment_status_first",
    "profile_home_ownership_status_first", "velocity_transaction_id_count", "velocity_days_to_payment_mean",
    "velocity_days_to_payment_std", "velocity_days_to_payment_min", "velocity_days_to_payment_max",
    "velocity_days_early_late_mean", "velocity_days_early_late_std", "velocity_is_late_payment_sum",
    "risk_transaction_amount_sum", "risk_transaction_amount_mean", "risk_transaction_amount_max",
    "risk_transaction_amount_std", "risk_transaction_amount_count", "risk_credit_score_first",
    "risk_annual_income_first", "risk_customer_age_first", "risk_failed_payment_count_sum",
    "risk_dispute_count_sum", "risk_chargeback_count_sum", "temporal_is_weekend_mean",
    "temporal_is_month_end_mean", "temporal_is_holiday_season_mean", "temporal_is_business_hours_mean",
    "temporal_hour_mean", "temporal_hour_std", "temporal_day_of_week_mode", "profile_customer_tenure_days",
    "profile_spending_consistency", "velocity_payment_consistency", "velocity_late_payment_rate",
    "risk_debt_to_income_ratio", "risk_transaction_to_monthly_income", "risk_monthly_transaction_frequency",
    "risk_spending_volatility",
]
CF_NUMBERS = [c for c in CF_COLUMNS if c not in CF_TEXT]
HIGH_PAIRS = (f"SELECT feature_a, feature_b, round_even(abs(correlation), 3) AS correlation FROM "
              f"({all_pairs(CF_NUMBERS, 'CF')}) WHERE abs(correlation) > 0.8")
oracle("high_correlation_pairs", HIGH_PAIRS, "correlation", CF)
P_NUMBERS = ["transaction_id", "customer_id", "transaction_amount", "credit_score", "annual_income", "customer_age",
             "failed_payment_count", "dispute_count", "chargeback_count"]


def constants(columns: list[str], source: str) -> str:
    cells = ["{'feature': '%s', 'c': count(%s) > 1 AND min(%s) = max(%s)}" % (c, c, c, c) for c in columns]
    return f"SELECT feature FROM ({structs(cells, source)}) WHERE c"


def skewed(columns: list[str], source: str) -> str:
    cells = ["{'feature': '%s', 's': skewness(%s)}" % (c, c) for c in columns]
    return (f"SELECT feature, round_even(s, 2) AS skewness FROM ({structs(cells, source)}) "
            "WHERE NOT isnan(s) AND abs(s) > 5")


oracle("constant_features", constants(P_NUMBERS, "P"))
oracle("skew_outliers", skewed(["transaction_amount", "annual_income", "disputed_chargeback_amount"],
       "(SELECT *, CASE WHEN dispute_count + chargeback_count = 2 THEN transaction_amount ELSE 0.0 END AS "
       "disputed_chargeback_amount FROM P)"),
       "skewness")
oracle("validate_features", " UNION ALL ".join([
    f"SELECT 'feature_count' AS \"check\", NULL AS feature, NULL AS other, {len(CF_COLUMNS)}.0 AS value",
    "SELECT 'customer_count', NULL, NULL, count(*) FROM CF",
    f"SELECT 'missing_percent', feature, NULL, missing_percent FROM ({missing(CF_COLUMNS, 'CF', 'feature')})",
    f"SELECT 'constant', feature, NULL, 0 FROM ({constants(CF_NUMBERS, 'CF')})",
    f"SELECT 'skewness', feature, NULL, skewness FROM ({skewed(CF_NUMBERS, 'CF')})",
    f"SELECT 'high_correlation', feature_a, feature_b, correlation FROM ({HIGH_PAIRS})"]), "value", CF)
oracle("linear_trend", f"SELECT regr_slope({BAD}, risk_score) AS slope, regr_intercept({BAD}, risk_score) AS intercept, "
       f"corr({BAD}, risk_score) AS correlation FROM T", "slope intercept correlation")
TRAIN = "(SELECT * FROM XS WHERE rn > ceil(0.2 * cnt))"
TEST = "(SELECT * FROM XS WHERE rn <= ceil(0.2 * cnt))"
BASELINE = feature_structs("'mean': avg({f}), 'std': stddev_samp({f}), 'min': min({f}), 'max': max({f}), "
                           "'default_rate': avg(will_default), 'total_samples': count(*)", TRAIN)
oracle("drift_baseline", BASELINE, "mean std min max default_rate")
BATCH = feature_structs("'batch_mean': avg({f}), 'batch_min': min({f}), 'batch_max': max({f})", TEST)
oracle("drift_check", "SELECT feature, mean, batch_mean, (batch_mean - mean) / nullif(std, 0) AS shift, "
       "coalesce(abs((batch_mean - mean) / nullif(std, 0)) > 0.03, false) AS drifted, "
       f"batch_min < min OR batch_max > max AS out_of_range FROM ({BASELINE}) JOIN ({BATCH}) USING (feature)",
       "mean batch_mean shift")
CUTS = feature_structs("'e': list_sort(list_distinct([" + ", ".join(
    f"quantile_disc({{f}}, {i / 10})" for i in range(1, 10)) + "]))", TRAIN)
LONG = "UNPIVOT (SELECT " + ", ".join(f'CAST("{f}" AS DOUBLE) AS "{f}"' for f in MATRIX) + " FROM {}) ON COLUMNS(*) INTO NAME feature VALUE x"
BINNED = {
    "CUTS": CUTS,
    "CELLS": "SELECT feature, unnest(range(0, len(e) + 1)) AS bin FROM CUTS",
    "BINS_OF": ("SELECT feature, len(list_filter(e, lambda v: v < x)) AS bin, side FROM (SELECT *, 0 AS side FROM ("
               + LONG.format(TRAIN) + ") UNION ALL SELECT *, 1 FROM (" + LONG.format(TEST) + ")) JOIN CUTS USING (feature)"),
    "SHARES": ("SELECT feature, bin, a / sum(a) OVER w AS p, b / sum(b) OVER w AS q, abs(sum(a) OVER u / sum(a) OVER w - sum(b) OVER u / "
               "sum(b) OVER w) AS gap FROM (SELECT c.feature, c.bin, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b "
               "FROM CELLS c LEFT JOIN BINS_OF p ON p.feature = c.feature AND p.bin = c.bin GROUP BY 1, 2) "
               "WINDOW w AS (PARTITION BY feature), u AS (PARTITION BY feature ORDER BY bin)"),
}
oracle("drift_distribution", "SELECT *, psi > 0.2 OR ks > 0.1 AS drifted FROM (SELECT feature, sum((greatest(q, 1e-4) - greatest(p, 1e-4)) * "
       "ln(greatest(q, 1e-4) / greatest(p, 1e-4))) AS psi, max(gap) AS ks, 0.0 AS baseline_missing, 0.0 AS batch_missing FROM SHARES GROUP BY 1)",
       "psi ks baseline_missing batch_missing", BINNED)
oracle("kpi_rates", f"SELECT CAST(date_trunc('month', transaction_timestamp) AS TIMESTAMP) AS period, count(*) AS "
       f"transactions, avg(CAST({DECISION} = 'approve' AS INTEGER)) AS approval_rate, avg({BAD}) AS default_rate, "
       f"avg({BAD}) FILTER ({DECISION} = 'approve') AS approved_default_rate FROM T GROUP BY 1",
       "approval_rate default_rate approved_default_rate")

# Windows, sorting, sets

oracle("customer_sequences", "SELECT customer_id, row_number() OVER (PARTITION BY customer_id ORDER BY "
       "transaction_timestamp, transaction_id) AS position, transaction_timestamp, transaction_id, amount, "
       "risk_level, risk_score, will_default, min(transaction_timestamp) OVER (PARTITION BY customer_id) AS first_seen, "
       "max(transaction_timestamp) OVER (PARTITION BY customer_id) AS last_seen, risk_levels, outcomes, unique_risk_scores "
       "FROM T JOIN (SELECT customer_id, string_agg(DISTINCT risk_level, '|' ORDER BY risk_level) AS risk_levels, "
       "string_agg(DISTINCT CAST(will_default AS VARCHAR), '|' ORDER BY CAST(will_default AS VARCHAR)) AS outcomes, "
       "count(DISTINCT risk_score) AS unique_risk_scores FROM T GROUP BY 1) USING (customer_id) WHERE customer_id IN (SELECT "
       "customer_id FROM COUNTS ORDER BY transactions DESC, customer_id LIMIT 3)", "amount risk_score", COUNTS)
oracle("importance_rank", RANKED, "coefficient abs_coefficient")
oracle("cumulative_counts", "SELECT model_name, score, CAST(tp AS BIGINT) AS tp, CAST(above - tp AS BIGINT) AS fp FROM Q",
       "score")
oracle("score_tertiles", "SELECT model_name, transaction_id, segment FROM SEG")
oracle("sort_history", "SELECT customer_id, transaction_timestamp, transaction_id, amount FROM T", "amount")
oracle("ordered_category_sort", "SELECT risk_level, count(*) AS count, CAST(CASE risk_level WHEN 'low' THEN 0 WHEN "
       "'medium' THEN 1 WHEN 'high' THEN 2 WHEN 'very_high' THEN 3 ELSE 4 END AS INTEGER) AS place FROM T GROUP BY 1")
oracle("distinct_customers", "SELECT DISTINCT customer_id FROM T")

# Splits

oracle("stratified_split", "SELECT transaction_id, will_default, rn <= ceil(0.2 * cnt) AS is_test FROM TS")
oracle("stratified_folds", "SELECT transaction_id, will_default, CAST("
       + " + ".join(f"CAST(rn > floor(cnt * {i} / 5.0) AS INTEGER)" for i in range(1, 5)) + " AS INTEGER) AS fold FROM TS")
oracle("stratified_subsample", "SELECT transaction_id, will_default FROM TS JOIN (SELECT will_default AS w, "
       "floor(least(10000, total) * (before + n) / total) - floor(least(10000, total) * before / total) AS share FROM "
       "(SELECT will_default, count(*) AS n, sum(count(*)) OVER () AS total, coalesce(sum(count(*)) OVER (ORDER BY "
       "will_default ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM T GROUP BY 1)) "
       "ON w = will_default WHERE rn <= share")

# Models

oracle("fit_bernoulli_nb", "SELECT feature, class, positives, ln((positives + 1.0) / (n + 2)) AS log_probability, "
       "ln(1 - (positives + 1.0) / (n + 2)) AS log_complement, ln(CAST(n AS DOUBLE) / (SELECT count(*) FROM "
       f"{TRAIN})) AS log_prior FROM (" + " UNION ALL ".join(
           feature_structs("'class': CAST(%d AS INTEGER), 'positives': CAST(sum(CAST({f} > 0 AS INTEGER)) AS BIGINT), "
                           "'n': count(*)" % c, TRAIN, f"WHERE will_default = {c}") for c in (0, 1)) + ")",
       "log_probability log_complement log_prior")
MARGINS = " UNION ALL ".join(
    f"SELECT transaction_id, '{m}' AS model_name, {linear_margin(m)} AS margin FROM X" for m in MODELS)
oracle("score_linear", MARGINS, "margin")
oracle("decision_to_probability", f"SELECT transaction_id, model_name, {sigmoid('margin')} AS score FROM ({MARGINS})",
       "score")
oracle("select_candidates", "SELECT * FROM (SELECT * FROM AUC ORDER BY auc DESC, model_name LIMIT 8) WHERE auc >= 0.615",
       "auc")
WIDE = {"WIDE": "SELECT transaction_id, label, " + ", ".join(
    f"max(score) FILTER (model_name = '{m}') AS {m}" for m in MODELS) + " FROM S GROUP BY 1, 2"}
MEAN = "(ridge + logistic + elastic) / 3"
oracle("vote_soft", f"SELECT transaction_id, label, {MEAN} AS soft_vote FROM WIDE", "soft_vote", WIDE)
VOTES = " + ".join(f"CAST({m} > 0.5 AS INTEGER)" for m in MODELS)
oracle("vote_hard", f"SELECT transaction_id, label, CAST({VOTES} AS INTEGER) AS votes, CAST(({VOTES}) * 2 > 3 AS INTEGER) "
       f"AS hard_vote, {MEAN} AS hard_vote_score FROM WIDE", "hard_vote_score", WIDE)
oracle("vote_weighted", "SELECT transaction_id, label, (ridge * (SELECT auc FROM AUC WHERE model_name = 'ridge') + "
       "logistic * (SELECT auc FROM AUC WHERE model_name = 'logistic') + elastic * (SELECT auc FROM AUC WHERE "
       "model_name = 'elastic')) / (SELECT sum(auc) FROM AUC) AS weighted_vote FROM WIDE", "weighted_vote", WIDE)


def auc_sql(source: str, by: str) -> str:
    """Area under the curve by rank sums, for rows of (by, label, score)."""
    return (f"SELECT {by}, (sum(mid * pos) - max(np) * (max(np) + 1) / 2.0) / (CAST(max(np) AS DOUBLE) * "
            f"(max(nt) - max(np))) AS auc FROM (SELECT {by}, pos, sum(n) OVER (PARTITION BY {by} ORDER BY score) - "
            f"n / 2.0 + 0.5 AS mid, sum(pos) OVER (PARTITION BY {by}) AS np, sum(n) OVER (PARTITION BY {by}) AS nt "
            f"FROM (SELECT {by}, score, count(*) AS n, sum(label) AS pos FROM ({source}) GROUP BY ALL)) GROUP BY {by}")


VOTED = (f"SELECT 'soft_vote' AS model_name, label, round({MEAN}, 9) AS score FROM WIDE UNION ALL "
         "SELECT 'pair_vote', label, round((ridge + logistic) / 2, 9) FROM WIDE")
oracle("ensemble_compare", f"SELECT model_name, auc, auc - (SELECT max(auc) FROM AUC) AS vs_best_single FROM "
       f"({auc_sql(VOTED, 'model_name')})", "auc vs_best_single", WIDE)

# Evaluation

oracle("roc_auc", "SELECT * FROM AUC", "auc")
oracle("pr_curve", "SELECT model_name, score AS threshold, prec AS precision, rec AS recall FROM Q UNION ALL "
       "SELECT DISTINCT model_name, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM Q", "threshold precision recall")
AP = "sum(CAST(pos AS DOUBLE) / positives * prec)"
oracle("average_precision", f"SELECT model_name, {AP} AS average_precision FROM Q GROUP BY 1", "average_precision")


def recall_at(targets) -> str:
    return ", ".join(
        f"coalesce(max(rec) FILTER (prec >= {t}), 0.0) AS recall_at_{round(t * 100)}_precision, "
        f"coalesce(min(score) FILTER (prec >= {t}), 1.0) AS threshold_for_{round(t * 100)}_precision" for t in targets)


def recall_names(targets) -> str:
    return " ".join(f"recall_at_{round(t * 100)}_precision threshold_for_{round(t * 100)}_precision" for t in targets)


def precision_at(targets) -> str:
    return ", ".join(
        f"coalesce(max(prec) FILTER (rec >= {t}), 0.0) AS precision_at_{round(t * 100)}_recall, "
        f"coalesce(arg_min(score, (-prec, score)) FILTER (rec >= {t}), 0.0) AS threshold_for_{round(t * 100)}_recall"
        for t in targets)


def precision_names(targets) -> str:
    return " ".join(f"precision_at_{round(t * 100)}_recall threshold_for_{round(t * 100)}_recall" for t in targets)


oracle("recall_at_precision", f"SELECT model_name, {recall_at((0.07, 0.10, 0.90))} FROM Q GROUP BY 1",
       recall_names((0.07, 0.10, 0.90)))
oracle("precision_at_recall", f"SELECT model_name, {precision_at((0.7, 0.8, 0.9))} FROM Q GROUP BY 1",
       precision_names((0.7, 0.8, 0.9)))
THRESHOLDS = ", ".join(f"(CAST({v!r} AS DOUBLE))" for v in sweep_thresholds(0.1, 0.9, 50))
SWEEP = {
    "GRID": ("SELECT model_name, threshold, CAST(max(size) - max(positives) - fl + tpos AS BIGINT) AS tn, "
             "CAST(fl - tpos AS BIGINT) AS fp, CAST(max(positives) - tpos AS BIGINT) AS fn, CAST(tpos AS BIGINT) AS tp "
             "FROM (SELECT model_name, threshold, size, positives, coalesce(sum(n) FILTER (score >= threshold), 0) AS fl, "
             "coalesce(sum(pos) FILTER (score >= threshold), 0) AS tpos FROM Q, (VALUES " + THRESHOLDS + ") v(threshold) "
             "GROUP BY 1, 2, 3, 4) GROUP BY model_name, threshold, fl, tpos"),
    "VALUED": "SELECT *, tp * 108.0 - fp * 21.6 AS net_value FROM GRID",
    "BEST": ("SELECT model_name, threshold AS optimal_business_threshold, net_value AS max_business_value, "
             "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 0) AS precision_at_optimal_threshold, "
             "coalesce(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0) AS recall_at_optimal_threshold, "
             "coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1_at_optimal_threshold FROM VALUED "
             "QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY round(net_value, 6) DESC, threshold) = 1"),
}
BEST_NAMES = ("optimal_business_threshold max_business_value precision_at_optimal_threshold "
              "recall_at_optimal_threshold f1_at_optimal_threshold")
oracle("threshold_table", "SELECT * FROM VALUED", "threshold net_value", SWEEP)
oracle("threshold_sweep", "SELECT * FROM BEST", BEST_NAMES, SWEEP)
oracle("segment_tertiles", "SELECT model_name, segment, count(*) AS count, CAST(sum(label) AS BIGINT) AS defaults, "
       "avg(label) AS default_rate FROM SEG GROUP BY 1, 2", "default_rate")
oracle("top_decile", "SELECT * FROM DECILE", "top10_precision bottom90_rate discrimination_top10")
oracle("percentile_thresholds", " UNION ALL ".join(
    f"SELECT model_name, CAST({100 - p} AS INTEGER) AS top_percent, threshold, avg(label) FILTER (score >= threshold) "
    f"AS precision, CAST(sum(label) FILTER (score >= threshold) AS DOUBLE) / sum(label) AS recall FROM S JOIN "
    f"(SELECT model_name, quantile_cont(score, {p / 100}) AS threshold FROM S GROUP BY 1) USING (model_name) GROUP BY 1, 3"
    for p in (90, 95, 98, 99)), "threshold precision recall")
ASSESSED = ("discrimination_top10 - 2.8 AS improvement_vs_baseline, discrimination_top10 > 2.8 AS beats_baseline, "
            "discrimination_top10 > 4.0 AS exceeds_target, CASE WHEN discrimination_top10 > 4.0 THEN 'exceeds target' "
            "WHEN discrimination_top10 > 2.8 THEN 'beats baseline' ELSE 'below baseline' END AS status")
oracle("business_assessment", f"SELECT *, {ASSESSED} FROM DECILE",
       "top10_precision bottom90_rate discrimination_top10 improvement_vs_baseline")
oracle("evaluate_business", f"SELECT model_name, auc, high_rate / low_rate AS discrimination_equal, discrimination_top10, "
       f"top10_precision, {ASSESSED} FROM AUC JOIN THIRDS USING (model_name) JOIN DECILE USING (model_name)",
       "auc discrimination_equal discrimination_top10 top10_precision improvement_vs_baseline")
FULL = {**SWEEP, "FULL_METRICS": (
    f"SELECT * FROM (SELECT model_name, {AP} AS auc_pr, {recall_at((0.9, 0.95, 0.98))}, "
    f"{precision_at((0.7, 0.8, 0.9))} FROM Q GROUP BY 1) JOIN BEST USING (model_name)")}
oracle("evaluate_comprehensive", "SELECT * FROM FULL_METRICS", " ".join([
    "auc_pr", recall_names((0.9, 0.95, 0.98)), precision_names((0.7, 0.8, 0.9)), BEST_NAMES]), FULL)
KEYS = ["auc_pr", "recall_at_95_precision", "recall_at_90_precision", "precision_at_80_recall",
        "max_business_value", "optimal_business_threshold", "f1_at_optimal_threshold"]
oracle("model_comparison", "SELECT model_name, " + ", ".join(f"round_even({k}, 4) AS {k}" for k in KEYS)
       + " FROM FULL_METRICS", " ".join(KEYS), FULL)
PARTS = {"recall_at_95_precision": 0.35, "auc_pr": 0.25, "max_business_value": 0.25, "recall_at_90_precision": 0.15}
WEIGHTED = " + ".join(
    f"{w} * CASE WHEN max({k}) OVER () > 0 THEN {k} / max({k}) OVER () ELSE 0 END" for k, w in PARTS.items())
oracle("business_ranking", "SELECT *, CASE WHEN place = 1 THEN 'champion' ELSE 'challenger' END AS status FROM (SELECT *, "
       "CAST(row_number() OVER (ORDER BY ranking_score DESC, model_name) AS INTEGER) AS place FROM (SELECT model_name, "
       + ", ".join(PARTS) + f", {WEIGHTED} AS ranking_score FROM FULL_METRICS))",
       " ".join(PARTS) + " ranking_score", FULL)
oracle("score_diagnostics", "SELECT model_name, count(*) AS samples, CAST(sum(label) AS BIGINT) AS defaults, avg(label) AS "
       "default_rate, avg(CAST((score > 0.5) = (label = 1) AS INTEGER)) AS accuracy, any_value(auc) AS auc, min(score) AS "
       "min_score, max(score) AS max_score, avg(score) AS mean_score, count(*) FILTER (score > 0.5) AS above_cut, "
       "avg(label) < 0.02 AS very_low_default_rate, max(score) < 0.5 AS all_scores_low FROM S JOIN AUC USING (model_name) "
       "GROUP BY 1", "default_rate accuracy auc min_score max_score mean_score")
oracle("discrimination_report", "SELECT *, 2.8 AS rule_discrimination, CASE WHEN discrimination_ratio > 2.8 THEN "
       "'beats rules' WHEN discrimination_ratio >= 1.5 THEN 'acceptable' WHEN discrimination_ratio > 1.0 THEN "
       "'better than random' ELSE 'below minimum' END AS band FROM (SELECT *, high_rate / low_rate AS "
       "discrimination_ratio FROM THIRDS)", "high_rate low_rate discrimination_ratio rule_discrimination")
oracle("cost_structure", "SELECT transaction_id, amount * 0.75 AS missed_default_cost, amount * 0.15 AS "
       "rejected_good_cost, (amount * 0.75) / (amount * 0.15) AS cost_ratio FROM T",
       "missed_default_cost rejected_good_cost cost_ratio")

# Importance

oracle("coefficient_importance", "SELECT *, min(coefficient) OVER w AS min_coefficient, max(coefficient) OVER w AS "
       "max_coefficient, avg(abs_coefficient) OVER w AS mean_abs_coefficient, stddev_pop(coefficient) OVER w AS "
       f"std_coefficient FROM ({RANKED}) WINDOW w AS (PARTITION BY model_name)",
       "coefficient abs_coefficient min_coefficient max_coefficient mean_abs_coefficient std_coefficient")
FAMILY = (
    "CASE WHEN regexp_matches(feature, 'customer_credit_score|customer_age|customer_income|customer_verification') "
    "THEN 'Customer Demographics' WHEN regexp_matches(feature, 'device_type|device_is_trusted') THEN "
    "'Device/Technology' WHEN regexp_matches(feature, 'payment_provider|payment_credit_limit') THEN 'Payment Context' "
    "WHEN regexp_matches(feature, 'product_category|product_risk') THEN 'Product Features' WHEN regexp_matches(feature, "
    "'purchase_context|price_comparison') THEN 'Purchase Behavior' WHEN regexp_matches(feature, "
    "'risk_score|risk_scenario|risk_level') THEN 'Risk Assessment' WHEN regexp_matches(feature, "
    "'is_weekend|is_month_end|is_holiday|is_business|is_late|time_of_day|week_of_month') THEN 'Temporal Features' "
    "WHEN feature IN ('amount', 'installment_count', 'customer_tenure_days') THEN 'Transaction Details' ELSE 'Other' END")
oracle("feature_category", f"SELECT model_name, feature, coefficient, {FAMILY} AS category FROM M", "coefficient")
oracle("category_importance", "SELECT * EXCLUDE (deviation), CASE WHEN avg_abs_coef > deviation THEN 'High' WHEN "
       "avg_abs_coef > deviation / 2 THEN 'Medium' ELSE 'Low' END AS impact FROM (SELECT model_name, "
       f"{FAMILY} AS category, round_even(avg(abs(coefficient)), 4) AS avg_abs_coef, round_even(sum(abs(coefficient)), 4) "
       "AS total_abs_coef, count(*) AS feature_count, round_even(avg(coefficient), 4) AS avg_coef FROM M GROUP BY 1, 2) "
       "JOIN (SELECT model_name, stddev_pop(coefficient) AS deviation FROM M GROUP BY 1) USING (model_name)",
       "avg_abs_coef total_abs_coef avg_coef")
RIDGE = {f: w for _, m, _, _, f, w in fx.coefficient_rows() if m == "ridge" and f != INTERCEPT and w}
PERMUTED = {
    "PLACED": (f"SELECT will_default AS label, {linear_margin('ridge')} AS margin, row_number() OVER (ORDER BY "
               "md5(concat(transaction_id, '42')), transaction_id) AS place, count(*) OVER () AS size, ["
               + ", ".join(f'CAST({w!r} AS DOUBLE) * "{f}"' for f, w in RIDGE.items()) + "] AS terms FROM " + TEST),
    "MOVED": ("SELECT feature, repeat, label, round(margin + change, 6) AS score FROM (SELECT a.label, a.margin, repeat, "
              "unnest([" + ", ".join(f"'{f}'" for f in RIDGE) + "]) AS feature, unnest(list_transform(list_zip(a.terms, "
              "b.terms), lambda z: z[2] - z[1])) AS change FROM PLACED a, range(1, 11) r(repeat) JOIN PLACED b "
              "ON b.place = (a.place - 1 + 1 + (repeat * 7919) % greatest(a.size - 1, 1)) % a.size + 1)"),
}
BASE = "SELECT 'ridge' AS model_name, label, round(margin, 6) AS score FROM PLACED"
oracle("permutation_importance", f"SELECT feature, avg(base - auc) AS perm_importance, stddev_pop(base - auc) AS perm_std "
       f"FROM ({auc_sql('SELECT * FROM MOVED', 'feature, repeat')}), (SELECT auc AS base FROM "
       f"({auc_sql(BASE, 'model_name')})) GROUP BY 1", "perm_importance perm_std", PERMUTED)

# Shadow scoring and registry

oracle("shadow_score", f"SELECT *, 'ridge' AS champion, ridge_prediction AS champion_score, {CONSENSUS} AS "
       "consensus_prediction FROM SCORED", "ridge_prediction logistic_prediction elastic_prediction "
       "ensemble_prediction champion_score consensus_prediction", SCORED)


def decision_cost(decision: str) -> str:
    return (f"CASE WHEN {decision} = 'approve' AND will_default THEN amount * 0.75 "
            f"WHEN {decision} = 'decline' AND NOT will_default THEN amount * 0.15 ELSE 0 END")


oracle("shadow_compare", "SELECT business_decision, model_decision, count(*) AS transactions, count(*) FILTER "
       f"(will_default) AS defaults, avg({BAD}) AS default_rate, sum({decision_cost('business_decision')} - "
       f"{decision_cost('model_decision')}) AS opportunity_cost, business_decision = model_decision AS agreement FROM "
       f"(SELECT *, {DECISION} AS business_decision, CASE WHEN ridge_prediction >= 0.15 THEN 'decline' ELSE 'approve' END "
       "AS model_decision FROM T JOIN SCORED USING (transaction_id)) GROUP BY 1, 2", "default_rate opportunity_cost:2",
       SCORED)
KNOWN_COST = decision_cost("business_decision") + " - " + decision_cost("model_decision")
oracle("shadow_log_outcomes", "SELECT * EXCLUDE (known, will_default, amount, resolved_at, model_decision) REPLACE (CASE WHEN known THEN will_default END AS actual_default, CASE WHEN known THEN "
       "CAST(datediff('day', timestamp, resolved_at) AS INTEGER) END AS days_to_resolution, CASE WHEN known THEN "
       f"CAST({KNOWN_COST} AS DOUBLE) END AS opportunity_cost) FROM "
       f"(SELECT L.*, T.will_default, T.amount, o.resolved_at, o.resolved_at < TIMESTAMP '2000-01-01' AS known, "
       f"CASE WHEN L.ridge_prediction >= 0.15 THEN 'decline' ELSE 'approve' END AS model_decision FROM ({LOG}) L "
       "JOIN T ON L.transaction_id = CAST(T.transaction_id AS VARCHAR) JOIN OUTCOMES o ON o.transaction_id = T.transaction_id)",
       LOG_DOUBLES + " opportunity_cost", {**SCORED, **OUTCOMES})
oracle("stream_customer_features", f"SELECT * FROM (SELECT customer_id, {VELOCITY}, {temporal_parts('transaction_date')} "
       f"FROM TIMED GROUP BY 1) JOIN ({usual_day('P', 'customer_id', 'transaction_date')}) USING (customer_id)",
       VELOCITY_DOUBLES + " " + TEMPORAL_DOUBLES, TIMED)
REGISTERED = ("SELECT 'bnpl' AS domain, model_name, 'v0.1.0' AS version, CASE WHEN model_name = 'ridge' THEN 'champion' "
              "ELSE 'challenger' END AS role, feature, coefficient FROM M")
oracle("model_registry_table", f"SELECT * FROM ({REGISTERED}) WHERE role = 'challenger'", "coefficient")
oracle("model_registry_list", "SELECT domain, model_name, version, role, count(*) AS coefficients FROM "
       f"({REGISTERED}) GROUP BY 1, 2, 3, 4")

# Streaming

oracle("stream_kpi_window", "SELECT * FROM (SELECT date_trunc('day', ts) AS period_start, date_trunc('day', ts) + "
       "INTERVAL 1 DAY AS period_end, event_type, count(*) AS events, avg(value) AS mean_value, "
       "avg(CAST(value > 0 AS INTEGER)) AS positive_rate FROM events GROUP BY 1, 2, 3) WHERE period_end <= "
       "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)", "mean_value positive_rate")

# Feature metadata: kept features are numeric after encoding; the rest is listed as removed.

KEPT = ["amount", "days_to_first_missed_payment", *[f for f in MATRIX if f != "amount"]]
REMOVED = [
    "customer_id", "transaction_id", "transaction_timestamp", "customer_state", "product_price", "payment_type",
    "time_on_site_seconds", *ORDINAL_LEVELS, *NOMINAL_COLUMNS, "transaction_hour", "transaction_day_of_week",
    "transaction_month", "transaction_day_of_month",
]
oracle("feature_metadata", "SELECT feature, kind, is_target, removed, (SELECT count(DISTINCT customer_id) FROM T) AS "
       f"unique_customers, (SELECT count(*) FROM T) AS total_transactions, (SELECT avg({BAD}) FROM T) AS default_rate FROM ("
       + " UNION ALL ".join(
           [f"SELECT '{f}' AS feature, 'numeric' AS kind, false AS is_target, false AS removed" for f in KEPT]
           + ["SELECT 'will_default', 'numeric', true, false"]
           + [f"SELECT '{f}', NULL, false, true" for f in REMOVED]) + ")", "default_rate")

# Ridge: the normal equations of the training rows, solved by elimination, one column per step.

WIDTH = len(MATRIX)
SCALED_TRAIN = "SELECT CASE WHEN will_default = 1 THEN 1.0 ELSE -1.0 END AS target, " + ", ".join(
    f"({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER () AS {f}" if f in SCALED_FEATURES else f'"{f}"'
    for f in MATRIX) + f" FROM {TRAIN}"
EQUATIONS = "SELECT [" + ", ".join(
    "[" + ", ".join(
        f'count(*) * covar_pop("{a}", "{b}")' + (" + 1000.0" if a == b else "") for b in [*MATRIX, "target"]) + "]"
    for a in MATRIX) + "] AS m, [" + ", ".join(f'avg("{f}")' for f in MATRIX) + "] AS means, avg(target) AS level FROM Z"
ELIMINATED = (
    "SELECT 0 AS k, m FROM EQUATIONS UNION ALL SELECT k + 1, "
    f"list_transform(range(1, {WIDTH + 1}), lambda i: list_transform(range(1, {WIDTH + 2}), lambda j: "
    "CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1] "
    "ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) "
    f"FROM ELIMINATED WHERE k < {WIDTH}")
SOLUTION = f"list_transform(ELIMINATED.m, lambda e: e[{WIDTH + 1}])"
NAMES = ", ".join(f"'{f}'" for f in MATRIX)
oracle("fit_ridge", f"SELECT 'ridge' AS model_name, unnest([{NAMES}]) AS feature, unnest({SOLUTION}) AS coefficient FROM "
       f"ELIMINATED WHERE k = {WIDTH} UNION ALL SELECT 'ridge', '{INTERCEPT}', level - list_sum(list_transform(list_zip("
       f"{SOLUTION}, means), lambda z: z[1] * z[2])) FROM ELIMINATED, EQUATIONS WHERE k = {WIDTH}", "coefficient",
       {"Z": SCALED_TRAIN, "EQUATIONS": EQUATIONS, "ELIMINATED": ELIMINATED})

# Neighbours: all distances between test and training rows on the scaled features.

ON_TRAIN = "FILTER (rn > ceil(0.2 * cnt)) OVER ()"
NEAREST = {
    "VECTORS": "SELECT transaction_id, will_default, rn <= ceil(0.2 * cnt) AS is_test, [" + ", ".join(
        f'CAST(("{f}" - avg("{f}") {ON_TRAIN}) / coalesce(nullif(stddev_pop("{f}") {ON_TRAIN}, 0), 1) AS DOUBLE)'
        if f in SCALED_FEATURES else f'CAST("{f}" AS DOUBLE)' for f in MATRIX) + "] AS v FROM XS",
    "NEAR": ("SELECT a.transaction_id, min({'d': round(list_distance(a.v, b.v), 9), 'id': b.transaction_id, 'y': CAST(b.will_default AS "
             "DOUBLE)}, 10) AS near FROM (FROM VECTORS WHERE is_test) a, (FROM VECTORS WHERE NOT is_test) b GROUP BY 1"),
}
oracle("knn_score", "SELECT transaction_id, list_avg(list_transform(near[1:5], lambda n: n.y)) AS knn_uniform, CASE WHEN near[1].d = 0 THEN "
       "list_avg(list_transform(list_filter(near, lambda n: n.d = 0), lambda n: n.y)) ELSE list_sum(list_transform(near, lambda n: n.y / n.d)) / "
       "list_sum(list_transform(near, lambda n: 1 / n.d)) END AS knn_distance FROM NEAR", "knn_uniform knn_distance", NEAREST)
