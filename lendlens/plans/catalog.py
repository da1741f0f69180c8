"""The registered queries: name -> function of (session, folder of tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lendlens.constants import ORDINAL_LEVELS, RISK_LEVEL_ORDER, SCALED_FEATURES
from lendlens.operators import (
    adaboost, boosting, clean, customer, derived, drift, encode, evaluate as ev, extra_trees, fit, gradient,
    importance, matrix, newton, pivots, profile, registry, score as sc, split, temporal, train, underwriting as uw,
)
from lendlens.operators.families import portfolio
from lendlens.operators.ordered import exact_quantiles
from lendlens.session import materialize, new_folder, with_defaults, with_scalars
from lendlens.sources import fixtures, sinks, transactions as tx
from lendlens.streaming import customers, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FEATURES = fixtures.MODEL_FEATURES
LABEL, ROW_ID = "will_default", "transaction_id"
MODELS = [m for m, _, _ in fixtures.SCORE_MODELS]
# Queries of several models other than train_compare and successive_search: boosting rounds, epochs, trees and
# their depth, bins. A round or step is a job, so these decide how long a query takes; the operators' own defaults are larger.
ROUNDS, EPOCHS, TREES, DEPTH, BINS = 10, 3, 20, 6, 64


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Doubles to six places (or as given), so that equal results compare equal.

    Halves go up, decided a little early, so that noise in the last bit cannot decide them.
    """
    def cell(f: T.StructField):
        if not isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            return F.col(f.name)
        scale, x = F.lit(10.0 ** digits.get(f.name, 6)), F.col(f.name)
        near = F.floor(x * scale + F.lit(0.501)).cast("double") / scale
        return F.when(F.abs(x) < 1e12, near).otherwise(x).alias(f.name)
    return df.select([cell(f) for f in df.schema.fields])


def query(name: str, **digits: int) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(function(with_defaults(spark), folder), digits)
        QUERIES[name] = run
        return function
    return add


# Inputs ------------------------------------------------------------------------------------


def T_(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.transactions(spark, folder)


def P_(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.payments(spark, folder)


def S_(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.scores(spark, folder)


def curve(spark: SparkSession, folder: str) -> DataFrame:
    return ev.score_curve(S_(spark, folder))


def fitted(spark: SparkSession, folder: str) -> clean.FeaturePipeline:
    """The row pipeline, fitted anew by every query on the tables as they are."""
    return clean.fit_pipeline(T_(spark, folder), "convert_first", (ROW_ID,))


def X_(spark: SparkSession, folder: str) -> DataFrame:
    """Identifier, target and the model features without nulls; the joined input is written once."""
    source = materialize(T_(spark, folder), "transactions")
    rows = clean.fit_pipeline(source, "convert_first", (ROW_ID,)).transform(source, (ROW_ID,))
    return matrix.model_matrix(rows, (ROW_ID, LABEL))


def M_(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.marginal_coefficients(X_(spark, folder))


def fixed_models(spark: SparkSession) -> list[sc.LinearModel]:
    return sc.models_from_table(fixtures.coefficients(spark))


# Scans, sources, sinks -----------------------------------------------------------------------


@query("load_transactions")
def _(spark, folder):
    return tx.load_transactions(T_(spark, folder))


@query("sample_customers")
def _(spark, folder):
    return tx.sample_customers(T_(spark, folder), 100)


@query("sample_rows")
def _(spark, folder):
    return tx.sample_rows(T_(spark, folder), 1000).select(ROW_ID, "customer_id", "amount", LABEL)


@query("sample_customers_random")
def _(spark, folder):
    return tx.sample_customers(T_(spark, folder), 1000, seed=7)


@query("schema_profile")
def _(spark, folder):
    return tx.schema_profile(T_(spark, folder))


@query("row_count")
def _(spark, folder):
    return tx.row_count(T_(spark, folder))


@query("load_summary")
def _(spark, folder):
    return tx.load_summary(T_(spark, folder))


@query("feature_table_sink")
def _(spark, folder):
    features = clean.clean_and_select(T_(spark, folder), keep=(ROW_ID,))
    return sinks.write_features(features, new_folder(spark, "features"), ["week_of_month"])


@query("shadow_log_sink")
def _(spark, folder):
    rows = T_(spark, folder).withColumns({
        "timestamp": F.col("transaction_timestamp"), "business_decision": uw.rule_decision(),
        "business_risk_score": F.col("risk_score")})
    keep = (ROW_ID, "timestamp", "business_decision", "business_risk_score")
    scored = sc.shadow_score(fitted(spark, folder).transform(rows, keep), fixed_models(spark), "ridge")
    return sinks.append_shadow_log(scored, new_folder(spark, "shadow-log"))


@query("shadow_log_outcomes")
def _(spark, folder):
    """The log written twice, with the outcomes known by a date, then all that are known, once repeated."""
    source = T_(spark, folder)
    rows = source.withColumns({
        "timestamp": F.col("transaction_timestamp"), "business_decision": uw.rule_decision(),
        "business_risk_score": F.col("risk_score")})
    keep = (ROW_ID, "timestamp", "business_decision", "business_risk_score")
    scored = materialize(sc.shadow_score(fitted(spark, folder).transform(rows, keep), fixed_models(spark), "ridge"), "scored")
    log = sinks.ShadowLog(spark, new_folder(spark, "shadow-log"), "year")
    log.append(scored)
    log.append(scored)
    outcomes = materialize(_outcomes(source).join(source.select(ROW_ID, "amount"), ROW_ID), "outcomes")
    early = outcomes.where(F.col("resolved_at") < F.lit(OUTCOMES_FIRST_KNOWN_BY).cast("timestamp"))
    known = outcomes.where(F.col("resolved_at") < F.lit(OUTCOMES_KNOWN_BY).cast("timestamp"))
    for arrived in (early, known, known):
        log.resolve(arrived)
    return log.read()


# Row-level features ----------------------------------------------------------------------------


@query("temporal_features")
def _(spark, folder):
    rows = temporal.temporal_features(T_(spark, folder))
    return rows.select(ROW_ID, *[c for c in rows.columns if c in TEMPORAL_COLUMNS])


TEMPORAL_COLUMNS = [
    "transaction_hour", "transaction_day_of_week", "transaction_month", "transaction_day_of_month",
    "week_of_month", "is_weekend", "is_month_end", "is_holiday_season", "is_business_hours",
    "is_late_night", "time_of_day",
]


@query("time_of_day")
def _(spark, folder):
    rows = temporal.temporal_features(T_(spark, folder))
    return rows.groupBy("time_of_day").agg(
        F.min("transaction_hour").alias("first_hour"), F.max("transaction_hour").alias("last_hour"),
        F.count(F.lit(1)).alias("count"))


@query("temporal_flag_rates")
def _(spark, folder):
    return temporal.temporal_flag_rates(temporal.temporal_features(T_(spark, folder)))


@query("ordinal_encode")
def _(spark, folder):
    rows = encode.ordinal_encode(T_(spark, folder))
    return rows.select(ROW_ID, *[f"{c}_encoded" for c in ORDINAL_LEVELS])


@query("onehot_fit")
def _(spark, folder):
    return encode.onehot_levels_table(temporal.temporal_features(T_(spark, folder)))


@query("onehot_encode")
def _(spark, folder):
    rows = temporal.temporal_features(T_(spark, folder))
    levels = encode.onehot_fit(rows)
    return levels.transform(rows).select(ROW_ID, *levels.columns())


@query("bool_to_int")
def _(spark, folder):
    return encode.bool_to_int(T_(spark, folder)).select(ROW_ID, LABEL, "device_is_trusted")


@query("cardinality_report")
def _(spark, folder):
    return clean.cardinality_report(T_(spark, folder))


@query("single_value_columns")
def _(spark, folder):
    return clean.single_value_table(T_(spark, folder))


@query("high_cardinality_columns")
def _(spark, folder):
    return clean.high_cardinality_table(T_(spark, folder))


@query("drop_columns")
def _(spark, folder):
    return clean.drop_columns(T_(spark, folder), extra=["time_on_site_seconds"], keep=[ROW_ID])


@query("missing_report")
def _(spark, folder):
    return clean.missing_report(T_(spark, folder))


@query("impute")
def _(spark, folder):
    rows = T_(spark, folder).select(
        ROW_ID, "days_to_first_missed_payment", "price_comparison_time", "amount")
    return clean.impute_fit(rows).transform(rows)


@query("string_to_numeric")
def _(spark, folder):
    return clean.string_to_numeric(T_(spark, folder)).select(
        ROW_ID, "time_on_site_seconds", "price_comparison_time")


@query("clean_and_select")
def _(spark, folder):
    return clean.clean_and_select(T_(spark, folder), keep=(ROW_ID,))


@query("feature_metadata")
def _(spark, folder):
    rows = T_(spark, folder)
    pipeline = clean.fit_pipeline(rows)
    return clean.feature_metadata(pipeline, pipeline.transform(rows), rows)


@query("engineer_features_row")
def engineer_features_row(spark, folder):
    features, _ = clean.engineer_features(T_(spark, folder))
    return features


@query("model_matrix")
def _(spark, folder):
    rows = clean.clean_and_select(T_(spark, folder), keep=(ROW_ID,))
    return matrix.model_matrix(rows, (ROW_ID,))


@query("standard_scale")
def _(spark, folder):
    parts = split.stratified_split(X_(spark, folder))
    scaler = matrix.standard_scale_fit(parts.where("NOT is_test"))
    return scaler.transform(parts).select(ROW_ID, "is_test", "is_weekend", *SCALED_FEATURES)


@query("single_txn_transform")
def _(spark, folder):
    rows = fitted(spark, folder).transform(T_(spark, folder), (ROW_ID,))
    return rows.select(ROW_ID, *FEATURES)


@query("context_ratio_features")
def _(spark, folder):
    return derived.context_ratio_features(T_(spark, folder)).select(
        ROW_ID, "amount_to_income_ratio", "amount_to_credit_ratio", "risk_score_normalized")


@query("interaction_features")
def _(spark, folder):
    rows = T_(spark, folder)
    limit = exact_quantiles(rows, "amount", {"p75": 0.75}).first()["p75"]
    return derived.interaction_features(rows, limit).select(
        ROW_ID, "young_customer_high_amount", "unverified_high_risk_product",
        "mobile_impulse_purchase", "risk_score_x_amount")


@query("polynomial_features", amount_squared=0, amount_x_risk_score=4, amount_x_payment_credit_limit=0)
def _(spark, folder):
    columns = ["amount", "risk_score", "payment_credit_limit"]
    rows = derived.polynomial_features(T_(spark, folder), columns)
    return rows.select(ROW_ID, *[c for c in rows.columns if "_x_" in c or c.endswith("_squared")])


@query("target_encode")
def _(spark, folder):
    parts = split.stratified_split(T_(spark, folder))
    means = encode.target_encode_fit(parts.where("NOT is_test"), "customer_state", LABEL)
    return means.transform(parts.where("is_test")).select(
        ROW_ID, "customer_state", "customer_state_target_mean")


# Joins ------------------------------------------------------------------------------------------


@query("join_inner_sample")
def _(spark, folder):
    rows = tx.load_transactions(T_(spark, folder), sample_size=100, ordered=False)
    return rows.select("customer_id", ROW_ID, "amount", "transaction_timestamp")


@query("join_semi_active")
def _(spark, folder):
    rows = uw.active_customers(T_(spark, folder), 12)
    return rows.select("customer_id", ROW_ID, "risk_score")


@query("join_cross_scalar")
def _(spark, folder):
    rows = T_(spark, folder)
    base = rows.agg(F.count(F.lit(1)).alias("total_transactions"), F.avg("amount").alias("avg_amount"))
    return with_scalars(base, exact_quantiles(rows, "amount", {"p25": 0.25, "median": 0.5, "p75": 0.75}))


@query("join_feature_sets")
def _(spark, folder):
    rows = P_(spark, folder)
    joined = customer.join_feature_sets(
        customer.velocity_features(rows.where("payment_date < payment_due_date")),
        customer.risk_indicator_features(rows.where("transaction_amount > 20000")))
    return joined.select(
        "customer_id", "velocity_transaction_id_count", "velocity_days_to_payment_mean",
        "risk_transaction_amount_count", "risk_transaction_amount_mean")


def _ridge_importance(spark, folder):
    return importance.coefficient_importance(M_(spark, folder)).where("model_name = 'ridge'").select(
        "feature", "abs_coefficient", "importance_rank")


@query("join_importances")
def _(spark, folder):
    strength = profile.target_correlations(X_(spark, folder).drop(ROW_ID), LABEL, FEATURES).select(
        "feature", F.abs("correlation").alias("abs_correlation"))
    return importance.join_importances(_ridge_importance(spark, folder), strength)


OUTCOME_DELAY_DAYS = 14
OUTCOMES_FIRST_KNOWN_BY, OUTCOMES_KNOWN_BY = "1996-01-01", "2000-01-01"


def _outcomes(rows: DataFrame) -> DataFrame:
    """Outcomes resolved at the first missed payment, or after two weeks, up to a date."""
    days = F.coalesce("days_to_first_missed_payment", F.lit(OUTCOME_DELAY_DAYS)).cast("int")
    resolved = F.timestamp_add("DAY", days, F.col("transaction_timestamp"))
    return rows.select(ROW_ID, F.col(LABEL).alias("actual_default"), resolved.alias("resolved_at"))


@query("join_outcome_backfill")
def _(spark, folder):
    rows = T_(spark, folder)
    predictions = rows.select(
        ROW_ID, F.col("transaction_timestamp").alias("timestamp"), uw.rule_decision().alias("business_decision"))
    outcomes = _outcomes(rows).where(F.col("resolved_at") < F.lit(OUTCOMES_KNOWN_BY).cast("timestamp"))
    return sc.outcome_backfill(predictions, outcomes).drop("resolved_at")


# Customer-level features ---------------------------------------------------------------------------


@query("payment_timing")
def _(spark, folder):
    rows = customer.payment_timing(P_(spark, folder))
    return rows.select("customer_id", ROW_ID, "days_to_payment", "days_early_late", "is_late_payment")


@query("velocity_features")
def _(spark, folder):
    return customer.velocity_features(P_(spark, folder))


SUMS = {"risk_transaction_amount_sum": 2, "profile_transaction_amount_sum": 2}


@query("risk_indicator_features", **SUMS)
def _(spark, folder):
    return customer.risk_indicator_features(P_(spark, folder))


@query("temporal_profile")
def _(spark, folder):
    return customer.temporal_profile(P_(spark, folder))


@query("temporal_profile_events")
def _(spark, folder):
    return customer.temporal_profile(fixtures.events(spark, folder), "user_id", "ts")


@query("customer_profile", **SUMS)
def _(spark, folder):
    return customer.customer_profile(P_(spark, folder))


@query("engineer_features_customer", **SUMS)
def engineer_features_customer(spark, folder):
    return customer.engineer_customer_features(P_(spark, folder))


@query("customer_history")
def _(spark, folder):
    return customer.customer_history(T_(spark, folder))


# Profiling and underwriting --------------------------------------------------------------------------


@query("business_metrics")
def _(spark, folder):
    return profile.business_metrics(T_(spark, folder))


@query("business_metrics_approx")
def _(spark, folder):
    rows = T_(spark, folder)
    totals = profile.business_metrics(rows, exact=False)
    return with_scalars(totals.drop(*QUARTILE_COLUMNS), _rank_checks(rows.select("amount"), totals))


QUARTILE_COLUMNS = {f"{q}_transaction_amount": p for q, p in profile.QUARTILES.items()}


def _rank_checks(rows: DataFrame, totals: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Whether the share of rows below each estimate and up to it enclose the wanted share."""
    placed = with_scalars(rows, totals.select(*QUARTILE_COLUMNS))
    return placed.agg(*[
        ((F.avg((F.col("amount") < F.col(c)).cast("int")) <= p + tolerance)
         & (F.avg((F.col("amount") <= F.col(c)).cast("int")) >= p - tolerance)).alias(f"{c}_within")
        for c, p in QUARTILE_COLUMNS.items()])


@query("describe_numeric")
def _(spark, folder):
    return profile.describe_numeric(T_(spark, folder))


@query("categorical_candidates")
def _(spark, folder):
    return profile.categorical_candidates(T_(spark, folder))


@query("value_counts")
def _(spark, folder):
    rows = T_(spark, folder)
    columns = ["customer_age_bracket", "customer_income_bracket", "product_category", LABEL]
    return train.union_all([profile.value_counts(rows, c) for c in columns])


@query("uniformity_cv")
def _(spark, folder):
    return profile.uniformity_cv(T_(spark, folder), ["customer_income_bracket", "product_category"])


@query("default_rate_by")
def _(spark, folder):
    return uw.default_rate_by(T_(spark, folder), "customer_credit_score_range")


@query("risk_level_performance")
def _(spark, folder):
    return uw.risk_level_performance(T_(spark, folder))


@query("risk_scenario_performance")
def _(spark, folder):
    return uw.risk_scenario_performance(T_(spark, folder))


@query("credit_risk")
def _(spark, folder):
    return uw.credit_risk(T_(spark, folder))


@query("risk_variation")
def _(spark, folder):
    return uw.risk_variation(T_(spark, folder))


@query("customer_risk_spread")
def _(spark, folder):
    rows = uw.customer_risk_spread(T_(spark, folder))
    return rows.withColumns({
        c: F.concat_ws("|", c) for c in ("risk_levels", "risk_scenarios")})


@query("repeat_customers")
def _(spark, folder):
    return uw.repeat_customers(T_(spark, folder))


@query("calibration_bins")
def _(spark, folder):
    return uw.calibration_bins(T_(spark, folder))


@query("underwriting_effectiveness")
def _(spark, folder):
    return uw.underwriting_effectiveness(T_(spark, folder))


@query("underwriting_baseline")
def _(spark, folder):
    return uw.underwriting_baseline(encode.ordinal_encode(T_(spark, folder)))


@query("histogram")
def _(spark, folder):
    rows = T_(spark, folder)
    return train.union_all([
        uw.histogram(rows, c, bins).withColumn("feature", F.lit(c))
        for c, bins in (("amount", 50), ("risk_score", 30))])


@query("box_stats_by")
def _(spark, folder):
    return uw.box_stats_by(T_(spark, folder), "customer_age_bracket", "amount")


@query("pair_correlation")
def _(spark, folder):
    return profile.pair_correlation(
        T_(spark, folder), [("amount", "product_price"), ("amount", "risk_score")])


@query("target_correlations")
def _(spark, folder):
    return profile.target_correlations(X_(spark, folder).drop(ROW_ID), LABEL, FEATURES)


@query("correlation_matrix")
def _(spark, folder):
    return profile.correlation_matrix(X_(spark, folder), FEATURES)


def _customer_features(spark, folder):
    return materialize(customer.engineer_customer_features(P_(spark, folder)), "customers")


@query("high_correlation_pairs")
def _(spark, folder):
    return profile.high_correlation_pairs(_customer_features(spark, folder).drop("customer_id"))


@query("constant_features")
def _(spark, folder):
    return profile.constant_features(P_(spark, folder))


@query("skew_outliers")
def _(spark, folder):
    rows = P_(spark, folder).select(
        "transaction_amount", "annual_income",
        F.when(F.col("dispute_count") + F.col("chargeback_count") == 2, F.col("transaction_amount"))
        .otherwise(0.0).alias("disputed_chargeback_amount"))
    return profile.skew_outliers(rows)


@query("validate_features")
def _(spark, folder):
    return profile.validate_features(_customer_features(spark, folder))


@query("linear_trend")
def _(spark, folder):
    rows = T_(spark, folder).withColumn("target", F.col(LABEL).cast("int"))
    return profile.linear_trend(rows, "risk_score", "target")


@query("drift_baseline")
def _(spark, folder):
    parts = split.stratified_split(X_(spark, folder))
    return profile.drift_baseline(parts.where("NOT is_test"), FEATURES, LABEL)


@query("drift_check")
def _(spark, folder):
    parts = split.stratified_split(X_(spark, folder))
    baseline = profile.drift_baseline(parts.where("NOT is_test"), FEATURES, LABEL)
    return profile.drift_check(parts.where("is_test"), baseline, FEATURES, limit=0.03)


@query("drift_distribution")
def _(spark, folder):
    parts = materialize(split.stratified_split(X_(spark, folder)), "matrix")
    edges, baseline = drift.distribution_baseline(parts.where("NOT is_test"), FEATURES, size=1 << 15)
    return drift.distribution_drift(parts.where("is_test"), edges, baseline)


@query("kpi_rates")
def _(spark, folder):
    return uw.kpi_rates(T_(spark, folder))


# Windows, sorting, sets ---------------------------------------------------------------------------


@query("customer_sequences")
def _(spark, folder):
    rows = uw.customer_sequences(T_(spark, folder))
    return rows.withColumns({c: F.concat_ws("|", F.transform(c, lambda x: x.cast("string")))
                             for c in ("risk_levels", "outcomes")})


@query("importance_rank")
def _(spark, folder):
    return importance.importance_rank(M_(spark, folder))


@query("cumulative_counts")
def _(spark, folder):
    return ev.cumulative_counts(curve(spark, folder))


@query("score_tertiles")
def _(spark, folder):
    rows = S_(spark, folder)
    segments = ev.score_tertiles(rows, ev.score_curve(rows))
    return segments.select("model_name", ROW_ID, "segment")


@query("sort_history")
def _(spark, folder):
    return tx.sort_history(T_(spark, folder)).select(
        "customer_id", "transaction_timestamp", ROW_ID, "amount")


@query("topk_abs_correlation")
def _(spark, folder):
    return profile.topk_abs_correlation(
        profile.target_correlations(X_(spark, folder).drop(ROW_ID), LABEL, FEATURES), 10)


@query("topk_customers")
def _(spark, folder):
    return uw.topk_customers(T_(spark, folder), 10)


@query("ordered_category_sort")
def _(spark, folder):
    counts = T_(spark, folder).groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
    return uw.ordered_category_sort(counts, "risk_level", RISK_LEVEL_ORDER).withColumn(
        "place", uw.category_rank("risk_level", RISK_LEVEL_ORDER))


@query("distinct_customers")
def _(spark, folder):
    return tx.distinct_customers(T_(spark, folder))


# Splits -----------------------------------------------------------------------------------------


@query("stratified_split")
def _(spark, folder):
    return split.stratified_split(T_(spark, folder)).select(ROW_ID, LABEL, "is_test")


@query("stratified_folds")
def _(spark, folder):
    return split.stratified_folds(T_(spark, folder)).select(ROW_ID, LABEL, "fold")


@query("stratified_subsample")
def _(spark, folder):
    return split.stratified_subsample(T_(spark, folder), 10_000).select(ROW_ID, LABEL)


# Models ------------------------------------------------------------------------------------------


def _train_test(spark, folder) -> tuple[DataFrame, DataFrame]:
    parts = materialize(split.stratified_split(X_(spark, folder)), "matrix")
    return parts.where("NOT is_test").drop("is_test"), parts.where("is_test").drop("is_test")


def _scaled_train(spark, folder) -> DataFrame:
    rows, _ = _train_test(spark, folder)
    return matrix.standard_scale_fit(rows).transform(rows)


def _auc_of(model: fit.Scorer, test: DataFrame, name: str) -> DataFrame:
    scored = model.score(test, "score").select(
        F.lit(name).alias("model_name"), F.col(LABEL).cast("int").alias("label"), "score")
    return ev.roc_auc(ev.score_curve(scored))


RIDGE = train.ModelSpec(
    "ridge", lambda df: fit.fit_ridge(df, FEATURES, LABEL, scaled=SCALED_FEATURES),
    fit_folds=lambda df, folds: fit.ridge_folds(df, FEATURES, LABEL, folds, scaled=SCALED_FEATURES))
LOGISTIC = train.ModelSpec("logistic", lambda df: fit.fit_logistic(
    df, FEATURES, LABEL, "l1", 0.1), scaled=True)
ELASTIC = train.ModelSpec("elastic", lambda df: fit.fit_logistic(
    df, FEATURES, LABEL, "elasticnet", 0.1, 0.9, name="elastic"), scaled=True)


def bayes(counted: dict | None = None, **parameters) -> train.ModelSpec:
    """``counted`` keeps the counts of one table's folds for several points of a search."""
    return train.ModelSpec(
        "bernoulli_nb", lambda df: fit.fit_bernoulli_nb(df, FEATURES, LABEL, **parameters),
        fit_folds=lambda df, folds: fit.bernoulli_folds(df, FEATURES, LABEL, folds, **parameters, counted=counted))


BAYES = bayes()
FOREST = train.ModelSpec("random_forest", lambda df: fit.fit_random_forest(df, FEATURES, LABEL))


@query("fit_ridge")
def _(spark, folder):
    model = fit.fit_ridge(_scaled_train(spark, folder), FEATURES, LABEL)
    return sc.coefficients_table(spark, [model])


@query("fit_logistic")
def _(spark, folder):
    rows = _scaled_train(spark, folder)
    models = [
        fit.fit_logistic(rows, FEATURES, LABEL, "l1", 0.1, name="l1"),
        fit.fit_logistic(rows, FEATURES, LABEL, "l2", 0.1, name="l2"),
        fit.fit_logistic(rows, FEATURES, LABEL, "elasticnet", 0.1, 0.9, name="elastic"),
    ]
    return sc.coefficients_table(spark, models)


@query("fit_random_forest")
def _(spark, folder):
    rows, test = _train_test(spark, folder)
    return _auc_of(fit.fit_random_forest(rows, FEATURES, LABEL), test, "random_forest")


@query("fit_gbt")
def _(spark, folder):
    rows, test = _train_test(spark, folder)
    return _auc_of(fit.fit_gbt(rows, FEATURES, LABEL), test, "gbt")


@query("fit_bernoulli_nb")
def _(spark, folder):
    rows, _ = _train_test(spark, folder)
    return fit.bernoulli_nb_table(rows, FEATURES, LABEL)


@query("fit_bagging")
def _(spark, folder):
    rows, test = _train_test(spark, folder)
    return _auc_of(fit.fit_bagging(rows, FEATURES, LABEL, ROW_ID), test, "bagging")


@query("knn_score")
def _(spark, folder):
    rows, test = _train_test(spark, folder)
    scaler = matrix.standard_scale_fit(rows)
    near = pivots.nearest_rows(scaler.transform(rows), scaler.transform(test), FEATURES, LABEL, ROW_ID, 10)
    return near.select(F.col("id").alias(ROW_ID), pivots.vote(F.slice("near", 1, 5)).alias("knn_uniform"),
                       pivots.vote(F.col("near"), True).alias("knn_distance"))


def _auc_table(models: dict[str, fit.Scorer], test: DataFrame) -> DataFrame:
    scored = train.union_all([model.score(test, "score").select(
        F.lit(name).alias("model_name"), F.col(LABEL).cast("int").alias("label"), "score") for name, model in models.items()])
    return ev.roc_auc(ev.score_curve(materialize(scored, "scored")))


@query("fit_boosting")
def _(spark, folder):
    """Four ways to grow, all in the same passes."""
    rows, test = _train_test(spark, folder)
    ways = {"leaf_wise": boosting.Boosting(ROUNDS), "depth_wise": boosting.Boosting(ROUNDS, 64, 0.3, 1.0, 1, 1.0, 6),
            "shallow": boosting.Boosting(ROUNDS, 8, depth=3, min_child=1), "subsampled": boosting.Boosting(ROUNDS, subsample=0.8)}
    models = boosting.fit_boosting(rows, FEATURES, LABEL, list(ways.values()), row_id=ROW_ID)
    return _auc_table({name: m for name, (m,) in zip(ways, models)}, test)


@query("boosted_trees")
def _(spark, folder):
    rows, _ = _train_test(spark, folder)
    return boosting.fit_boosting(rows, FEATURES, LABEL, [boosting.Boosting(5)])[0][0].table(spark)


@query("fit_adaboost")
def _(spark, folder):
    rows, _ = _train_test(spark, folder)
    return adaboost.fit_adaboost(rows, FEATURES, LABEL, [adaboost.AdaBoost(50)])[0][0].table(spark)


@query("fit_extra_trees")
def _(spark, folder):
    rows, test = _train_test(spark, folder)
    return _auc_of(extra_trees.fit_extra_trees(rows, FEATURES, LABEL, 100, 10)[0], test, "extra_trees")


@query("fit_sgd")
def _(spark, folder):
    points = {s: gradient.Descent(schedule=s, alpha=0.001, eta0=0.1, max_iter=5, average=True) for s in ("optimal", "constant", "invscaling")}
    found = gradient.fit_sgd(_scaled_train(spark, folder), FEATURES, LABEL, ROW_ID, list(points.values()), batches=8)
    return sc.coefficients_table(spark, [sc.LinearModel(name, m.intercept, m.weights) for name, (m,) in zip(points, found)])


@query("fit_kernel_svm")
def _(spark, folder):
    rows, test = _train_test(spark, folder)
    scaler = matrix.standard_scale_fit(rows)
    model = gradient.fit_kernel_svm(scaler.transform(rows), FEATURES, LABEL, ROW_ID, max_iter=5)
    return _auc_of(model, scaler.transform(test), "svm_rbf")


@query("fit_penalised")
def _(spark, folder):
    """Lasso, ridge and both at once, and by how much their conditions of a minimum are missed."""
    rows = _scaled_train(spark, folder)
    points = {"l1": newton.Penalty(0.1, 1.0), "l2": newton.Penalty(0.1, 0.0), "elastic": newton.Penalty(0.1, 0.9)}
    fits = newton.penalised(rows, FEATURES, LABEL, list(points.values()))
    cells = [(name, f, float(w), float(m.violation / m.rows)) for name, (m,) in zip(points, fits)
             for f, w in zip([*FEATURES, sc.INTERCEPT], m.weights)]
    return spark.createDataFrame(cells, "model_name string, feature string, coefficient double, missed double")


@query("score_linear")
def _(spark, folder):
    return sc.score_linear(X_(spark, folder), fixed_models(spark), [ROW_ID])


@query("decision_to_probability")
def _(spark, folder):
    scored = sc.score_linear(X_(spark, folder), fixed_models(spark), [ROW_ID])
    return sc.decision_to_probability(scored).select(ROW_ID, "model_name", "score")


def _folded(spark, folder, folds: int) -> tuple[DataFrame, DataFrame]:
    rows, test = _train_test(spark, folder)
    return materialize(split.stratified_folds(rows, folds, LABEL, ROW_ID), "folds"), test


def _portfolio() -> dict[str, train.Family]:
    return portfolio(FEATURES, LABEL, ROW_ID, ROUNDS, EPOCHS, TREES, DEPTH, BINS)


@query("cross_validate")
def _(spark, folder):
    rows, _ = _folded(spark, folder, 5)
    return train.cross_validate(rows, [RIDGE, BAYES], LABEL, 5)


@query("cross_validate_families")
def _(spark, folder):
    rows, test = _folded(spark, folder, 5)
    kinds = _portfolio()
    chosen = [kinds[k] for k in ("ridge", "logistic", "elastic_net", "bernoulli_nb", "adaboost", "leaf_boosting")]
    return train.compare_families(rows, test, chosen, LABEL, 5).drop("test_auc")


@query("train_compare")
def _(spark, folder):
    """All kinds as the operators have them, and one that cannot be fitted."""
    rows, test = _folded(spark, folder, 3)

    def refuse(df: DataFrame, points, folds) -> list:
        raise ValueError("no such engine")

    return train.compare_families(rows, test, [*portfolio(FEATURES, LABEL, ROW_ID).values(), train.Family("unknown", {}, refuse, {})], LABEL, 3)


@query("select_candidates")
def _(spark, folder):
    return ev.select_candidates(ev.roc_auc(curve(spark, folder)), at_least=0.615)


@query("random_search")
def _(spark, folder):
    rows, test = _folded(spark, folder, 3)
    grid = {"alpha": [0.01, 0.1, 0.5, 1.0, 2.0], "fit_prior": [True, False], "binarize": [0.0, 0.1, 0.5]}
    counted: dict = {}
    return train.random_search(
        rows, test, "bernoulli_nb", lambda point: bayes(counted, **point), grid, LABEL, BAYES, size=25)


@query("search_families")
def _(spark, folder):
    """25 points of each kind whose points share their passes, on all rows of the folds."""
    rows, test = _folded(spark, folder, 3)
    kinds = _portfolio()
    chosen = [kinds[k] for k in ("ridge", "bernoulli_nb", "logistic", "elastic_net")]
    return train.search_families(rows, test, chosen, LABEL, ROW_ID)


@query("successive_search")
def _(spark, folder):
    """25 points of the whole grids of boosted models and gradient steps: rungs of a quarter and all of the rows."""
    rows, _ = _folded(spark, folder, 3)
    kinds = portfolio(FEATURES, LABEL, ROW_ID)
    parts = [train.successive_search(rows, kinds[k], LABEL, ROW_ID, shares=(0.25, 1.0)).withColumn("model_name", F.lit(k))
             for k in ("leaf_boosting", "hist_boosting", "gradient_boosting", "adaboost", "sgd")]
    return train.union_all(parts)


@query("search_ridge")
def _(spark, folder):
    rows, _ = _folded(spark, folder, 3)
    return train.search_ridge(rows, FEATURES, LABEL, [0.01, 0.1, 1.0, 10.0, 100.0, 1000.0],
                              scaled=SCALED_FEATURES)


def _wide(spark, folder) -> DataFrame:
    return sc.wide_scores(S_(spark, folder), MODELS, [ROW_ID, "label"])


@query("vote_soft")
def _(spark, folder):
    return sc.vote_soft(_wide(spark, folder), MODELS).select(ROW_ID, "label", "soft_vote")


@query("vote_hard")
def _(spark, folder):
    return sc.vote_hard(_wide(spark, folder), MODELS).select(
        ROW_ID, "label", "votes", "hard_vote", "hard_vote_score")


@query("vote_weighted")
def _(spark, folder):
    weights = sc.vote_weights(ev.roc_auc(curve(spark, folder)))
    return sc.vote_weighted(_wide(spark, folder), weights).select(ROW_ID, "label", "weighted_vote")


@query("stacking")
def _(spark, folder):
    rows, test = _folded(spark, folder, 3)
    kinds = _portfolio()
    bases = [kinds[k] for k in ("leaf_boosting", "xgboost", "sgd", "adaboost")]
    return _auc_of(train.stack_families(rows, bases, LABEL, ROW_ID, 3), test, "stacking")


@query("ensemble_compare")
def _(spark, folder):
    wide = _wide(spark, folder)
    voted = sc.vote_soft(wide, MODELS, "soft_vote").withColumn(
        "pair_vote", sc.row_mean(["ridge", "logistic"]))
    names = [*MODELS, "soft_vote", "pair_vote"]
    long = voted.select("label", F.explode(F.array(*[
        F.struct(F.lit(m).alias("model_name"), F.round(F.col(m), 9).alias("score")) for m in names
    ])).alias("cell")).select("label", "cell.model_name", "cell.score")
    return ev.ensemble_compare(ev.roc_auc(ev.score_curve(long)), MODELS)


# Evaluation --------------------------------------------------------------------------------------


EVALUATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "roc_auc": ev.roc_auc,
    "pr_curve": ev.pr_curve,
    "average_precision": ev.average_precision,
    "recall_at_precision": lambda c: ev.recall_at_precision(c, targets=(0.07, 0.10, 0.90)),
    "precision_at_recall": ev.precision_at_recall,
    "threshold_table": ev.threshold_table,
    "threshold_sweep": ev.threshold_sweep,
    "segment_tertiles": ev.segment_tertiles,
    "top_decile": ev.top_decile,
    "percentile_thresholds": ev.percentile_thresholds,
    "business_assessment": lambda c: ev.business_assessment(ev.top_decile(c)),
    "evaluate_business": ev.evaluate_business,
    "evaluate_comprehensive": ev.evaluate_comprehensive,
    "score_diagnostics": ev.score_diagnostics,
    "model_comparison": lambda c: ev.model_comparison(ev.evaluate_comprehensive(c)),
    "business_ranking": lambda c: ev.business_ranking(ev.evaluate_comprehensive(c)),
    "discrimination_report": ev.discrimination_report,
}


def _register_evaluation(name: str, measure: Callable[[DataFrame], DataFrame]) -> None:
    @query(name)
    def _(spark, folder):
        return measure(curve(spark, folder))


for _name, _measure in EVALUATIONS.items():
    _register_evaluation(_name, _measure)


@query("cost_structure")
def _(spark, folder):
    return ev.cost_structure(T_(spark, folder)).select(
        ROW_ID, "missed_default_cost", "rejected_good_cost", "cost_ratio")


@query("coefficient_importance")
def _(spark, folder):
    return importance.coefficient_importance(M_(spark, folder))


@query("feature_category")
def _(spark, folder):
    return M_(spark, folder).withColumn("category", importance.feature_category())


@query("category_importance")
def _(spark, folder):
    return importance.category_importance(M_(spark, folder))


@query("permutation_importance")
def _(spark, folder):
    model = next(m for m in fixed_models(spark) if m.name == "ridge")
    held_out = split.stratified_split(X_(spark, folder)).where("is_test")
    return importance.permutation_importance(held_out, model, ROW_ID, LABEL)


@query("permutation_importance_fitted")
def _(spark, folder):
    """The ridge of the training rows on the rows held out."""
    rows, test = _train_test(spark, folder)
    scaler = matrix.standard_scale_fit(rows)
    model = fit.fit_ridge(scaler.transform(rows), FEATURES, LABEL)
    return importance.permutation_importance(scaler.transform(test), model, ROW_ID, LABEL)


def _shadow(spark, folder) -> DataFrame:
    """Model scores next to what the rules and the costs need."""
    rows = fitted(spark, folder).transform(T_(spark, folder), (ROW_ID, "risk_level"))
    scored = sc.shadow_score(rows, fixed_models(spark), "ridge")
    return scored.withColumn(LABEL, F.col(LABEL) == 1)


@query("shadow_score")
def _(spark, folder):
    return _shadow(spark, folder).select(
        ROW_ID, *[f"{m}_prediction" for m in MODELS], "ensemble_prediction", "champion",
        "champion_score", "consensus_prediction")


@query("shadow_compare", opportunity_cost=2)
def _(spark, folder):
    return sc.shadow_compare(sc.shadow_decisions(_shadow(spark, folder), cut=0.15))


@query("model_registry_table")
def _(spark, folder):
    table = registry.register(M_(spark, folder), "bnpl", "v0.1.0", "ridge")
    return registry.pick_models(table, domain="bnpl", role="challenger")


@query("model_registry_list")
def _(spark, folder):
    return registry.list_models(registry.register(M_(spark, folder), "bnpl", "v0.1.0", "ridge"), "bnpl")


# Streaming -----------------------------------------------------------------------------------------


def _run(spark, frame: DataFrame, schema=None) -> DataFrame:
    """Works off the stream into a folder of its own and reads the result."""
    target = new_folder(spark, "stream")
    running = jobs.write_stream(frame, target, new_folder(spark, "stream-state"))
    running.awaitTermination()
    return spark.read.schema(frame.schema).parquet(target)


def _as_stream(spark, df: DataFrame) -> DataFrame:
    target = new_folder(spark, "arrivals")
    df.write.parquet(target)
    return jobs.read_stream(spark, target, df.schema)


@query("stream_features")
def _(spark, folder):
    rows = _as_stream(spark, T_(spark, folder))
    features = jobs.stream_features(rows, fitted(spark, folder), (ROW_ID,))
    return _run(spark, features).select(ROW_ID, *FEATURES)


@query("stream_customer_features")
def _(spark, folder):
    """Payments in several batches; customers stay open, so that all their payments count."""
    payments = P_(spark, folder).select("customer_id", ROW_ID, "transaction_date", "payment_date", "payment_due_date")
    target = new_folder(spark, "arrivals")
    payments.write.parquet(target)
    rows = jobs.read_stream(spark, target, payments.schema, 4)
    states, forever = new_folder(spark, "customers"), "99999 days"
    customers.write_states(customers.customer_states(rows, forever, forever), states, new_folder(spark, "stream-state")).awaitTermination()
    return customers.features_of(customers.latest_states(spark, states))


@query("stream_shadow_score")
def _(spark, folder):
    rows = _as_stream(spark, T_(spark, folder))
    return _run(spark, jobs.stream_shadow_score(rows, fitted(spark, folder), fixed_models(spark), "ridge"))


@query("stream_kpi_window")
def _(spark, folder):
    return _run(spark, jobs.stream_kpi_window(_as_stream(spark, fixtures.events(spark, folder))))


@query("stream_outcome_join")
def _(spark, folder):
    rows = T_(spark, folder)
    predictions = rows.select(ROW_ID, F.col("transaction_timestamp").alias("timestamp"),
                              uw.rule_decision().alias("business_decision"))
    return _run(spark, jobs.stream_outcome_join(
        _as_stream(spark, predictions), _as_stream(spark, _outcomes(rows))))
