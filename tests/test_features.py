"""Edge cases of the row-level and customer-level features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lendlens.functions import binning, numeric
from lendlens.operators import clean, customer, derived, encode, matrix, profile, temporal
from lendlens.sources import fixtures

FOLDER = "/root/testdata/sf0.001"


def stamp(text):
    return dt.datetime.fromisoformat(text)


def one(spark, expression):
    return spark.range(1).select(expression.alias("v")).first()["v"]


@pytest.mark.parametrize("hour,name", [
    (0, "night"), (5, "night"), (6, "night"), (7, "morning"), (12, "morning"), (13, "afternoon"),
    (18, "afternoon"), (19, "evening"), (23, "evening")])
def test_time_of_day_edges(spark, hour, name):
    df = spark.createDataFrame([(stamp(f"2024-01-01T{hour:02d}:30:00"),)], "transaction_timestamp timestamp")
    assert temporal.temporal_features(df).first()["time_of_day"] == name


@pytest.mark.parametrize("day,week,row_end,customer_end", [
    (1, 1, 0, 0), (7, 1, 0, 0), (8, 2, 0, 0), (24, 4, 0, 0), (25, 4, 1, 0), (26, 4, 1, 1), (29, 5, 1, 1)])
def test_month_parts(spark, day, week, row_end, customer_end):
    df = spark.createDataFrame([(stamp(f"2024-01-{day:02d}T10:00:00"),)], "transaction_timestamp timestamp")
    row = temporal.temporal_features(df).first()
    assert (row["week_of_month"], row["is_month_end"]) == (week, row_end)
    assert temporal.temporal_features(df, month_end_from=26).first()["is_month_end"] == customer_end


@pytest.mark.parametrize("text,value", [
    ("1.5d", None), ("1f", None), ("", None), (" 2 ", 2.0), ("1e3", 1000.0), ("-.5", -0.5), ("inf", None),
    ("n/a", None), (None, None), ("7.", 7.0)])
def test_parse_number(spark, text, value):
    assert one(spark, numeric.parse_number(F.lit(text))) == value


@pytest.mark.parametrize("num,den,upper,value", [
    (1.0, 0.0, 1.0, 1.0), (-1.0, 0.0, 1.0, 0.0), (0.0, 0.0, 1.0, 0.0), (5.0, 1.0, 2.0, 2.0),
    (1.0, -2.0, 1.0, 0.0), (1.0, 4.0, 1.0, 0.25), (None, 4.0, 1.0, 0.0), (1.0, None, 1.0, 0.0)])
def test_bounded_ratio(spark, num, den, upper, value):
    cell = numeric.bounded_ratio(F.lit(num).cast("double"), F.lit(den).cast("double"), upper)
    assert one(spark, cell) == value


def test_rounding_and_days(spark):
    assert one(spark, numeric.half_even(F.lit(0.0025), 3)) == 0.002
    early = numeric.whole_days(F.lit(stamp("2024-01-02T01:00:00")), F.lit(stamp("2024-01-02T00:00:00")))
    assert one(spark, early) == -1


def test_correlation_of_constant_and_skew_of_few(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    row = df.agg(numeric.safe_corr(F.col("a"), F.col("b")).alias("c"),
                 numeric.adjusted_skewness(F.col("b")).alias("s")).first()
    assert row["c"] is None and row["s"] is None
    flat = spark.createDataFrame([(2.0,)] * 4, "a double")
    assert flat.agg(numeric.adjusted_skewness(F.col("a")).alias("s")).first()["s"] == 0.0


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(i / 100,) for i in range(101)], "x double").select(
        "x", binning.equal_width_bin(F.col("x"), F.lit(0.0), F.lit(1.0), 10, True).alias("right"),
        binning.equal_width_bin(F.col("x"), F.lit(0.0), F.lit(1.0), 10, False).alias("left"))
    step = 0.1
    for r in df.collect():
        assert r["right"] == sum(i * step < r["x"] for i in range(1, 10))
        assert r["left"] == sum(i * step <= r["x"] for i in range(1, 10))
    assert df.where("x = 0.5").first()["right"] == 4


def test_unknown_levels(spark):
    df = spark.createDataFrame([("low",), ("very_high",), (None,)], "risk_level string")
    assert [r["risk_level_encoded"] for r in encode.ordinal_encode(df).collect()] == [0.0, -1.0, -1.0]
    levels = encode.onehot_fit(spark.createDataFrame([("b",), ("a",), (None,)], "device_type string"))
    assert levels.columns() == ["device_type_b", "device_type_None"]
    rows = levels.transform(spark.createDataFrame([("z",), ("b",), (None,)], "device_type string")).collect()
    assert [(r["device_type_b"], r["device_type_None"]) for r in rows] == [(0, 0), (1, 0), (0, 1)]


def test_null_target_fails(spark):
    df = spark.createDataFrame([(True,), (None,)], "will_default boolean")
    with pytest.raises(Exception, match="will_default is null"):
        encode.bool_to_int(df).collect()


def test_impute_mode_tie_and_empty(spark):
    df = spark.createDataFrame(
        [("b", None, 1), ("a", None, None), (None, None, 4), ("a", None, 3), ("b", None, None)],
        "s string, e string, n int")
    fills = clean.impute_fit(df)
    assert fills.values == {"s": "a", "e": "unknown", "n": 3.0}
    assert fills.transform(df).where("s is null or e is null or n is null").count() == 0


def test_high_cardinality_near_the_cut(spark):
    df = spark.range(210).select((F.col("id") % 20).cast("string").alias("twenty"),
                                 (F.col("id") % 21).cast("string").alias("more"))
    assert [r["column"] for r in clean.high_cardinality_table(df).collect()] == ["more"]


def test_single_row_equals_batch(spark):
    rows = fixtures.transactions(spark, FOLDER)
    pipeline = clean.fit_pipeline(rows, keep=("transaction_id",))
    batch = pipeline.transform(rows, ("transaction_id",))
    single = pipeline.transform(rows.where("transaction_id = 5"), ("transaction_id",))
    assert single.columns == batch.columns
    assert single.collect() == batch.where("transaction_id = 5").collect()
    dummies = [c for c in batch.columns if c.startswith("device_type_")]
    assert batch.where(sum(F.col(c) for c in dummies) > 1).count() == 0


def test_matrix_never_holds_targets(spark):
    rows = clean.clean_and_select(fixtures.transactions(spark, FOLDER))
    names = matrix.model_matrix(rows).columns
    assert not {"will_default", "days_to_first_missed_payment"} & set(names)
    assert names[:5] == ["amount", "risk_score", "payment_credit_limit", "price_comparison_time",
                         "customer_tenure_days"]


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "amount double, risk_score double")
    rows = matrix.standard_scale_fit(df).transform(df).collect()
    assert [tuple(r) for r in rows] == [(-1.0, 0.0), (1.0, 0.0)]


PAYMENT = ("customer_id long, transaction_id long, transaction_date timestamp, transaction_amount double, "
           "payment_date timestamp, payment_due_date timestamp, annual_income double")


def payments(spark, *rows):
    return spark.createDataFrame([
        (c, i, stamp(d), a, stamp(p) if p else None, stamp(u), inc) for c, i, d, a, p, u, inc in rows], PAYMENT)


def test_customer_edges(spark):
    df = payments(
        spark,
        (1, 1, "2024-01-01T10:00", 100.0, "2024-01-01T09:00", "2024-01-31T00:00", 0.0),
        (2, 2, "2024-01-06T23:00", 0.0, None, "2024-01-31T00:00", 1200.0),
        (2, 3, "2024-01-07T01:00", 0.0, "2024-02-02T00:00", "2024-01-31T00:00", None),
        (None, 4, "2024-01-08T01:00", 5.0, None, "2024-01-31T00:00", 1.0))
    rows = {r["customer_id"]: r for r in customer.engineer_customer_features(df).collect()}
    assert set(rows) == {1, 2}
    assert rows[1]["velocity_days_to_payment_mean"] == -1.0
    assert rows[1]["velocity_days_to_payment_std"] is None
    assert rows[1]["velocity_payment_consistency"] == 1.0
    assert rows[1]["risk_debt_to_income_ratio"] == 1.0
    assert rows[1]["profile_spending_consistency"] == 0.0
    assert rows[1]["risk_spending_volatility"] == 0.0
    assert rows[2]["risk_annual_income_first"] == 1200.0
    assert rows[2]["velocity_late_payment_rate"] == 0.5
    assert rows[2]["risk_spending_volatility"] == 0.0
    assert rows[2]["temporal_day_of_week_mode"] == 5
    assert rows[2]["profile_customer_tenure_days"] == 0


def test_customer_toggles_and_names(spark):
    df = payments(spark, (1, 1, "2024-01-01T10:00", 100.0, None, "2024-01-31T00:00", 0.0))
    with pytest.raises(ValueError):
        customer.engineer_customer_features(
            df, customer_profile=False, velocity_features=False, risk_indicators=False, temporal_features=False)
    bare = customer.velocity_features(df.select("customer_id", "transaction_id"))
    assert bare.columns == ["customer_id", "velocity_transaction_id"]


def test_customer_features_shuffle_once(spark):
    wide = customer.engineer_customer_features(spark.read.parquet(FOLDER + "/events.parquet").select(
        F.col("user_id").alias("customer_id"), F.col("event_id").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("transaction_date"), F.col("value").alias("transaction_amount")))
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_context_ratio_of_unknown_bracket(spark):
    df = spark.createDataFrame([(10.0, "?", 0.0, 0.5)],
                               "amount double, customer_income_bracket string, payment_credit_limit double, risk_score double")
    row = derived.context_ratio_features(df).first()
    assert row["amount_to_income_ratio"] is None and row["amount_to_credit_ratio"] is None


def test_validation_of_one_column(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0)], "customer_id long, x double")
    checks = {r["check"] for r in profile.validate_features(df).collect()}
    assert checks == {"feature_count", "customer_count"}


def test_correlation_matrix_with_nulls_and_constants(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(0)
    frame = pd.DataFrame({"a": rng.normal(1e6, 1, 200), "b": rng.normal(size=200), "c": 7.0})
    frame["d"] = frame["a"] + frame["b"]
    frame.loc[::7, "b"] = None
    df = spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(),
                               "a double, b double, c double, d double")
    expected = frame.corr()
    for r in profile.correlation_matrix(df).collect():
        if "c" in (r["feature_a"], r["feature_b"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(expected.loc[r["feature_a"], r["feature_b"]], abs=1e-9)


def test_median_of_counts():
    assert clean.median_of_counts({"1": 2, "3": 1, "10.5": 1, None: 7}) == 2.0
    assert clean.median_of_counts({"2": 1}) == 2.0
    assert clean.median_of_counts({None: 3}) is None


def test_pipeline_fills_many_and_few_valued_numbers(spark, monkeypatch):
    rows = fixtures.transactions(spark, FOLDER).withColumn(
        "amount", F.when(F.col("transaction_id") % 5 != 0, F.col("amount")))
    counted = clean.fit_pipeline(rows).fills.values
    monkeypatch.setattr(clean, "FEW_VALUES", 0)
    ordered = clean.fit_pipeline(rows).fills.values
    assert counted == ordered and {"amount", "days_to_first_missed_payment"} <= set(counted)


def test_null_and_a_level_named_none_stay_apart(spark):
    df = spark.createDataFrame([("None",), ("a",), (None,)], "device_type string")
    levels = encode.onehot_fit(df)
    assert levels.columns() == ["device_type_a", "device_type_<null>"]
    found = [(r["device_type_a"], r["device_type_<null>"]) for r in levels.transform(df).collect()]
    assert found == [(0, 0), (1, 0), (0, 1)]


def test_not_a_number_is_missing(spark):
    df = spark.createDataFrame([(1.0, 1), (float("nan"), 2), (None, 3)], "x double, y int")
    assert [(r["column"], r["missing_count"]) for r in clean.missing_report(df).collect()] == [("x", 2)]


def test_histogram_lists_empty_bins(spark):
    from lendlens.operators.underwriting import histogram

    df = spark.createDataFrame([(0.0,), (0.1,), (5.0,), (None,)], "x double")
    assert sorted((r["bin"], r["count"]) for r in histogram(df, "x", 5).collect()) == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 1)]
