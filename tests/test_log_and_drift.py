"""The replay-safe log, customer features on a stream, and drift of distributions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators import customer, drift
from lendlens.session import new_folder
from lendlens.sources import fixtures, sinks
from lendlens.streaming import customers, jobs

FOLDER = "/root/testdata/sf0.001"


def scored(spark, rows):
    return spark.createDataFrame([(i, t, "approve" if i % 2 else "decline", 0.1 * i, 0.05 * i) for i, t in rows],
                                 "transaction_id long, timestamp timestamp, business_decision string, business_risk_score double, ridge_prediction double")


def day(n, hour=12):
    return dt.datetime(2024, 1, n, hour)



def test_log_is_safe_against_replays(spark, tmp_path):
    log = sinks.ShadowLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.resolve(spark.createDataFrame([], "transaction_id long, actual_default boolean, resolved_at timestamp, amount double")) == 0
    first, second = scored(spark, [(1, day(1)), (2, day(1)), (3, day(2)), (3, day(2, 13))]), scored(spark, [(3, day(2)), (4, day(3)), (5, None)])
    log.append(first)
    log.append(second)
    once = sorted((r["transaction_id"] for r in log.read().collect()))
    assert once == ["1", "2", "3", "4", "5"]
    for batch in (first, second, first):
        log.append(batch)
    assert log.read().count() == 5
    assert log.read().where("transaction_id = '3'").first()["timestamp"] == day(2)
    outcomes = spark.createDataFrame([(1, True, day(9), 100.0), (1, False, day(10), 100.0), (4, False, day(20), 50.0), (99, True, day(5), 1.0), (2, None, day(5), 1.0)],
                                     "transaction_id long, actual_default boolean, resolved_at timestamp, amount double")
    assert log.resolve(outcomes) == 2
    rows = {r["transaction_id"]: r for r in log.read().collect()}
    assert len(rows) == 5
    assert (rows["1"]["actual_default"], rows["1"]["days_to_resolution"]) == (True, 8)
    # Rules approved 1, which defaulted; the model (0.05 below the cut) would have approved it as well.
    assert rows["1"]["opportunity_cost"] == 0.0
    # Rules declined 4, which was good; the model at 0.2 would have declined it too.
    assert (rows["4"]["actual_default"], rows["4"]["days_to_resolution"], rows["4"]["opportunity_cost"]) == (False, 17, 0.0)
    assert rows["2"]["actual_default"] is None and rows["3"]["opportunity_cost"] is None
    before = sorted(map(str, log.read().collect()))
    assert log.resolve(outcomes) == 0  # a repeated outcome changes nothing
    assert log.resolve(outcomes.withColumn("actual_default", ~F.col("actual_default"))) == 0
    log.append(first)
    assert sorted(map(str, log.read().collect())) == before
    late = spark.createDataFrame([(2, False, day(11), 200.0), (5, True, day(11), 10.0)], outcomes.schema)
    assert log.resolve(late) == 2
    rows = {r["transaction_id"]: r for r in log.read().collect()}
    assert rows["2"]["opportunity_cost"] == pytest.approx(200 * 0.15)  # declined by the rules, approved by the model
    assert rows["1"]["days_to_resolution"] == 8 and len(rows) == 5


def test_log_as_the_sink_of_a_stream(spark, tmp_path):
    rows = scored(spark, [(i, day(1 + i % 4)) for i in range(40)])
    folder = str(tmp_path / "in")
    rows.repartition(4).write.parquet(folder)
    log = sinks.ShadowLog(spark, str(tmp_path / "log"))
    for state in ("a", "b"):  # a lost checkpoint replays everything
        stream = jobs.read_stream(spark, folder, rows.schema, 1)
        stream.writeStream.foreachBatch(lambda batch, number: log.append(batch)).option(
            "checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()
        assert sorted(int(r["transaction_id"]) for r in log.read().collect()) == list(range(40))


def batch_features(payments):
    return customer.velocity_features(payments).join(customer.temporal_profile(payments), "customer_id")


def same(found, wanted):
    left = found.select(wanted.columns).toPandas().sort_values("customer_id").reset_index(drop=True)
    right = wanted.toPandas().sort_values("customer_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(left, right, check_dtype=False, rtol=1e-9)


def test_streamed_customers_equal_batch_after_a_restart(spark, tmp_path):
    payments = fixtures.payments(spark, FOLDER).select(
        "customer_id", "transaction_id", "transaction_date", "payment_date", "payment_due_date")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, 7, day(1), None, None), (None, 8, day(1), day(2), day(3)), (999999, 9, day(1), day(1), None)], payments.schema)
    payments = payments.unionByName(odd).repartition(6, F.rand(1))  # out of order
    payments.write.parquet(str(tmp_path / "all"))
    payments = spark.read.parquet(str(tmp_path / "all"))
    paths = sorted(p for p in (tmp_path / "all").iterdir() if p.suffix == ".parquet")
    arrivals, target, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    arrivals.mkdir()
    for part in (paths[:3], paths[3:]):  # the job ends in the middle and starts again
        for p in part:
            (arrivals / p.name).write_bytes(p.read_bytes())
        stream = jobs.read_stream(spark, str(arrivals), payments.schema, 2)
        customers.write_states(customers.customer_states(stream, "99999 days", "99999 days"), target, state).awaitTermination()
    found = customers.features_of(customers.latest_states(spark, target))
    same(found, batch_features(payments))


def test_idle_customers_are_closed(spark, tmp_path):
    schema = "customer_id long, transaction_id long, transaction_date timestamp, payment_date timestamp, payment_due_date timestamp"
    parts = [[(1, 1, day(1), day(2), day(3)), (2, 2, day(1), day(2), day(3))], [(2, 3, day(25), day(26), day(20))], [(2, 4, day(26), day(27), day(28)), (1, 5, day(27), day(28), day(29))]]
    folder, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
        customers.write_states(customers.customer_states(stream, "10 days", "1 days"), target, state).awaitTermination()
    closed = spark.read.parquet(f"{target}/batch=*").where("closed").collect()
    assert [(r["customer_id"], r["transactions"]) for r in closed] == [(1, 1)]
    last = {r["customer_id"]: r for r in customers.latest_states(spark, target).collect()}
    assert not last[1]["closed"] and last[1]["transactions"] == 1  # came back and starts anew


def test_drift_sees_a_change_of_shape(spark):
    rng = np.random.default_rng(1)
    base = pd.DataFrame({"a": rng.normal(size=3000), "b": rng.normal(size=3000), "c": np.where(rng.random(3000) < 0.1, np.nan, 1.0), "d": rng.integers(0, 3, 3000).astype(float)})
    other = base.assign(a=base.a * 3, b=rng.permutation(base.b), c=np.where(rng.random(3000) < 0.5, np.nan, 1.0))
    edges, counts = drift.distribution_baseline(spark.createDataFrame(base), list("abcd"))
    found = {r["feature"]: r for r in drift.distribution_drift(spark.createDataFrame(other), edges, counts).collect()}
    assert found["a"]["drifted"] and abs(other.a.mean() - base.a.mean()) < 0.1  # equal mean, other spread
    assert not found["b"]["drifted"] and found["b"]["psi"] == 0 and found["d"]["psi"] == 0
    assert found["c"]["drifted"] and found["c"]["batch_missing"] == pytest.approx(other.c.isna().mean())
    for f in "ac":
        cut = np.array(edges[f])
        shares = []
        for frame in (base, other):
            x = frame[f].to_numpy()
            at = np.where(np.isnan(x), 0, np.searchsorted(cut, x) + 1)
            shares.append(np.bincount(at, minlength=len(cut) + 2))
        p, q = (np.maximum(s / s.sum(), drift.FLOOR) for s in shares)
        assert found[f]["psi"] == pytest.approx(((q - p) * np.log(q / p)).sum())
        a, b = (np.cumsum(s[1:]) / s[1:].sum() for s in shares)
        assert found[f]["ks"] == pytest.approx(np.abs(a - b).max())


def test_sketches_merge(spark):
    rows = spark.range(4000).selectExpr("CAST(pmod(id * 37, 4001) AS double) AS x")
    parts = drift.sketches(rows.where("x < 900"), ["x"]).unionByName(drift.sketches(rows.where("x >= 900"), ["x"]))
    assert drift.cut_bins(drift.merge_sketches(parts), 4) == drift.cut_bins(drift.sketches(rows, ["x"]), 4)
    assert drift.cut_bins(drift.sketches(rows.where("x < 0"), ["x"])) == {}


def test_customers_of_one_bucket_are_told_apart(spark, tmp_path):
    schema = "customer_id long, transaction_id long, transaction_date timestamp, payment_date timestamp, payment_due_date timestamp"
    parts = [[(1, 1, day(1), day(2), day(3)), (2, 2, day(1), day(2), day(3)), (3, 3, None, day(2), None)], [(2, 4, day(25), day(26), day(20))], [(1, 5, day(26), day(28), day(29))]]
    folder, target, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, spark.createDataFrame([], schema).schema)
        customers.write_states(customers.customer_states(stream, "10 days", "1 days", buckets=1), target, state).awaitTermination()
    rows = spark.read.parquet(f"{target}/batch=*").collect()
    assert [(r["customer_id"], r["transactions"]) for r in rows if r["closed"]] == [(1, 1)]
    last = {r["customer_id"]: r for r in customers.latest_states(spark, target).collect()}
    assert {c: (r["payments"], r["closed"], r["days_max_negated"]) for c, r in last.items()} == {
        1: (1, False, -2), 2: (2, False, -1), 3: (1, False, customers.NOTHING)}
    assert last[3]["at"] is None and last[2]["at"] == day(25)
