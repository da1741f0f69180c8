"""Splits, ordering helpers, evaluation, fitting and streams against direct computation."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators.ordered import cut_points
from lendlens.operators import evaluate as ev, fit, importance, score as sc, split, train
from lendlens.operators.ordered import exact_quantiles, near_quantiles
from lendlens.plans import catalog
from lendlens.sources import sinks
from lendlens.streaming import jobs

FOLDER = "/root/testdata/sf0.001"
FEATURES = ["x", "y"]


@pytest.fixture(scope="module")
def planted(spark):
    """Three columns of which x carries the signal."""
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"id": range(600), "x": rng.normal(size=600), "y": rng.normal(5, 2, 600)})
    frame["label"] = (rng.random(600) < 1 / (1 + np.exp(1 - 2 * frame["x"]))).astype(int)
    return frame, spark.createDataFrame(frame).cache()


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"label": (rng.random(500) < 0.2).astype(int)})
    frame["score"] = np.round(0.3 * frame["label"] + rng.random(500) * 0.7, 2)
    frame["model_name"] = "m"
    return frame, spark.createDataFrame(frame).cache()


def area(label, score):
    good, bad = score[label == 0], score[label == 1]
    wins = (bad[:, None] > good[None, :]).sum() + (bad[:, None] == good[None, :]).sum() / 2
    return wins / (len(good) * len(bad))


@pytest.mark.parametrize("rows_per_range, accuracy", [(3, 10_000), (40, 25), (10_000, 8)])
def test_quantiles_over_many_ranges(spark, rows_per_range, accuracy):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 400), "v": np.round(rng.lognormal(3, 2, 400), 1)})
    frame = pd.concat([frame, pd.DataFrame({"g": [7, 8, 8], "v": [5.0, 1.0, 2.0]})])
    df = spark.createDataFrame(frame)
    wanted = {"a": 0.1, "b": 0.5, "c": 0.99}
    found = exact_quantiles(df, "v", wanted, ["g"], rows_per_range, accuracy).collect()
    assert len(found) == 5
    for r in found:
        expected = np.quantile(frame[frame.g == r["g"]].v, [0.1, 0.5, 0.99])
        assert [r["a"], r["b"], r["c"]] == pytest.approx(list(expected))
    whole = exact_quantiles(df, "v", {"m": 0.5}, rows_per_range=rows_per_range, accuracy=accuracy).first()["m"]
    assert whole == pytest.approx(frame.v.median())


@pytest.mark.parametrize("size", [*range(1, 12), 5000])
def test_quantiles_at_the_edge_of_their_brackets(spark, size):
    df = spark.range(size).selectExpr("CAST(id AS double) AS v").unionByName(
        spark.createDataFrame([(None,), (float("nan"),)], "v double"))
    wanted = {f"p{p}": p / 100 for p in (0, 1, 25, 50, 75, 99, 100)}
    row = exact_quantiles(df, "v", wanted, accuracy=1000).first()
    assert [row[n] for n in wanted] == pytest.approx([p * (size - 1) for p in wanted.values()])


def test_quantiles_shuffle_only_what_is_near_them(spark):
    values = spark.range(100_000).selectExpr("CAST(pmod(xxhash64(id), 1000003) AS double) AS v")
    kept = near_quantiles(values, "v", {"m": 0.5, "p9": 0.9}, [], 10_000)
    assert kept.count() < 400
    assert kept.groupBy("name").agg({"n": "sum"}).collect()[0][1] == 100_000


@pytest.mark.parametrize("rows_per_range", [5, 10_000])
def test_evaluation_against_direct_counts(scored, rows_per_range):
    frame, df = scored
    label, score = frame.label.to_numpy(), frame.score.to_numpy()
    curve = ev.score_curve(df, rows_per_range=rows_per_range)
    assert ev.roc_auc(curve).first()["auc"] == pytest.approx(area(label, score))
    points = [(t, label[score >= t].mean(), label[score >= t].sum() / label.sum()) for t in sorted(set(score))]
    curve_rows = ev.pr_curve(curve).where("threshold is not null").orderBy("threshold").collect()
    found = [(r["threshold"], r["precision"], r["recall"]) for r in curve_rows]
    assert np.allclose(np.array(found), np.array(points))
    recalls = [0.0] + [r for _, _, r in reversed(points)]
    precisions = [p for _, p, _ in reversed(points)]
    ap = sum((recalls[i + 1] - recalls[i]) * precisions[i] for i in range(len(points)))
    assert ev.average_precision(curve).first()["average_precision"] == pytest.approx(ap)
    row = ev.recall_at_precision(curve, targets=(0.5, 0.999)).first()
    best = [(r, -t) for t, p, r in points if p >= 0.5]
    assert (row["recall_at_50_precision"], -row["threshold_for_50_precision"]) == pytest.approx(max(best))
    row = ev.precision_at_recall(curve, targets=(0.8,)).first()
    assert row["precision_at_80_recall"] == pytest.approx(max(p for _, p, r in points if r >= 0.8))
    sweep = ev.threshold_table(curve).orderBy("threshold").collect()
    assert len(sweep) == 50
    for r, t in zip(sweep, np.linspace(0.1, 0.9, 50)):
        flagged = score >= t
        assert (r["tp"], r["fp"]) == (label[flagged].sum(), (1 - label)[flagged].sum())
        assert r["tp"] + r["fp"] + r["fn"] + r["tn"] == len(label)
    top = score >= np.percentile(score, 90)
    decile = ev.top_decile(curve).first()
    assert decile["top10_precision"] == pytest.approx(label[top].mean())
    thirds = pd.qcut(frame.score, 3, labels=["Low", "Medium", "High"])
    for r in ev.segment_tertiles(curve).collect():
        assert r["count"] == (thirds == r["segment"]).sum()
        assert r["default_rate"] == pytest.approx(label[thirds == r["segment"]].mean())


def test_auc_of_reversed_scores_and_ties(spark, scored):
    _, df = scored
    auc = ev.roc_auc(ev.score_curve(df)).first()["auc"]
    other = ev.roc_auc(ev.score_curve(df.withColumn("score", 1 - F.col("score")))).first()["auc"]
    assert auc + other == pytest.approx(1.0)
    tied = df.withColumn("score", F.lit(0.5))
    assert ev.roc_auc(ev.score_curve(tied)).first()["auc"] == 0.5
    assert ev.evaluate_business(ev.score_curve(tied)).first()["discrimination_equal"] == 0.0
    same = df.withColumn("label", F.lit(1))
    assert ev.roc_auc(ev.score_curve(same)).first()["auc"] is None


def test_business_ranking_with_zero_maximum(spark):
    metrics = spark.createDataFrame(
        [("a", 0.0, 0.2, -5.0, 0.1), ("b", 0.0, 0.1, -1.0, 0.2)],
        "model_name string, recall_at_95_precision double, auc_pr double, max_business_value double, "
        "recall_at_90_precision double")
    rows = ev.business_ranking(metrics).collect()
    assert [(r["model_name"], r["status"]) for r in rows] == [("a", "champion"), ("b", "challenger")]
    assert rows[0]["ranking_score"] == pytest.approx(0.25 + 0.15 * 0.5)


@pytest.mark.parametrize("ordered_rows", [1, 200_000])
def test_cut_keys_at_every_depth(spark, ordered_rows):
    df = spark.range(5000).select(F.col("id").alias("transaction_id"), (F.col("id") % 3 == 0).alias("will_default"))
    keys = split.cut_keys(df, "will_default", "transaction_id", 42,
                          lambda sizes: {s: [0, 1, n // 2, n] for s, n in sizes.items()}, ordered_rows)
    rows = split._keyed(df, "transaction_id", 42).toPandas()
    for stratum, found in keys.items():
        ordered = sorted(rows[rows.will_default == stratum]["__key"])
        assert found == ["", ordered[0], ordered[len(ordered) // 2 - 1], ordered[-1]]


def test_rows_without_an_id_stay_together(spark):
    df = spark.range(300).selectExpr("if(id % 3 = 0, null, id) AS transaction_id", "id % 2 = 0 AS will_default")
    rows = split.stratified_split(df)
    assert rows.count() == 300
    assert rows.where("transaction_id IS NULL").select("will_default", "is_test").distinct().count() == 2


def test_too_many_strata_fail(spark):
    df = spark.range(1200).selectExpr("id AS transaction_id", "id AS will_default")
    with pytest.raises(ValueError, match="strata"):
        split.stratified_split(df)


def test_splits_are_exact_when_prefixes_are_counted_to_the_end(spark):
    df = spark.range(500).selectExpr("id AS transaction_id", "id % 2 = 0 AS will_default")
    coarse = split.cut_keys(df, "will_default", "transaction_id", 42, lambda sizes: {s: [0, 7, n] for s, n in sizes.items()})
    fine = split.cut_keys(df, "will_default", "transaction_id", 42,
                          lambda sizes: {s: [0, 7, n] for s, n in sizes.items()}, ordered_rows=0)
    assert coarse == fine
    keys = sorted(hashlib.md5(f"{i}42".encode()).hexdigest() for i in range(0, 500, 2))
    assert fine[True] == ["", keys[6], keys[-1]]


def test_ranges_follow_the_rows(spark):
    points = cut_points(spark.range(5000).selectExpr("CAST(id AS double) AS x"), "x", 2)
    assert 2000 < len(points) < 2600 and points == sorted(set(points))


def test_folds_are_disjoint_and_stratified(spark):
    df = spark.range(1003).select(F.col("id").alias("transaction_id"), (F.col("id") % 10 == 0).alias("will_default"))
    folds = split.stratified_folds(df).groupBy("fold", "will_default").count().collect()
    for flag, size in ((True, 101), (False, 902)):
        counts = [r["count"] for r in folds if r["will_default"] == flag]
        assert len(counts) == 5 and sum(counts) == size and max(counts) - min(counts) <= 1
    assert split.stratified_subsample(df, 100).count() == 100
    assert split.stratified_subsample(df, 5000).count() == 1003


def test_ridge_closed_form(planted):
    frame, df = planted
    x, y = frame[FEATURES].to_numpy(), np.where(frame.label == 1, 1.0, -1.0)
    centred = x - x.mean(axis=0)
    weights = np.linalg.solve(centred.T @ centred + 10 * np.eye(2), centred.T @ (y - y.mean()))
    model = fit.fit_ridge(df, FEATURES, "label", alpha=10)
    assert list(model.weights.values()) == pytest.approx(list(weights))
    assert model.intercept == pytest.approx(y.mean() - weights @ x.mean(axis=0))
    raw = np.linalg.solve(x.T @ x + 10 * np.eye(2), x.T @ y)
    assert list(fit.fit_ridge(df, FEATURES, "label", 10, False).weights.values()) == pytest.approx(list(raw))


def test_logistic_optimum_and_sparsity(planted):
    frame, df = planted
    model = fit.fit_logistic(df, FEATURES, "label", "l2", strength=0.5, tolerance=1e-9)
    x, y = frame[FEATURES].to_numpy(), frame.label.to_numpy()
    weights = np.array(list(model.weights.values()))
    p = 1 / (1 + np.exp(-(x @ weights + model.intercept)))
    gradient = 0.5 * x.T @ (p - y) + weights
    assert np.abs(gradient).max() < 0.05
    sparse = fit.fit_logistic(df, FEATURES, "label", "l1", strength=0.005)
    assert sparse.weights["y"] == 0.0


def test_scores_are_probabilities(planted):
    _, df = planted
    model = fit.fit_logistic(df, FEATURES, "label")
    rows = model.score(df, "p").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.count("p").alias("n")).first()
    assert 0 <= rows["low"] and rows["high"] <= 1 and rows["n"] == 600


def test_bernoulli_nb(planted):
    frame, df = planted
    model = fit.fit_bernoulli_nb(df, FEATURES, "label")
    flags = (frame[FEATURES] > 0).to_numpy()
    log_odds = np.zeros(len(frame))
    for c, sign in ((1, 1), (0, -1)):
        rows = flags[frame.label == c]
        p = (rows.sum(axis=0) + 1) / (len(rows) + 2)
        log_odds += sign * (np.log(len(rows)) + flags @ np.log(p) + (~flags) @ np.log(1 - p))
    found = model.score(df, "s").orderBy("id").toPandas()["s"]
    assert found.tolist() == pytest.approx((1 / (1 + np.exp(-log_odds))).tolist())


@pytest.mark.parametrize("k,by_distance", [(5, False), (10, True)])
def test_neighbours(planted, k, by_distance):
    frame, df = planted
    model = fit.fit_neighbours(df, FEATURES, "label", "id", k, by_distance)
    found = model.score(df, "s").orderBy("id").toPandas()["s"].to_numpy()
    x = frame[FEATURES].to_numpy()
    for i in range(0, 600, 37):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        near = np.argsort(d, kind="stable")[:k]
        # Every row is its own nearest neighbour at distance zero.
        expected = frame.label[i] if by_distance else frame.label[near].mean()
        assert found[i] == pytest.approx(expected)


def test_poisson_weights(spark):
    weights = spark.range(20000).select(fit.poisson_weight("id", 1).alias("w")).toPandas()["w"]
    assert weights.mean() == pytest.approx(1.0, abs=0.03)
    assert (weights == 0).mean() == pytest.approx(math.exp(-1), abs=0.02)


def specs():
    return [train.ModelSpec("ridge", lambda d: fit.fit_ridge(d, FEATURES, "label", 1.0)),
            train.ModelSpec("nb", lambda d: fit.fit_bernoulli_nb(d, FEATURES, "label"))]


def test_train_compare_records_failures(planted):
    _, df = planted
    rows = split.stratified_folds(df, 3, "label", "id")

    def refuse(_):
        raise ValueError("no such engine")

    table = train.train_compare(rows, df, [*specs(), train.ModelSpec("bad", refuse)], "label", 3).collect()
    assert [r["status"] for r in table] == ["success", "success", "failed: no such engine"]
    assert table[0]["test_auc"] > 0.75 and table[0]["cv_mean"] > 0.7


def test_ridge_search_equals_separate_fits(planted):
    frame, df = planted
    rows = split.stratified_folds(df, 3, "label", "id").cache()
    found = {(r["alpha"], r["fit_intercept"]): r["cv_mean"]
             for r in train.search_ridge(rows, FEATURES, "label", [1.0, 100.0], 3).collect()}
    spec = train.ModelSpec("r", lambda d: fit.fit_ridge(d, FEATURES, "label", 100.0))
    direct = train.cross_validate(rows, [spec], "label", 3).first()["cv_mean"]
    assert found[100.0, True] == pytest.approx(direct, abs=1e-6)
    assert len(found) == 4


def test_random_search_and_stacking(planted):
    _, df = planted
    rows = split.stratified_folds(df, 2, "label", "id")

    def make(point):
        return train.ModelSpec("nb", lambda d: fit.fit_bernoulli_nb(d, FEATURES, "label", **point))

    row = train.random_search(rows, df, "nb", make, {"alpha": [0.1, 1.0, 2.0]}, "label", specs()[1], 2, 2).first()
    assert row["improvement"] == pytest.approx(row["test_auc"] - row["baseline_auc"])
    stacked = train.fit_stacking(rows, specs(), "label", "id", 2).score(df, "score")
    scored = stacked.select(F.lit("s").alias("model_name"), "label", "score")
    assert ev.roc_auc(ev.score_curve(scored)).first()["auc"] > 0.75


def test_trees_and_bagging(planted):
    _, df = planted
    for model in (fit.fit_random_forest(df, FEATURES, "label", 5), fit.fit_gbt(df, FEATURES, "label", 3),
                  fit.fit_bagging(df, FEATURES, "label", "id", 3)):
        scored = model.score(df, "score").select(F.lit("t").alias("model_name"), "label", "score")
        assert ev.roc_auc(ev.score_curve(scored)).first()["auc"] > 0.75


def test_bagging_reads_written_weights(planted, monkeypatch):
    _, df = planted
    seen = []

    def keep(estimator, rows, features, label, weight):
        seen.append(rows)
    monkeypatch.setattr(fit, "_vector_fit", keep)
    fit.fit_bagging(df, FEATURES, "label", "id", 2)
    for bag, rows in enumerate(seen):
        assert "md5" not in rows._jdf.queryExecution().toString()
        drawn = df.withColumn("w", fit.poisson_weight("id", 42_000 + bag)).where("w > 0")
        key = [*FEATURES, "label"]
        assert sorted(rows.select(*key, "__weight").collect()) == sorted(drawn.select(*key, "w").collect())


def test_scaled_spec_keeps_the_input(planted):
    _, df = planted
    rows = df.withColumnRenamed("y", "amount")
    spec = train.ModelSpec("r", lambda d: fit.fit_ridge(d, ["x", "amount"], "label", 1.0), scaled=True)
    back = train.fit_spec(spec, rows).score(rows, "s").drop("s")
    assert sorted(back.select(rows.columns).collect()) == sorted(rows.collect())


def test_votes(spark):
    df = spark.createDataFrame([(0.6, 0.4, 0.9), (0.2, 0.2, 0.2)], "a double, b double, c double")
    rows = sc.vote_hard(sc.vote_soft(df, ["a", "b", "c"]), ["a", "b", "c"]).collect()
    assert [r["hard_vote"] for r in rows] == [1, 0]
    assert rows[1]["soft_vote"] == pytest.approx(0.2)
    assert sc.vote_hard(df, ["a", "b"]).first()["hard_vote"] == 0


def test_permutation_is_a_permutation(spark, planted):
    _, df = planted
    ranked = importance.hash_ranks(df.select("id"), "id", 42).collect()
    assert sorted(r["place"] for r in ranked) == list(range(1, 601))
    model = sc.LinearModel("m", 0.0, {"x": 2.0, "y": 0.0})
    lost = {r["feature"]: r["perm_importance"]
            for r in importance.permutation_importance(df, model, "id", "label", 3).collect()}
    assert set(lost) == {"x"} and lost["x"] > 0.2


def test_single_model_registry(spark):
    from lendlens.operators import registry
    table = registry.register(sc.coefficients_table(spark, [sc.LinearModel("a", 1.0, {"x": 2.0})]), "d", "v1", "a")
    assert registry.pick_models(table, role="champion").count() == 2
    assert registry.list_domains(table).collect()[0]["domain"] == "d"


def test_shadow_log_appends(spark, tmp_path):
    row = spark.createDataFrame([(1, 0.5)], "transaction_id long, ridge_prediction double")
    folder = str(tmp_path / "log")
    sinks.append_shadow_log(row, folder)
    assert sinks.append_shadow_log(row, folder).count() == 2


def test_stream_outcome_join_emits_unmatched(spark, tmp_path):
    predictions = spark.sql(
        "select * from values (1L, timestamp'2024-01-01'), (2L, timestamp'2024-01-01'), "
        "(3L, timestamp'2024-12-01') as t(transaction_id, timestamp)")
    outcomes = spark.sql(
        "select * from values (1L, true, timestamp'2024-01-20'), (3L, false, timestamp'2024-12-20'), "
        "(2L, true, timestamp'2024-11-30') as t(transaction_id, actual_default, resolved_at)")
    found = catalog._run(spark, jobs.stream_outcome_join(
        catalog._as_stream(spark, predictions), catalog._as_stream(spark, outcomes))).collect()
    by_id = {r["transaction_id"]: r for r in found}
    assert by_id[1]["days_to_resolution"] == 19 and by_id[3]["actual_default"] is False
    # The outcome of 2 came after the limit, so the prediction comes out without one.
    assert by_id[2]["actual_default"] is None


def test_stream_equals_batch(spark):
    batch = catalog.QUERIES["single_txn_transform"](spark, FOLDER)
    stream = catalog.QUERIES["stream_features"](spark, FOLDER)
    assert sorted(map(str, batch.collect())) == sorted(map(str, stream.select(batch.columns).collect()))


def test_models_of_folds_equal_separate_fits(planted):
    _, df = planted
    rows = split.stratified_folds(df.withColumnRenamed("y", "amount"), 3, "label", "id").cache()
    names = ["x", "amount"]
    quick = train.ModelSpec("q", lambda d: fit.fit_ridge(d, names, "label", 5.0, scaled=["amount"]),
                            fit_folds=lambda d, k: fit.ridge_folds(d, names, "label", k, 5.0, ["amount"]))
    slow = train.ModelSpec("s", lambda d: fit.fit_ridge(d, names, "label", 5.0), scaled=True)
    bayes = train.ModelSpec("b", lambda d: fit.fit_bernoulli_nb(d, names, "label", 2.0, 0.5))
    folded = train.ModelSpec("f", bayes.fit, fit_folds=lambda d, k: fit.bernoulli_folds(d, names, "label", k, 2.0, 0.5))
    auc = {r["model_name"]: r["cv_mean"]
           for r in train.cross_validate(rows, [quick, slow, bayes, folded], "label", 3).collect()}
    assert auc["q"] == pytest.approx(auc["s"], abs=1e-9)
    assert auc["b"] == pytest.approx(auc["f"], abs=1e-9)


def test_ridge_without_intercept_on_scaled_columns(planted):
    frame, df = planted
    rows = df.withColumnRenamed("y", "amount")
    x = frame[["x", "y"]].to_numpy().copy()
    mean, spread = x[:, 1].mean(), x[:, 1].std()
    x[:, 1] = (x[:, 1] - mean) / spread
    target = np.where(frame.label == 1, 1.0, -1.0)
    weights = np.linalg.solve(x.T @ x + 3 * np.eye(2), x.T @ target)
    model = fit.fit_ridge(rows, ["x", "amount"], "label", 3.0, False, ["amount"])
    assert model.weights["x"] == pytest.approx(weights[0])
    assert model.weights["amount"] == pytest.approx(weights[1] / spread)
    assert model.intercept == pytest.approx(-weights[1] / spread * mean)


def test_null_scores_are_not_left_out(spark):
    rows = spark.createDataFrame([("m", 1, 0.5), ("m", 0, 0.2), ("m", 0, None)], "model_name string, label int, score double")
    with pytest.raises(Exception, match="score is null"):
        ev.score_curve(rows).collect()
    curve = ev.score_curve(rows.where("score is not null"))
    found = {r["score"]: r["segment"] for r in ev.score_tertiles(rows, curve).collect()}
    assert found[None] is None and found[0.5] == "High"


def test_null_features_fail_the_fit(spark):
    rows = spark.createDataFrame([(1.0, 1), (None, 0), (2.0, 0)], "x double, y int")
    with pytest.raises(Exception, match="x is null"):
        fit.fit_ridge(rows, ["x"], "y")


def test_importance_does_not_depend_on_the_size_of_the_weights(spark):
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(200)],
                                 "id long, a double, b double, y int")
    found = [{r["feature"]: round(r["perm_importance"], 6) for r in importance.permutation_importance(
        rows, sc.LinearModel("m", 0.0, {"a": 0.5 * size, "b": 0.01 * size}), "id", "y", repeats=2).collect()}
        for size in (1.0, 1e-7)]
    assert found[0] == found[1] and found[0]["a"] > 0.1
