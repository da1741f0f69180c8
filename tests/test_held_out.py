"""AUC of many models of a search without a row per model and score, and Newton sums that models share."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendlens.operators import fit, held_out, newton, train
from lendlens.operators.evaluate import roc_auc, score_curve
from lendlens.operators.score import LinearModel

FEATURES = ["a", "b", "c"]


class Shifted:
    """A model that is no linear one."""

    def score(self, df, output):
        return df.withColumn(output, F.floor(F.col("a") * 3) + F.col("b") * 0)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    n = 3000
    frame = pd.DataFrame({"id": range(n), **{f: np.round(rng.normal(size=n) * 8) / 8 for f in FEATURES}})
    frame["label"] = (rng.random(n) < 1 / (1 + np.exp(1 - frame.a + 0.5 * frame.b))).astype(int)
    frame["fold"] = frame.id % 3
    return spark.createDataFrame(frame).repartition(5).cache()


def models_of(rows):
    lines = [[LinearModel("m", 0.125, {"a": 1.0 + k, "b": -0.5, "c": 0.0}, k > 0) for _ in range(3)] for k in range(3)]
    return [*lines, *[fit.bernoulli_folds(rows, FEATURES, "label", 3, 1.0, cut) for cut in (0.0, 0.5)], [Shifted()] * 3]


@pytest.mark.parametrize("per_range", [1 << 18, 40])
def test_aucs_equal_those_of_the_curve(rows, per_range):
    models = models_of(rows)
    found = {(r["point"], r["fold"]): r["auc"] for r in held_out.fold_aucs(rows, models, "label", per_range).collect()}
    by = ("point", "fold")
    wanted = {(r["point"], r["fold"]): r["auc"] for r in roc_auc(score_curve(train.held_out_points(rows, models, "label"), by), by).collect()}
    assert len(wanted) == 18 and found == pytest.approx(wanted, abs=1e-12)


def test_ranges_are_cut_and_one_class_has_no_auc(rows):
    models = models_of(rows)
    edges = held_out.range_edges(rows, models, "label", 40)
    assert len(edges) == 18 and len(edges[0, 0]) > 10
    lone = held_out.fold_aucs(rows.where("label = 1"), models, "label").collect()
    assert len(lone) == 18 and all(r["auc"] is None for r in lone)


def test_null_features_fail(rows):
    with pytest.raises(Exception, match="score is null"):
        held_out.fold_aucs(rows.withColumn("a", F.when(F.col("id") != 7, F.col("a"))), models_of(rows)[:1], "label").collect()


def test_models_at_the_same_weights_share_their_sums(rows, monkeypatch):
    sizes = []
    combined = newton.combined
    monkeypatch.setattr(newton, "combined", lambda df, reduce, *a, **k: sizes.append(
        len(reduce.__closure__[reduce.__code__.co_freevars.index("plans")].cell_contents)) or combined(df, reduce, *a, **k))
    points = [newton.Penalty(s, 0.5, tol=t) for s in (0.1, 1.0) for t in (1e-4, 1e-8)]
    found = newton.penalised(rows, FEATURES, "label", points, [None, 0, 1])
    assert sizes[0] == 3 and max(sizes) == 6
    alone = newton.penalised(rows, FEATURES, "label", points[3:], [0])[0][0]
    assert found[3][1].weights == pytest.approx(alone.weights, abs=1e-9) and found[2][1].steps <= found[3][1].steps
