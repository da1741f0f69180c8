"""Permutation importance against direct computation, in several blocks and value ranges."""

import hashlib
import random

import pytest

from lendlens.operators import importance
from lendlens.operators.score import LinearModel


def auc(scores, labels):
    good = [s for s, y in zip(scores, labels) if not y]
    bad = [s for s, y in zip(scores, labels) if y]
    return sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good)


def test_importance_in_blocks_and_ranges_is_that_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 64)
    monkeypatch.setattr(importance, "ROWS_PER_RANGE", 50)
    rng = random.Random(3)
    rows = [(i, rng.random(), float(rng.randrange(3)), 0.25, int(rng.random() < 0.4)) for i in range(300)]
    model = LinearModel("m", -0.5, {"a": 1.0, "b": -0.75, "same": 0.5, "none": 0.0})
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, a double, b double, same double, y int, none double")
    result = importance.permutation_importance(df, model, "id", "y", repeats=4)
    # Rows are not multiplied by the features.
    assert "posexplode" not in result._jdf.queryExecution().toString()
    found = {r["feature"]: (r["perm_importance"], r["perm_std"]) for r in result.collect()}
    ordered = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}42".encode()).hexdigest())
    labels = [r[4] for r in ordered]
    margin = [-0.5 + r[1] - 0.75 * r[2] + 0.5 * r[3] for r in ordered]
    base = auc([round(m, 6) for m in margin], labels)
    for place, (name, weight) in enumerate([("a", 1.0), ("b", -0.75), ("same", 0.5)], 1):
        lost = []
        for repeat in range(1, 5):
            shift = 1 + repeat * 7919 % 299
            moved = [m + weight * (ordered[(i + shift) % 300][place] - r[place]) for i, (m, r) in enumerate(zip(margin, ordered))]
            lost.append(base - auc([round(m, 6) for m in moved], labels))
        mean = sum(lost) / 4
        assert found[name] == pytest.approx((mean, (sum((x - mean) ** 2 for x in lost) / 4) ** 0.5), abs=1e-9)
    assert set(found) == {"a", "b", "same"}


def test_null_scores_fail_importance(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, None, 0)], "id long, a double, y int")
    with pytest.raises(Exception, match="score is null"):
        importance.permutation_importance(df, LinearModel("m", 0.0, {"a": 1.0}), "id", "y").collect()
