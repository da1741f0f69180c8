"""Whitening against numpy's eigenvectors and exact integers."""

import math

import numpy as np
import pytest

from lendlens.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, component string"


def run(spark, rows, most=16):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    return whitening.whitened(df, most=most).collect()


@pytest.mark.parametrize("width,seed", [(1, 1), (2, 2), (7, 3), (40, 4)])
def test_inertia_counts(width, seed):
    rng = np.random.default_rng(seed)
    for _ in range(20):
        a = rng.normal(size=(width, width))
        a = a + a.T
        np.fill_diagonal(a, rng.choice([0.0, 1.0], width) * np.diag(a))
        values = np.linalg.eigvalsh(a)
        for shift in (-0.5, 0.0, 0.7):
            assert whitening.positive_pivots(a - shift * np.eye(width)) == (values > shift).sum()


@pytest.mark.parametrize("spectrum", [
    [9, 5, 4, 1, 0.5], [3, 3, 3, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.1, 1e-7], [2, 1, 0, 0, 0], [1e9, 1, 1e-3, 1e-3, 0], [0, 0, 0, 0, 0]])
def test_leading_pairs(spectrum):
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(5, 5)))[0]
    a = q @ np.diag(spectrum) @ q.T
    values, vectors = whitening.leading_eigenpairs(a, 4)
    real = [s for s in sorted(spectrum, reverse=True) if s > 8 * 5 * 2.3e-16 * max(spectrum) * 3][:4]
    assert len(values) == len(real)
    assert np.allclose(values, real, rtol=1e-6, atol=1e-14 * max(spectrum))
    assert np.abs(vectors.T @ vectors - np.eye(len(real))).max(initial=0) < 1e-6
    assert np.abs(a @ vectors - vectors * values).max(initial=0) <= 1e-13 * max(spectrum)


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 20)) * np.linspace(3, 0.2, 20)
    rows = [(i, list(map(float, v))) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[7][1]) for i in range(100)]  # copies count once in the fit
    rows += [(None, rows[3][1]), (2000, None), (2001, []), (2002, [1.0] * 19), (2003, [math.nan] * 20),
             (2004, [None] + [1.0] * 19), (2005, [math.inf] * 20)]
    found = run(spark, rows)
    assert len(found) == 401 * 16
    x = [[math.floor(64 * c) + 1000000 for c in v] for _, v in rows[:300]]
    n, s = len(set(map(tuple, x))), [sum(c) for c in zip(*set(map(tuple, x)))]
    centred = np.array(sorted(set(map(tuple, x)))) - np.array(s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-10
    for i in (0, 7, 299):
        exact = sum((n * c - t) ** 2 for c, t in zip(x[i], s))
        for k in range(16):
            r = by[i, k + 1]
            assert r["deviation"] == exact
            assert r["explained"] == pytest.approx(values[-1 - k] / values.sum(), rel=1e-9)
            assert abs(r["whitened"]) == pytest.approx(abs((np.array(x[i]) - np.array(s) / n) @ vectors[:, -1 - k]) / math.sqrt(values[-1 - k]), abs=1e-7)
    assert by[1000, 1]["whitened"] == by[7, 1]["whitened"] and by[None, 1]["deviation"] == by[3, 1]["deviation"]


def test_degenerate_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [math.nan])]) == []
    assert run(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # one distinct vector has no variance
    two = run(spark, [(1, [0.0, 0.0, 5.0]), (2, [1.0, 0.0, 5.0])])
    assert [(r["component"], round(abs(r["whitened"]), 12), r["explained"]) for r in two] == [(1, 1.0, 1.0)] * 2
    huge = run(spark, [(1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 1e12])])
    assert {r["deviation"] for r in huge} == {None} and len(huge) == 6
