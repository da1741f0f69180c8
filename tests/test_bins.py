"""Quantile bins: all values of a feature that has few, counted exactly."""

import numpy as np

from lendlens.operators.bins import fit_bins


def test_all_values_of_few_are_edges(spark):
    rows, names = 5000, [f"x{i}" for i in range(12)]
    # 100 values each, most rows at the first: quantiles alone, after a count by estimate, would miss some.
    places = np.where(np.arange(rows) < 100, np.arange(rows), 0)
    df = spark.createDataFrame([tuple(float(p * (i + 1) + i / 7) for i in range(12)) for p in places.tolist()], names).repartition(4)
    for i, edges in enumerate(fit_bins(df, names, 100).edges):
        assert np.array_equal(edges, np.arange(99) * (i + 1) + i / 7)


def test_more_values_than_bins(spark):
    df = spark.createDataFrame([(float(i % 101), 1.0) for i in range(1000)], "a double, b double").repartition(5)
    a, b = fit_bins(df, ["a", "b"], 100).edges
    assert 0 < len(a) <= 99 and set(a) <= set(range(100)) and not len(b)
    assert [len(e) for e in fit_bins(df.where("a < 0"), ["a", "b"], 100).edges] == [0, 0]
