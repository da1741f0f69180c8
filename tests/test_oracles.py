"""Every registered query against its SQL, and rows from those that have none."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

FOLDER = os.environ.get("LENDLENS_TEST_TABLES", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = tables.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    assert normal(found.collect(), found.columns) == normal(wanted.fetchall(), wanted.columns)


SLOW = {"fit_logistic", "fit_random_forest", "fit_gbt", "fit_bagging", "train_compare",
        "random_search", "search_ridge", "stacking", "cross_validate", "search_families", "successive_search",
        "cross_validate_families"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert len(entry_module.entry(spark).columns) == 38
