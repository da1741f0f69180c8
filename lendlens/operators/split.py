"""Stratified splits, folds and subsamples by a seeded fingerprint order.

Exact sizes come from a few cut keys per stratum. They are found digit by digit: rows are
counted by the leading digits of their fingerprint, which narrows each cut to one prefix,
until the rows left under that prefix are few enough to be ordered. The rows themselves
are never sorted, joined or shuffled; the split is a comparison with literals.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lendlens.functions.hashing import order_key
from lendlens.session import materialize

DIGITS = 3
KEY_DIGITS = 32
MAX_STRATA = 1_000
ORDERED_ROWS = 200_000

# From the sizes of the strata, in order of stratum, to the wanted ranks of each.
Ranks = Callable[[dict], dict]


def row_key(row_id: str, seed: int) -> Column:
    """Rows without an id stay together under one key, like rows that share an id."""
    return order_key(seed, F.coalesce(F.col(row_id).cast("string"), F.lit("")))


def _keyed(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    return df.withColumn("__key", row_key(row_id, seed))


def _prefix_counts(keyed: DataFrame, stratum: str, digits: int, within: Sequence[str] = ()) -> DataFrame:
    """Rows ``n`` per stratum and key prefix, written; at most 16 ** DIGITS prefixes below each known one."""
    rows = keyed
    if within:
        rows = rows.where(F.substring("__key", 1, len(within[0])).isin(list(within)))
    return materialize(rows.groupBy(F.col(stratum).alias("stratum"), F.substring("__key", 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")), "prefixes")


def _strata_sizes(counts: DataFrame) -> dict:
    """Rows per stratum in order of stratum, null first; too many strata fail before any of them is fetched."""
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("n"))
    found = sizes.limit(MAX_STRATA + 1).collect()
    if len(found) > MAX_STRATA:
        raise ValueError(f"more than {MAX_STRATA} strata")
    return {r["stratum"]: r["n"] for r in sorted(found, key=lambda r: (r["stratum"] is not None, r["stratum"]))}


def _located(rows: DataFrame, places: dict, size: int) -> dict:
    """Per place the row of (stratum, value, n) that holds its rank below its prefix of ``size`` digits.

    Ranks are found by running totals on executors; only the rows that hold one are fetched.
    """
    spark = rows.sparkSession
    wanted = spark.createDataFrame(
        [(s, i, prefix, rank) for (s, i), (prefix, rank) in places.items()],
        T.StructType([T.StructField("s", rows.schema["stratum"].dataType), T.StructField("place", T.IntegerType()),
                      T.StructField("below", T.StringType()), T.StructField("rank", T.LongType())]))
    below = F.substring("value", 1, size)
    order = Window.partitionBy("stratum", "below").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.withColumn("below", below).withColumn("upto", F.sum("n").over(order)).withColumnRenamed("below", "under")
    held = totals.join(F.broadcast(wanted), F.col("stratum").eqNullSafe(F.col("s")) & (F.col("under") == F.col("below"))).where(
        (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
    return {(r["s"], r["place"]): (r["value"], r["rank"] - (r["upto"] - r["n"]), r["n"]) for r in held.collect()}


def cut_keys(df: DataFrame, stratum: str, row_id: str, seed: int, ranks: Ranks,
             ordered_rows: int = ORDERED_ROWS) -> dict[object, list[str]]:
    """Per stratum the keys at the wanted ranks; rank 0 gives the empty key before all rows."""
    keyed = _keyed(df.select(stratum, row_id), row_id, seed)
    counts = _prefix_counts(keyed, stratum, DIGITS)
    wanted = ranks(_strata_sizes(counts))
    places = {(s, i): ("", rank) for s, rs in wanted.items() for i, rank in enumerate(rs) if rank > 0}
    size, digits = 0, DIGITS
    while places:
        found = _located(counts.withColumnRenamed("prefix", "value"), places, size)
        places = {at: (prefix, rank) for at, (prefix, rank, _) in found.items()}
        size = digits
        if size >= KEY_DIGITS or all(n <= ordered_rows for _, _, n in found.values()):
            break
        digits = min(KEY_DIGITS, size + DIGITS)
        counts = _prefix_counts(keyed, stratum, digits, sorted({p for p, _ in places.values()}))
    if places and size < KEY_DIGITS:  # the few rows left below a prefix are ordered by their whole key
        counts = _prefix_counts(keyed, stratum, KEY_DIGITS, sorted({p for p, _ in places.values()}))
        found = _located(counts.withColumnRenamed("prefix", "value"), places, size)
        places = {at: (key, rank) for at, (key, rank, _) in found.items()}
    return {s: [places[s, i][0] if rank > 0 else "" for i, rank in enumerate(rs)] for s, rs in wanted.items()}


def parts_passed(stratum: str, row_id: str, seed: int, cuts: dict[object, list[str]]) -> Column:
    """How many cut keys of its stratum lie before the row."""
    key = row_key(row_id, seed)
    passed = F.lit(0)
    for value, keys in cuts.items():
        here = F.col(stratum).isNull() if value is None else F.col(stratum) == F.lit(value)
        count = F.lit(0)
        for cut in keys:
            count = count + (key > F.lit(cut)).cast("int")
        passed = F.when(here, count).otherwise(passed)
    return passed


def stratified_split(df: DataFrame, stratum: str = "will_default", row_id: str = "transaction_id",
                     test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds ``is_test``: the first rounded-up share of every stratum in fingerprint order."""
    def test_rows(sizes: dict) -> dict:
        return {s: [-int(-(n * test_size) // 1)] for s, n in sizes.items()}

    cuts = cut_keys(df, stratum, row_id, seed, test_rows)
    return df.withColumn("is_test", parts_passed(stratum, row_id, seed, cuts) == 0)


def stratified_folds(df: DataFrame, folds: int = 5, stratum: str = "will_default",
                     row_id: str = "transaction_id", seed: int = 42) -> DataFrame:
    """Adds ``fold`` 0..folds-1: equal runs of the fingerprint order within every stratum."""
    def edges(sizes: dict) -> dict:
        return {s: [n * i // folds for i in range(1, folds)] for s, n in sizes.items()}

    cuts = cut_keys(df, stratum, row_id, seed, edges)
    return df.withColumn("fold", parts_passed(stratum, row_id, seed, cuts))


def stratified_subsample(df: DataFrame, size: int, stratum: str = "will_default",
                         row_id: str = "transaction_id", seed: int = 42) -> DataFrame:
    """Exactly ``size`` rows (or all, if fewer), shared out in proportion to the strata."""
    def shares(sizes: dict) -> dict:
        total, before, result = sum(sizes.values()), 0, {}
        kept = min(size, total)
        for s, n in sizes.items():
            result[s] = [kept * (before + n) // total - kept * before // total]
            before += n
        return result

    cuts = cut_keys(df, stratum, row_id, seed, shares)
    return df.where(parts_passed(stratum, row_id, seed, cuts) == 0)
