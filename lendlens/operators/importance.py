"""Feature importance from coefficients, families of features, and permutation."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlens.constants import EXACT_FAMILY, FEATURE_FAMILIES, OTHER_FAMILY
from lendlens.functions.hashing import key_bucket, order_key
from lendlens.functions.numeric import half_even
from lendlens.operators.evaluate import roc_auc, score_curve
from lendlens.operators.ordered import ROWS_PER_RANGE, cut_points, running_totals
from lendlens.operators.passes import column_values
from lendlens.operators.score import INTERCEPT, LinearModel
from lendlens.session import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Places of the fingerprint order that meet in one task.
BLOCK = 1 << 15
LISTS = [pa.list_(pa.float64()), pa.list_(pa.int64())]
SCORED = pa.schema(zip(["feature", "repeat", "range", "bad", "bads", "good", "goods"], [pa.int64()] * 3 + LISTS * 2))


def feature_category(column: str = "feature") -> Column:
    name = F.col(column)
    family = F.when(name.isin(EXACT_FAMILY[1]), EXACT_FAMILY[0]).otherwise(OTHER_FAMILY)
    for label, fragments in reversed(FEATURE_FAMILIES):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | name.contains(fragment)
        family = F.when(hit, label).otherwise(family)
    return family


def importance_rank(coefficients: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Rank of each feature by absolute coefficient; one row per feature and model."""
    rows = coefficients.where(F.col("feature") != INTERCEPT).withColumn(
        "abs_coefficient", F.abs("coefficient"))
    order = Window.partitionBy(*by).orderBy(F.desc("abs_coefficient"), "feature")
    return rows.withColumn("importance_rank", F.row_number().over(order))


def coefficient_importance(coefficients: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Ranked coefficients with the range, mean size and population deviation per model."""
    ranked = importance_rank(coefficients, by)
    group = Window.partitionBy(*by)
    c = F.col("coefficient")
    return ranked.select(
        *by, "feature", "coefficient", "abs_coefficient", "importance_rank",
        F.min(c).over(group).alias("min_coefficient"), F.max(c).over(group).alias("max_coefficient"),
        F.avg("abs_coefficient").over(group).alias("mean_abs_coefficient"),
        F.stddev_pop(c).over(group).alias("std_coefficient"))


def category_importance(coefficients: DataFrame, by: Sequence[str] = ("model_name",)) -> DataFrame:
    """Mean and total absolute coefficient per family, and its impact against the deviation."""
    rows = importance_rank(coefficients, by).withColumn("category", feature_category())
    deviation = rows.groupBy(*by).agg(F.stddev_pop("coefficient").alias("deviation"))
    families = rows.groupBy(*by, "category").agg(
        half_even(F.avg("abs_coefficient"), 4).alias("avg_abs_coef"),
        half_even(F.sum("abs_coefficient"), 4).alias("total_abs_coef"),
        F.count(F.lit(1)).alias("feature_count"),
        half_even(F.avg("coefficient"), 4).alias("avg_coef"))
    size, spread = F.col("avg_abs_coef"), F.col("deviation")
    return families.join(deviation, list(by)).withColumn(
        "impact", F.when(size > spread, "High").when(size > spread / 2, "Medium").otherwise("Low")
    ).drop("deviation").orderBy(*by, F.desc("total_abs_coef"), "category")


def join_importances(left: DataFrame, right: DataFrame, on: str = "feature") -> DataFrame:
    return left.join(right, on)


def hash_ranks(df: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Adds ``place`` 1..n in fingerprint order and the table size, without a global sort."""
    keyed = df.withColumn("__key", order_key(seed, F.col(row_id)))
    ranged = keyed.withColumns({"range_id": key_bucket(F.col("__key"), 4), "__one": F.lit(1).cast("long")})
    ranked = running_totals(ranged, [F.asc("__key"), F.asc(row_id)], {"__one": "place"},
                            group_totals={"__one": "size"})
    return ranked.drop("__key", "__one", "range_id")


def score_scale(model: LinearModel) -> float:
    """A power of ten that brings the weights to about 1: rounding then only joins scores that
    differ by the order of summation, at any size of the weights."""
    largest = max(map(abs, model.weights.values()), default=0.0)
    return 10.0 ** max(0, -math.floor(math.log10(largest)) - 1) if largest else 1.0


def rounded_units(x: np.ndarray) -> np.ndarray:
    """Millionths, halves away from zero; what is too large for it is whole already."""
    size = np.abs(x) * 1e6
    return np.copysign(np.where(size < 2.0 ** 52, np.floor(size + 0.5), size), x)


def tallied(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ordered array and how often each occurs."""
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


def donor_shift(repeat: int, size: int) -> int:
    return 1 + repeat * 7919 % max(size - 1, 1)


def permuted_counts(ranked: DataFrame, width: int, size: int, scale: float, points: Sequence[float], repeats: int) -> DataFrame:
    """(feature, repeat, range, positives, negatives, twice): rows per range of the permuted scores and
    twice the (good, bad) pairs inside it that are in the right order, ties counted half.

    One fingerprint order serves all repeats: repeat r takes each feature value from the row a fixed
    distance further on in that order. In a linear model only one term moves, so a row needs nothing
    but its margin and its own and the donor's terms. Rows are dealt to blocks of the order, each with
    the donors of its rows; a block sends on the ordered scores per feature, repeat and value range.
    """
    edges = np.array(sorted(points)) * 1e6
    shifts = [donor_shift(r, size) for r in range(1, repeats + 1)]
    at = F.col("place") - 1
    number = lambda place: F.floor(place / F.lit(BLOCK)).cast("long")
    blocks = F.explode(F.array_distinct(F.array(
        number(at), *[number(F.pmod(at - F.lit(s), F.lit(size))) for s in shifts])))
    dealt = ranked.select(blocks.alias("block"), at.alias("place"), "label", "margin", "terms")

    def scores(key: tuple, rows: pa.Table) -> pa.Table:
        place, margin = rows["place"].to_numpy(), rows["margin"].to_numpy()
        positive = rows["label"].to_numpy() == 1
        terms = column_values(pa.concat_arrays(rows["terms"].chunks), width)
        order = np.argsort(place)
        mine = np.flatnonzero(place // BLOCK == key[0].as_py())
        found = []
        for repeat, shift in enumerate(shifts, 1):
            wanted = (place[mine] + shift) % size
            near = np.minimum(np.searchsorted(place, wanted, sorter=order), len(place) - 1)
            donor = order[near]
            held = place[donor] == wanted
            own, donor = mine[held], donor[held]
            moved = rounded_units((margin[own][:, None] + (terms[donor] - terms[own])) * scale).T
            sides = [np.sort(moved[:, positive[own]], axis=1), np.sort(moved[:, ~positive[own]], axis=1)]
            for feature in range(width):
                parts = [np.split(side[feature], np.searchsorted(side[feature], edges)) for side in sides]
                found += [(feature, repeat, number, *tallied(bad), *tallied(good))
                          for number, (bad, good) in enumerate(zip(*parts)) if len(bad) or len(good)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*found) if found else [[]] * len(SCORED.names), SCORED.types)], schema=SCORED)

    def pairs(key: tuple, rows: pa.Table) -> pa.Table:
        bad, bads, good, goods = (rows[n].combine_chunks().flatten().to_numpy() for n in ("bad", "bads", "good", "goods"))
        order = np.argsort(good)
        good, upto = good[order], np.append(0, np.cumsum(goods[order]))
        twice = int((bads * (upto[np.searchsorted(good, bad)] + upto[np.searchsorted(good, bad, side="right")])).sum())
        return pa.table({n: [v] for n, v in zip(("feature", "repeat", "range", "positives", "negatives", "twice"), (
            *(k.as_py() for k in key), int(bads.sum()), int(goods.sum()), twice))})
    kept = dealt.groupBy("block").applyInArrow(
        scores, "feature long, repeat long, range long, bad array<double>, bads array<long>, good array<double>, goods array<long>")
    return kept.groupBy("feature", "repeat", "range").applyInArrow(
        pairs, "feature long, repeat long, range long, positives long, negatives long, twice long")


def permutation_importance(df: DataFrame, model: LinearModel, row_id: str, label: str,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean and deviation of the AUC lost when a feature is permuted.

    Margins and terms are written once. No row is made per feature and repeat: these are arrays
    inside the tasks, and equal scores of a block travel as one.
    """
    features = [f for f, w in model.weights.items() if w != 0.0]
    terms = F.array(*[F.lit(model.weights[f]) * F.col(f) for f in features]).cast("array<double>")
    rows = materialize(df.select(
        row_id, F.col(label).cast("int").alias("label"), model.margin().alias("margin"), terms.alias("terms")), "margins")
    base = rows.select(F.lit(model.name).alias("model_name"), "label",
                       F.round(F.col("margin") * F.lit(score_scale(model)), 6).alias("score"))
    base_auc = roc_auc(score_curve(base)).first()
    # Permuted scores spread like the unpermuted ones, so those give the cut points.
    points = cut_points(base, "score", ROWS_PER_RANGE)
    counts = permuted_counts(hash_ranks(rows, row_id, seed), len(features), rows.count(), score_scale(model), points, repeats)
    before = Window.partitionBy("feature", "repeat").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    lower = F.coalesce(F.sum("negatives").over(before), F.lit(0))
    positives, negatives = F.sum("positives").cast("double"), F.sum("negatives").cast("double")
    aucs = counts.withColumn("twice", F.col("twice") + 2 * F.col("positives") * lower).groupBy("feature", "repeat").agg(
        F.try_divide(F.sum("twice").cast("double") / 2, positives * negatives).alias("auc"))
    lost = F.lit(base_auc["auc"] if base_auc else None).cast("double") - F.col("auc")
    names = F.array(*[F.lit(f) for f in features]).cast("array<string>")
    return aucs.groupBy(F.get(names, F.col("feature").cast("int")).alias("feature")).agg(
        F.avg(lost).alias("perm_importance"), F.stddev_pop(lost).alias("perm_std"))
