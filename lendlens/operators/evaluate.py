"""Evaluation of scores, per model, from one table of distinct scores.

``score_curve`` collapses the scored rows to one row per model and distinct score with
running counts. Every measure is an aggregate over that table, so nothing is sorted or
joined at row level again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lendlens.constants import (
    AVERAGE_AMOUNT, CHURN_RATE, DOWN_PAYMENT_RATE, RANKING_WEIGHTS, RULE_DISCRIMINATION,
    TARGET_DISCRIMINATION,
)
from lendlens.functions.numeric import half_even, ratio
from lendlens.operators.ordered import (
    ROWS_PER_RANGE, collapsed_ranges, quantile_parts, running_totals,
)
from lendlens.session import sized_table

MODEL = ("model_name",)
PRECISION_TARGETS = (0.90, 0.95, 0.98)
RECALL_TARGETS = (0.70, 0.80, 0.90)
PERCENTILES = (90, 95, 98, 99)
SWEEP = (0.1, 0.9, 50)


def score_curve(scores: DataFrame, by: Sequence[str] = MODEL, label: str = "label",
                score: str = "score", rows_per_range: int = ROWS_PER_RANGE,
                points: list[float] | None = None) -> DataFrame:
    """Per group and distinct score: ``n`` rows, ``pos`` positives, rows (``above``) and
    positives (``tp``) at this score or higher, rows up to it (``upto``), group sizes.

    ``points`` are known cut points of the score, which spare a pass to find them. A null score
    fails: no measure leaves rows out unseen.
    """
    known = F.coalesce(F.col(score), F.raise_error(F.lit(f"{score} is null")).cast(scores.schema[score].dataType))
    rows = scores.select(*by, F.col(label).cast("int").alias("label"), known.alias("score"))
    counts = rows.groupBy(*by, "score").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    ranged = collapsed_ranges(counts, "score", rows_per_range, points)
    curve = running_totals(
        ranged, [F.desc("score")], {"n": "above", "pos": "tp"}, by, descending=True,
        group_totals={"n": "size", "pos": "positives"})
    return curve.select(
        *by, "score", "n", "pos", "above", "tp", "size", "positives",
        (F.col("size") - F.col("above") + F.col("n")).alias("upto"))


def _precision() -> Column:
    return F.col("tp") / F.col("above")


def _recall() -> Column:
    return ratio(F.col("tp"), F.col("positives"))


def cumulative_counts(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """True and false positives when everything from this score up is flagged."""
    return curve.select(*by, "score", "tp", (F.col("above") - F.col("tp")).alias("fp"))


def pr_curve(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Precision and recall at every distinct score, and the closing point (1, 0)."""
    points = curve.select(
        *by, F.col("score").alias("threshold"), _precision().alias("precision"),
        F.coalesce(_recall(), F.lit(1.0)).alias("recall"))
    closing = curve.groupBy(*by).agg(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"))
    return points.unionByName(closing)


def auc_measure() -> Column:
    """Share of (good, bad) pairs in the right order, ties counted half."""
    negatives = (F.col("n") - F.col("pos")).cast("double")
    pairs = F.sum(negatives * ((F.col("tp") - F.col("pos")) + F.col("pos") / 2))
    positives, size = F.max("positives").cast("double"), F.max("size").cast("double")
    return F.try_divide(pairs, positives * (size - positives))


def average_precision_measure() -> Column:
    """Each score adds its share of the positives times the precision reached there."""
    return F.sum(ratio(F.col("pos"), F.col("positives")) * _precision())


def roc_auc(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return curve.groupBy(*by).agg(auc_measure().alias("auc"))


def average_precision(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return curve.groupBy(*by).agg(average_precision_measure().alias("average_precision"))


def recall_at_precision_measures(targets: Sequence[float] = PRECISION_TARGETS) -> list[Column]:
    measures = []
    for target in targets:
        name = int(round(target * 100))
        reached = _precision() >= target
        # Recall falls as the threshold rises, so the lowest qualifying score has the most of it.
        measures += [
            F.coalesce(F.max(F.when(reached, _recall())), F.lit(0.0)).alias(f"recall_at_{name}_precision"),
            F.coalesce(F.min(F.when(reached, F.col("score"))), F.lit(1.0))
            .alias(f"threshold_for_{name}_precision"),
        ]
    return measures


def precision_at_recall_measures(targets: Sequence[float] = RECALL_TARGETS) -> list[Column]:
    measures = []
    for target in targets:
        name = int(round(target * 100))
        reached = _recall() >= target
        best_first = F.when(reached, F.struct(-_precision(), F.col("score")))
        measures += [
            F.coalesce(F.max(F.when(reached, _precision())), F.lit(0.0)).alias(f"precision_at_{name}_recall"),
            F.coalesce(F.min_by("score", best_first), F.lit(0.0)).alias(f"threshold_for_{name}_recall"),
        ]
    return measures


def recall_at_precision(curve: DataFrame, by: Sequence[str] = MODEL,
                        targets: Sequence[float] = PRECISION_TARGETS) -> DataFrame:
    """Best recall with at least the wanted precision, and the lowest threshold giving it."""
    return curve.groupBy(*by).agg(*recall_at_precision_measures(targets))


def precision_at_recall(curve: DataFrame, by: Sequence[str] = MODEL,
                        targets: Sequence[float] = RECALL_TARGETS) -> DataFrame:
    return curve.groupBy(*by).agg(*precision_at_recall_measures(targets))


# Business value -----------------------------------------------------------------------------


def missed_default_cost(amount: Column | float = AVERAGE_AMOUNT) -> Column:
    return F.lit(amount) * F.lit(1 - DOWN_PAYMENT_RATE)


def rejected_good_cost(amount: Column | float = AVERAGE_AMOUNT) -> Column:
    return F.lit(amount) * F.lit(CHURN_RATE)


def cost_structure(df: DataFrame, amount: str = "amount") -> DataFrame:
    """Per row what a missed default and a rejected good customer would cost."""
    return df.withColumns({
        "missed_default_cost": missed_default_cost(F.col(amount)),
        "rejected_good_cost": rejected_good_cost(F.col(amount)),
        "cost_ratio": ratio(missed_default_cost(F.col(amount)), rejected_good_cost(F.col(amount))),
    })


def sweep_thresholds(start: float, stop: float, count: int) -> list[float]:
    step = (stop - start) / (count - 1)
    return [start + i * step for i in range(count - 1)] + [stop]


def threshold_table(curve: DataFrame, by: Sequence[str] = MODEL,
                    sweep: tuple[float, float, int] = SWEEP) -> DataFrame:
    """Confusion counts and business value at every threshold.

    Each distinct score is placed between two thresholds by arithmetic; totals per gap
    are then accumulated over at most ``count + 1`` rows per model.
    """
    start, stop, count = sweep
    values = sweep_thresholds(start, stop, count)
    grid = F.array(*[F.lit(v) for v in values])
    guess = F.greatest(F.lit(0), F.least(F.lit(count), (
        F.floor((F.col("score") - F.lit(start)) / F.lit((stop - start) / (count - 1))) + 1
    ).cast("int")))
    # The arithmetic may be one off next to a threshold; the neighbours decide.
    up = (guess < count) & (F.get(grid, guess) <= F.col("score"))
    down = (guess > 0) & (F.get(grid, guess - 1) > F.col("score"))
    passed = guess + F.coalesce(up, F.lit(False)).cast("int") - F.coalesce(down, F.lit(False)).cast("int")
    gaps = curve.groupBy(*by, passed.alias("passed")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"),
        F.max("size").alias("size"), F.max("positives").alias("positives"))
    models = gaps.groupBy(*by).agg(
        F.max("size").alias("size"), F.max("positives").alias("positives"))
    steps = models.select(*by, "size", "positives", F.posexplode(grid).alias("place", "threshold"))
    joined = steps.withColumn("passed", F.col("place") + 1).join(
        gaps.select(*by, "passed", "n", "pos"), [*by, "passed"], "left")
    upward = Window.partitionBy(*by).orderBy(F.desc("passed")).rowsBetween(
        Window.unboundedPreceding, 0)
    flagged = joined.select(
        *by, "threshold", "size", "positives",
        F.coalesce(F.sum("pos").over(upward), F.lit(0)).alias("tp"),
        F.coalesce(F.sum("n").over(upward), F.lit(0)).alias("flagged"))
    fp = F.col("flagged") - F.col("tp")
    table = flagged.select(
        *by, "threshold", (F.col("size") - F.col("positives") - fp).alias("tn"), fp.alias("fp"),
        (F.col("positives") - F.col("tp")).alias("fn"), "tp")
    return table.withColumn("net_value", F.col("tp") * missed_default_cost() - F.col("fp") * rejected_good_cost())


def best_threshold(table: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """The first threshold with the highest value, and precision, recall and F1 there."""
    best = table.groupBy(*by).agg(F.min_by(
        F.struct("threshold", "net_value", "tp", "fp", "fn"),
        F.struct(-F.col("net_value"), F.col("threshold"))).alias("b"))
    precision = F.coalesce(ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fp")), F.lit(0.0))
    recall = F.coalesce(ratio(F.col("b.tp"), F.col("b.tp") + F.col("b.fn")), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * precision * recall, precision + recall), F.lit(0.0))
    return best.select(
        *by, F.col("b.threshold").alias("optimal_business_threshold"),
        F.col("b.net_value").alias("max_business_value"),
        precision.alias("precision_at_optimal_threshold"),
        recall.alias("recall_at_optimal_threshold"), f1.alias("f1_at_optimal_threshold"))


def threshold_sweep(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return best_threshold(threshold_table(curve, by), by)


# Segments ------------------------------------------------------------------------------------
#
# A score is at or below the p-quantile exactly when its first place in ascending order is not
# beyond the place of the quantile, and at or above it when its last place reaches the next one.
# Segments therefore follow from the running counts alone.


def _place(p: float) -> Column:
    return (F.col("size") - 1) * F.lit(p)


def at_most_quantile(p: float) -> Column:
    return F.col("upto") - F.col("n") <= F.floor(_place(p))


def at_least_quantile(p: float) -> Column:
    return F.col("upto") > F.ceil(_place(p))


def tertile() -> Column:
    return (
        F.when(at_most_quantile(1 / 3), "Low").when(at_most_quantile(2 / 3), "Medium")
        .otherwise("High")
    )


def score_tertiles(scores: DataFrame, curve: DataFrame, by: Sequence[str] = MODEL,
                   score: str = "score") -> DataFrame:
    """Each row with the quantile third of its score, by the highest score of the lower two; null without one."""
    tops = sized_table(curve.groupBy(*by).agg(
        F.max(F.when(at_most_quantile(1 / 3), F.col("score"))).alias("__low"),
        F.max(F.when(at_most_quantile(2 / 3), F.col("score"))).alias("__medium")))
    x = F.col(score)
    segment = F.when(x <= F.col("__low"), "Low").when(x <= F.col("__medium"), "Medium").when(x.isNotNull(), "High")
    return scores.join(tops, list(by)).withColumn("segment", segment).drop("__low", "__medium")


def segment_tertiles(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return curve.groupBy(*by, tertile().alias("segment")).agg(
        F.sum("n").alias("count"), F.sum("pos").alias("defaults"),
        (F.sum("pos") / F.sum("n")).alias("default_rate"))


def _segment_rate(segment: str) -> Column:
    return half_even(ratio(
        F.sum(F.when(tertile() == segment, F.col("pos"))),
        F.sum(F.when(tertile() == segment, F.col("n")))), 3)


def tertile_measures() -> tuple[list[Column], Column]:
    """Rates of the outer thirds, and their ratio.

    Thirds with equal edges cannot be told apart; the ratio is then 0.
    """
    aggregates = [_segment_rate("High").alias("high_rate"), _segment_rate("Low").alias("low_rate")]
    edges = []
    for name, p in (("q1", 1 / 3), ("q2", 2 / 3)):
        parts, value = quantile_parts(name, p, F.col("score"))
        aggregates += parts
        edges.append(value)
    aggregates += [F.min("score").alias("edge_low"), F.max("score").alias("edge_high")]
    distinct = (F.col("edge_low") < edges[0]) & (edges[0] < edges[1]) & (edges[1] < F.col("edge_high"))
    quotient = F.when(F.col("low_rate") == 0, F.when(F.col("high_rate") > 0, F.lit(float("inf")))
                      .otherwise(F.lit(float("nan")))).otherwise(ratio(F.col("high_rate"), F.col("low_rate")))
    return aggregates, F.when(distinct, quotient).otherwise(F.lit(0.0))


def decile_measures() -> tuple[list[Column], Column]:
    top = at_least_quantile(0.9)
    aggregates = [
        ratio(F.sum(F.when(top, F.col("pos"))), F.sum(F.when(top, F.col("n")))).alias("top10_precision"),
        ratio(F.sum(F.when(~top, F.col("pos"))), F.sum(F.when(~top, F.col("n")))).alias("bottom90_rate"),
    ]
    quotient = F.when(F.col("bottom90_rate") > 0, F.col("top10_precision") / F.col("bottom90_rate")
                      ).otherwise(F.lit(float("inf")))
    return aggregates, quotient


def top_decile(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    aggregates, quotient = decile_measures()
    return curve.groupBy(*by).agg(*aggregates).withColumn("discrimination_top10", quotient)


def percentile_thresholds(curve: DataFrame, by: Sequence[str] = MODEL,
                          percentiles: Sequence[int] = PERCENTILES) -> DataFrame:
    """Threshold, precision and recall of the top shares of the scores, one row per share."""
    aggregates, cells = [F.max("size").alias("size"), F.max("positives").alias("positives")], []
    for p in percentiles:
        parts, value = quantile_parts(f"p{p}", p / 100, F.col("score"))
        top = at_least_quantile(p / 100)
        aggregates += parts + [
            F.sum(F.when(top, F.col("pos"))).alias(f"tp{p}"), F.sum(F.when(top, F.col("n"))).alias(f"n{p}")]
        cells.append(F.struct(
            F.lit(100 - p).alias("top_percent"), value.alias("threshold"),
            ratio(F.col(f"tp{p}"), F.col(f"n{p}")).alias("precision"),
            ratio(F.col(f"tp{p}"), F.col("positives")).alias("recall")))
    wide = curve.groupBy(*by).agg(*aggregates)
    return wide.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def business_assessment(metrics: DataFrame, discrimination: str = "discrimination_top10") -> DataFrame:
    """Improvement over the rule system and the verdict on it."""
    value = F.col(discrimination)
    return metrics.withColumns({
        "improvement_vs_baseline": value - RULE_DISCRIMINATION,
        "beats_baseline": value > RULE_DISCRIMINATION,
        "exceeds_target": value > TARGET_DISCRIMINATION,
        "status": F.when(value > TARGET_DISCRIMINATION, "exceeds target")
        .when(value > RULE_DISCRIMINATION, "beats baseline").otherwise("below baseline"),
    })


def evaluate_business(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """AUC, discrimination by thirds and by top decile, and the assessment."""
    thirds, equal = tertile_measures()
    deciles, top = decile_measures()
    wide = curve.groupBy(*by).agg(
        F.max("size").alias("size"), auc_measure().alias("auc"), *thirds, *deciles)
    measured = wide.select(
        *by, "auc", equal.alias("discrimination_equal"), top.alias("discrimination_top10"),
        "top10_precision")
    return business_assessment(measured)


def evaluate_comprehensive(curve: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Average precision, recall at precision, precision at recall and the best threshold."""
    measured = curve.groupBy(*by).agg(
        average_precision_measure().alias("auc_pr"), *recall_at_precision_measures(),
        *precision_at_recall_measures())
    return measured.join(threshold_sweep(curve, by), list(by))


def score_diagnostics(curve: DataFrame, by: Sequence[str] = MODEL, cut: float = 0.5) -> DataFrame:
    """Accuracy, AUC, score range and mean, rows above the cut, and warning flags."""
    above = F.col("score") > cut
    wide = curve.groupBy(*by).agg(
        F.max("size").alias("samples"), F.max("positives").alias("defaults"),
        auc_measure().alias("auc"),
        F.sum(F.when(above, F.col("pos")).otherwise(F.col("n") - F.col("pos"))).alias("right"),
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.sum(F.col("score") * F.col("n")).alias("total"),
        F.sum(F.when(above, F.col("n")).otherwise(0)).alias("above_cut"))
    rate = F.col("defaults") / F.col("samples")
    return wide.select(
        *by, "samples", "defaults", rate.alias("default_rate"),
        (F.col("right") / F.col("samples")).alias("accuracy"), "auc", "min_score", "max_score",
        (F.col("total") / F.col("samples")).alias("mean_score"), "above_cut",
        (rate < 0.02).alias("very_low_default_rate"), (F.col("max_score") < cut).alias("all_scores_low"))


KEY_METRICS = [
    "auc_pr", "recall_at_95_precision", "recall_at_90_precision", "precision_at_80_recall",
    "max_business_value", "optimal_business_threshold", "f1_at_optimal_threshold",
]


def model_comparison(metrics: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return metrics.select(*by, *[half_even(F.col(c), 4).alias(c) for c in KEY_METRICS])


def business_ranking(metrics: DataFrame, model: str = "model_name") -> DataFrame:
    """Weighted sum of measures, each over its maximum; the best model is the champion.

    Works on one row per model.
    """
    everything = Window.partitionBy(F.lit(0))
    score = F.lit(0.0)
    for metric, weight in RANKING_WEIGHTS.items():
        top = F.max(metric).over(everything)
        score = score + F.lit(weight) * F.when(top > 0, F.col(metric) / top).otherwise(F.lit(0.0))
    scored = metrics.select(model, *RANKING_WEIGHTS, score.alias("ranking_score"))
    place = F.row_number().over(everything.orderBy(F.desc("ranking_score"), model))
    return scored.withColumn("place", place).withColumn(
        "status", F.when(F.col("place") == 1, "champion").otherwise("challenger")).orderBy("place")


def select_candidates(auc: DataFrame, first: int = 8, at_least: float = 0.59,
                      model: str = "model_name") -> DataFrame:
    top = auc.orderBy(F.desc("auc"), model).limit(first)
    return top.where(F.col("auc") >= at_least)


def discrimination_report(curve: DataFrame, by: Sequence[str] = MODEL,
                          targets: tuple[float, float, float] = (1.0, 1.5, 2.8)) -> DataFrame:
    """Discrimination by thirds against the rule system and the target bands."""
    minimum, acceptable, success = targets
    thirds, equal = tertile_measures()
    wide = curve.groupBy(*by).agg(F.max("size").alias("size"), *thirds)
    value = F.col("discrimination_ratio")
    return wide.select(*by, "high_rate", "low_rate", equal.alias("discrimination_ratio")).withColumns({
        "rule_discrimination": F.lit(RULE_DISCRIMINATION),
        "band": F.when(value > success, "beats rules").when(value >= acceptable, "acceptable")
        .when(value > minimum, "better than random").otherwise("below minimum"),
    })


def ensemble_compare(auc: DataFrame, singles: Sequence[str], model: str = "model_name") -> DataFrame:
    """AUC of each ensemble against the best single model; one row per model in the input."""
    best = F.max(F.when(F.col(model).isin(list(singles)), F.col("auc"))).over(Window.partitionBy(F.lit(0)))
    return auc.select(model, "auc", (F.col("auc") - best).alias("vs_best_single")).where(
        ~F.col(model).isin(list(singles)))
