"""Linear scoring, votes and shadow scoring as plain projections.

A model is a row set (model, feature, coefficient); scoring unrolls it into one
expression per model, so all models are scored in a single pass over the features.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.functions.numeric import ratio, sigmoid
from lendlens.operators.evaluate import missed_default_cost, rejected_good_cost
from lendlens.operators.underwriting import rule_decision

INTERCEPT = "__intercept__"
MAX_COEFFICIENTS = 1_000_000


def number(value: float) -> str:
    """A double literal that keeps every bit."""
    return f"({value!r}D)"


def sigmoid_sql(margin: str) -> str:
    return f"1D / (1D + exp(-({margin})))"


@dataclass(frozen=True)
class LinearModel:
    name: str
    intercept: float
    weights: dict[str, float]
    probability: bool = True

    def margin_sql(self) -> str:
        terms = [f"{number(w)} * `{f}`" for f, w in self.weights.items() if w != 0.0]
        return " + ".join([number(self.intercept), *terms])

    def column_sql(self) -> str:
        return sigmoid_sql(self.margin_sql()) if self.probability else self.margin_sql()

    def margin(self) -> Column:
        return F.expr(self.margin_sql())

    def score(self, df: DataFrame, output: str) -> DataFrame:
        return df.withColumn(output, F.expr(self.column_sql()))

    def rows(self) -> list[tuple[str, str, float]]:
        return [*((self.name, f, w) for f, w in self.weights.items()),
                (self.name, INTERCEPT, self.intercept)]


def models_from_table(coefficients: DataFrame) -> list[LinearModel]:
    """Coefficient rows (one per model and feature) to models, in order of name."""
    rows = coefficients.select("model_name", "feature", "coefficient").limit(
        MAX_COEFFICIENTS + 1).collect()
    if len(rows) > MAX_COEFFICIENTS:
        raise ValueError("coefficient table too large for unrolled scoring")
    names = sorted({r["model_name"] for r in rows})
    return [
        LinearModel(
            name,
            next((r["coefficient"] for r in rows
                  if r["model_name"] == name and r["feature"] == INTERCEPT), 0.0),
            {r["feature"]: r["coefficient"] for r in rows
             if r["model_name"] == name and r["feature"] != INTERCEPT})
        for name in names
    ]


def coefficients_table(spark, models: Sequence[LinearModel]) -> DataFrame:
    rows = [row for model in models for row in model.rows()]
    return spark.createDataFrame(rows, "model_name string, feature string, coefficient double")


def score_linear(df: DataFrame, models: Sequence[LinearModel], keep: Sequence[str]) -> DataFrame:
    """Long form: one row per input row and model with its ``margin``."""
    cells = F.explode(F.array(*[
        F.struct(F.lit(m.name).alias("model_name"), m.margin().alias("margin")) for m in models
    ]))
    return df.select(*keep, cells.alias("cell")).select(*keep, "cell.model_name", "cell.margin")


def decision_to_probability(df: DataFrame, margin: str = "margin", output: str = "score") -> DataFrame:
    return df.withColumn(output, sigmoid(F.col(margin)))


def row_mean(columns: Sequence[str]) -> Column:
    return sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / F.lit(float(len(columns)))


def wide_scores(scores: DataFrame, models: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per transaction with a column per model."""
    return scores.groupBy(*keep).agg(*[
        F.max(F.when(F.col("model_name") == m, F.col("score"))).alias(m) for m in models
    ])


def vote_soft(df: DataFrame, models: Sequence[str], output: str = "soft_vote") -> DataFrame:
    """Mean of the models' probabilities."""
    return df.withColumn(output, row_mean(list(models)))


def vote_hard(df: DataFrame, models: Sequence[str], cut: float = 0.5, output: str = "hard_vote") -> DataFrame:
    """Majority of the models' labels; a tie is 0. The mean score serves for ranking."""
    votes = sum((F.when(F.col(m) > cut, 1).otherwise(0) for m in models), F.lit(0))
    return df.withColumns({
        "votes": votes, output: (votes * 2 > len(models)).cast("int"),
        f"{output}_score": row_mean(list(models)),
    })


def vote_weights(auc: DataFrame) -> dict[str, float]:
    """Weights in proportion to each model's AUC."""
    rows = auc.select("model_name", "auc").collect()
    total = sum(r["auc"] for r in rows)
    return {r["model_name"]: r["auc"] / total for r in rows}


def vote_weighted(df: DataFrame, weights: dict[str, float], output: str = "weighted_vote") -> DataFrame:
    total = F.lit(0.0)
    for model, weight in sorted(weights.items()):
        total = total + F.lit(weight) * F.col(model)
    return df.withColumn(output, total)


def shadow_score(df: DataFrame, models: Sequence[LinearModel], champion: str) -> DataFrame:
    """All model scores, their ensemble, the champion's and the mean of all, per transaction."""
    for model in models:
        df = model.score(df, f"{model.name}_prediction")
    singles = [f"{m.name}_prediction" for m in models]
    df = df.withColumn("ensemble_prediction", row_mean(singles))
    return df.withColumns({
        "champion": F.lit(champion),
        "champion_score": F.col(f"{champion}_prediction"),
        "consensus_prediction": row_mean([*singles, "ensemble_prediction"]),
    })


def decision_cost(decision: Column, defaulted: Column, amount: Column) -> Column:
    """What a decision costs once the outcome is known: a loan lost, or a good customer turned away."""
    return (
        F.when((decision == "approve") & defaulted, missed_default_cost(amount))
        .when((decision == "decline") & ~defaulted, rejected_good_cost(amount))
        .otherwise(F.lit(0.0))
    )


def shadow_decisions(df: DataFrame, cut: float, score: str = "champion_score") -> DataFrame:
    """Rule and model decisions side by side with the cost the model would have saved."""
    model = F.when(F.col(score) >= cut, "decline").otherwise("approve")
    df = df.withColumns({"business_decision": rule_decision(), "model_decision": model})
    defaulted, amount = F.col("will_default"), F.col("amount")
    return df.withColumn("opportunity_cost", (
        decision_cost(F.col("business_decision"), defaulted, amount)
        - decision_cost(F.col("model_decision"), defaulted, amount)))


def shadow_compare(df: DataFrame) -> DataFrame:
    """Per pair of decisions: rows, defaults, observed default rate and saved cost."""
    return df.groupBy("business_decision", "model_decision").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.count_if("will_default").alias("defaults"),
        F.avg(F.col("will_default").cast("int")).alias("default_rate"),
        F.sum("opportunity_cost").alias("opportunity_cost"),
    ).withColumn("agreement", F.col("business_decision") == F.col("model_decision"))


def outcome_backfill(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Late outcomes to logged predictions; what has no outcome yet stays null."""
    joined = predictions.join(outcomes, "transaction_id", "left")
    return joined.withColumn(
        "days_to_resolution", F.datediff(F.col("resolved_at"), F.col("timestamp")))


def agreement_rate(df: DataFrame) -> DataFrame:
    same = (F.col("business_decision") == F.col("model_decision")).cast("int")
    return df.agg(ratio(F.sum(same), F.count(F.lit(1))).alias("agreement_rate"))
