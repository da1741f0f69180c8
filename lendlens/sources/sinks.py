"""Writing feature tables and the shadow-scoring log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lendlens.operators.score import decision_cost
from lendlens.session import materialize

# The columns of the log, in order, with their types.
SHADOW_LOG = {
    "transaction_id": "string",
    "timestamp": "timestamp",
    "business_decision": "string",
    "business_risk_score": "double",
    "ridge_prediction": "double",
    "logistic_prediction": "double",
    "elastic_prediction": "double",
    "ensemble_prediction": "double",
    "consensus_prediction": "double",
    "actual_default": "boolean",
    "days_to_resolution": "int",
    "opportunity_cost": "double",
}


def write_features(df: DataFrame, folder: str, partition_by: Sequence[str] = (),
                   mode: str = "errorifexists") -> DataFrame:
    """Parquet table of features, read back."""
    writer = df.write.mode(mode)
    if partition_by:
        # Rebalancing splits a large partition value over as many writers as its size asks for.
        writer = df.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by)
    writer.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def as_shadow_log(df: DataFrame) -> DataFrame:
    """The log columns with their types; what is not known yet is null."""
    return df.select([
        (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
        for c, kind in SHADOW_LOG.items()
    ])


def append_shadow_log(df: DataFrame, folder: str) -> DataFrame:
    as_shadow_log(df).write.mode("append").parquet(folder)
    return read_shadow_log(df.sparkSession, folder)


def read_shadow_log(spark, folder: str) -> DataFrame:
    schema = ", ".join(f"{c} {kind}" for c, kind in SHADOW_LOG.items())
    return spark.read.schema(schema).parquet(folder)


class ShadowLog:
    """The log in partitions of days (or other periods), safe against replays, filled in when outcomes are known.

    A transaction stands in it once: rows of an id that is there already are not added. Outcomes
    rewrite only the partitions they belong to; the first known outcome of a transaction stays.
    ``period`` is day, week, month or year: one that holds enough rows for a file.
    """

    def __init__(self, spark: SparkSession, folder: str, period: str = "day") -> None:
        self.spark, self.folder, self.period = spark, folder, period

    def _stored(self) -> DataFrame:
        schema = ", ".join([*(f"{c} {kind}" for c, kind in SHADOW_LOG.items()), "period date"])
        return self.spark.read.schema(schema).parquet(self.folder)

    def _exists(self) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        if not self._exists():
            return self.spark.createDataFrame([], ", ".join(f"{c} {kind}" for c, kind in SHADOW_LOG.items()))
        return self._stored().drop("period")

    def append(self, rows: DataFrame) -> None:
        """Adds the transactions that are not in the log; a replayed batch adds nothing.

        A row's time follows from its transaction, so only the partitions of the batch are looked at. Of
        several rows of one transaction the earliest is kept.
        """
        order = F.struct(F.col("timestamp"), F.xxhash64(*SHADOW_LOG))
        batch = as_shadow_log(rows).groupBy("transaction_id").agg(F.min_by(F.struct(*SHADOW_LOG), order).alias("row")).select("row.*")
        batch = materialize(batch.withColumn("period", F.date_trunc(self.period, "timestamp").cast("date")), "log-batch")
        periods = [r["period"] for r in batch.select("period").distinct().collect()]
        if not periods:
            return
        if self._exists():
            known = self._stored().where(in_periods(periods)).select("transaction_id")
            batch = materialize(batch.join(known, "transaction_id", "left_anti"), "log-new")
        batch.hint("rebalance", "period").write.mode("append").partitionBy("period").parquet(self.folder)

    def resolve(self, outcomes: DataFrame, cut: float = 0.15, score: str = "ridge_prediction") -> int:
        """Fills in outcomes (transaction_id, actual_default, resolved_at, amount); returns the rows filled.

        The opportunity cost is that of the rules' decision less that of deciding by ``score``. Partitions
        are written anew as a whole from a copy, so an interrupted update can be repeated.
        """
        if not self._exists():
            return 0
        first = outcomes.groupBy(F.col("transaction_id").cast("string").alias("transaction_id")).agg(
            F.min_by(F.struct("actual_default", "resolved_at", "amount"), F.struct("resolved_at", "actual_default", "amount")).alias("found"))
        first = materialize(first.where(F.col("found.actual_default").isNotNull()), "outcomes")
        open_ = self._stored().where(F.col("actual_default").isNull()).join(first, "transaction_id")
        counted = open_.groupBy("period").agg(F.count(F.lit(1)).alias("n")).collect()
        if not counted:
            return 0
        model = F.when(F.col(score) >= cut, "decline").otherwise("approve")
        defaulted, amount = F.col("found.actual_default"), F.col("found.amount")
        cost = decision_cost(F.col("business_decision"), defaulted, amount) - decision_cost(model, defaulted, amount)
        new = {"actual_default": defaulted, "days_to_resolution": F.datediff(F.col("found.resolved_at"), F.col("timestamp")), "opportunity_cost": cost}
        fill = F.col("actual_default").isNull() & F.col("found").isNotNull()
        touched = self._stored().where(in_periods([r["period"] for r in counted])).join(first, "transaction_id", "left").select(
            *[(F.when(fill, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).cast(kind).alias(c) for c, kind in SHADOW_LOG.items()], "period")
        staged = materialize(touched, "log-periods")
        staged.hint("rebalance", "period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(self.folder)
        return sum(r["n"] for r in counted)


def in_periods(periods: Sequence) -> Column:
    """A condition that prunes partitions; a row's time may be unknown."""
    known = [p for p in periods if p is not None]
    found = F.col("period").isin(known) if known else F.lit(False)
    return found | F.col("period").isNull() if len(known) < len(periods) else found
