"""Structured Streaming jobs: features, shadow scoring, daily rates and outcome join.

Every job reads and writes files with a checkpoint, so a restart continues where the
last finished batch ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lendlens.operators.clean import FeaturePipeline
from lendlens.operators.score import LinearModel, shadow_score
from lendlens.operators.underwriting import rule_decision
from lendlens.sources.sinks import as_shadow_log
from lendlens.sources.tables import normalize_timestamps


def read_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return normalize_timestamps(reader.parquet(folder))


def write_stream(df: DataFrame, folder: str, checkpoint: str, mode: str = "append",
                 once: bool = True) -> StreamingQuery:
    """Appends to a parquet folder; ``once`` works off what is there and stops."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(folder)


def stream_features(rows: DataFrame, pipeline: FeaturePipeline, keep: Sequence[str] = ()) -> DataFrame:
    """The fitted row transform; stateless, so the same as in batch."""
    return pipeline.transform(rows, keep)


def stream_shadow_score(rows: DataFrame, pipeline: FeaturePipeline, models: Sequence[LinearModel],
                        champion: str) -> DataFrame:
    """Scores every arriving row and shapes it for the log; outcomes are filled in later."""
    kept = rows.withColumns({
        "timestamp": F.col("transaction_timestamp"), "business_decision": rule_decision(),
        "business_risk_score": F.col("risk_score"),
    })
    keep = ["transaction_id", "timestamp", "business_decision", "business_risk_score"]
    return as_shadow_log(shadow_score(pipeline.transform(kept, keep), models, champion))


def stream_kpi_window(events: DataFrame, timestamp: str = "ts", key: str = "event_type",
                      value: str = "value", period: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts and means per period and key; a period is final once the watermark has passed it."""
    return (
        events.withWatermark(timestamp, delay)
        .groupBy(F.window(timestamp, period), key)
        .agg(F.count(F.lit(1)).alias("events"), F.avg(value).alias("mean_value"),
             F.avg((F.col(value) > 0).cast("int")).alias("positive_rate"))
        .select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"),
                key, "events", "mean_value", "positive_rate")
    )


def stream_outcome_join(predictions: DataFrame, outcomes: DataFrame, max_delay: str = "90 days",
                        lateness: str = "1 day") -> DataFrame:
    """Predictions with their outcome, if one arrives within ``max_delay``.

    Both watermarks and the time bound let Spark drop state; a prediction without an
    outcome comes out when the watermark has passed its last chance.
    """
    left = predictions.withWatermark("timestamp", lateness).alias("p")
    right = outcomes.withWatermark("resolved_at", lateness).alias("o")
    condition = F.expr(
        "p.transaction_id = o.transaction_id AND o.resolved_at >= p.timestamp "
        f"AND o.resolved_at <= p.timestamp + INTERVAL {max_delay}")
    return left.join(right, condition, "leftOuter").select(
        "p.*", F.col("o.actual_default").alias("actual_default"),
        F.datediff(F.col("o.resolved_at"), F.col("p.timestamp")).alias("days_to_resolution"))
