"""Customer features that follow a stream of payments.

Tasks first add up what each batch holds of a customer, so state is touched once per task and
customer. The state of a customer is a row of whole numbers: counts, sums, sums of squares, least and
greatest values, and payments per weekday. They add up in any order, so late and repeatedly restarted
input gives the same features as the batch operators. Customers are dealt to buckets, which hold the
rows of their customers as one array: a batch adds to all of them at once. A customer without payments
for ``idle`` is closed by the timer of the bucket and comes out a last time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lendlens.functions import calendar as cal
from lendlens.functions.numeric import half_even
from lendlens.operators.customer import MONTH_END_FROM, payment_timing

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMS = ["payments", "transactions", "timed", "days", "days_squared", "due", "early", "early_squared", "late", "dated", "weekend",
        "month_end", "holiday", "business", "hours", "hours_squared", *[f"weekday{d}" for d in range(7)]]
LEAST = ["days_min", "days_max_negated"]  # both taken as the smaller one
NUMBERS = [*SUMS, *LEAST]
NOTHING = np.iinfo(np.int64).max
UNKNOWN = np.iinfo(np.int64).min
# A customer in the state of a bucket; times in milliseconds, ``due`` is when a timer closes it.
HELD = ["customer_id", "latest", "due", *NUMBERS]
BUCKETS = 2048
PARTIAL = "customer_id long, at timestamp, " + ", ".join(f"{n} long" for n in NUMBERS)
UPDATE = f"{PARTIAL}, closed boolean"


def measured(rows: DataFrame) -> DataFrame:
    """One row of whole numbers per payment."""
    timed, ts = payment_timing(rows).where(F.col("customer_id").isNotNull()), F.col("transaction_date")
    days, early, hour = F.col("days_to_payment"), F.col("days_early_late"), F.hour(ts)

    def known(value: Column, of: Column) -> Column:
        return F.when(of.isNotNull(), value).otherwise(0)
    parts = {
        "payments": F.lit(1), "transactions": F.col("transaction_id").isNotNull(), "timed": days.isNotNull(), "days": known(days, days), "days_squared": known(days * days, days),
        "due": early.isNotNull(), "early": known(early, early), "early_squared": known(early * early, early), "late": F.col("is_late_payment"),
        "dated": ts.isNotNull(), "weekend": cal.is_weekend(ts), "month_end": cal.is_month_end(ts, MONTH_END_FROM),
        "holiday": cal.is_holiday_season(ts), "business": cal.is_business_hours(ts), "hours": known(hour, ts), "hours_squared": known(hour * hour, ts),
        **{f"weekday{d}": F.coalesce(F.weekday(ts) == d, F.lit(False)) for d in range(7)},
        "days_min": F.coalesce(days, F.lit(NOTHING)), "days_max_negated": F.coalesce(-days, F.lit(NOTHING))}
    return timed.select(F.col("customer_id").cast("long").alias("customer_id"), ts.alias("at"),
                        *[F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(n) for n, c in parts.items()])


def per_customer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the payments of each customer in a batch of rows."""
    for batch in batches:
        if batch.num_rows:
            frame = pa.Table.from_batches([batch]).to_pandas()
            grouped = frame.groupby("customer_id", sort=False)
            found = pd.concat([grouped["at"].max(), grouped[SUMS].sum(), grouped[LEAST].min()], axis=1).reset_index()
            yield pa.RecordBatch.from_pandas(found, schema=batch.schema, preserve_index=False)


def added(*parts: np.ndarray) -> np.ndarray:
    """Rows of ``HELD``, one per customer: the latest time, sums and least values of all parts."""
    rows = np.concatenate(parts)
    rows = rows[np.argsort(rows[:, 0], kind="stable")]
    start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0])) if len(rows) else np.zeros(0, np.int64)
    if not len(start):
        return rows
    least = len(HELD) - len(LEAST)
    return np.concatenate([rows[start, :1], np.maximum.reduceat(rows[:, 1:3], start), np.add.reduceat(rows[:, 3:least], start),
                           np.minimum.reduceat(rows[:, least:], start)], axis=1)


def arrived(frame: pd.DataFrame) -> np.ndarray:
    """The payments of a batch as rows of ``HELD``, with no time of closing yet."""
    at = frame["at"].to_numpy("datetime64[ms]").astype(np.int64)  # NaT is UNKNOWN
    return np.column_stack([frame["customer_id"].to_numpy(np.int64), at, np.full(len(frame), UNKNOWN), frame[NUMBERS].to_numpy(np.int64)])


def customer_states(rows: DataFrame, idle: str = "365 days", delay: str = "30 days", buckets: int = BUCKETS) -> DataFrame:
    """The state of every customer that a batch touches or a timer closes; ``rows`` is a stream of payments.

    Rows more than ``delay`` behind the latest are too late and left out, as in other stateful jobs.
    Customers share ``buckets`` states, which must stay as many as long as a checkpoint is used.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = np.frombuffer(state.get[0], np.int64).reshape(-1, len(HELD)) if state.exists else np.zeros((0, len(HELD)), np.int64)
        now = state.getCurrentWatermarkMs()
        come = added(*[arrived(f) for f in ([] if state.hasTimedOut else frames)], np.zeros((0, len(HELD)), np.int64))
        here = np.isin(held[:, 0], come[:, 0])
        touched, others = added(held[here], come), held[~here]
        touched[:, 2] = np.where(touched[:, 1] == UNKNOWN, UNKNOWN, np.maximum(touched[:, 1], now) + wait)
        over = (others[:, 2] != UNKNOWN) & (others[:, 2] < now)
        left = np.concatenate([others[~over], touched])
        timers = left[left[:, 2] != UNKNOWN, 2]
        if not len(left):
            state.remove()
        else:
            state.update((left.tobytes(),))
            if len(timers):
                state.setTimeoutTimestamp(int(timers.min()))
        yield as_frame(np.concatenate([touched, others[over]]), np.repeat([False, True], [len(touched), over.sum()]))

    def as_frame(states: np.ndarray, closed: np.ndarray) -> pd.DataFrame:
        frame = pd.DataFrame(states[:, 3:], columns=NUMBERS)
        frame.insert(0, "at", states[:, 1].astype("datetime64[ms]").astype("datetime64[ns]"))
        frame.insert(0, "customer_id", states[:, 0])
        return frame.assign(closed=closed)
    partial = measured(rows).mapInArrow(per_customer, PARTIAL).withWatermark("at", delay)
    bucket = F.pmod(F.xxhash64("customer_id"), F.lit(buckets))
    return partial.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(
        update, UPDATE, "customers binary", "update", GroupStateTimeout.EventTimeTimeout)


def write_states(states: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Every batch into a folder of its own, written anew if the batch is replayed."""
    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return states.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def latest_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each customer; of closed customers who came back, what has come since."""
    rows = spark.read.schema(f"{UPDATE}, batch long").parquet(f"{folder}/batch=*")
    fields = [n for n in rows.columns if n not in ("customer_id", "batch")]
    # In one batch a timer closes before it can open again, so the open state counts.
    order = F.struct(F.col("batch"), ~F.col("closed"))
    return rows.groupBy("customer_id").agg(F.max_by(F.struct(*fields), order).alias("s")).select("customer_id", "s.*")


def deviation(n: str, total: str, squared: str) -> Column:
    """Sample deviation from whole numbers; null for one value."""
    spread = F.col(squared) - F.col(total) * F.col(total) / F.col(n)
    return F.when(F.col(n) > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (F.col(n) - 1)))


def features_of(states: DataFrame) -> DataFrame:
    """The velocity and temporal features of the batch operators, from states."""
    share = lambda c, n: F.try_divide(F.col(c).cast("double"), F.col(n))
    days_std = deviation("timed", "days", "days_squared")
    best = F.greatest(*[F.col(f"weekday{d}") for d in range(7)])
    usual = F.coalesce(*[F.when((F.col(f"weekday{d}") == best) & (best > 0), d) for d in range(7)], F.lit(0))
    return states.select(
        "customer_id", F.col("transactions").alias("velocity_transaction_id_count"),
        share("days", "timed").alias("velocity_days_to_payment_mean"), days_std.alias("velocity_days_to_payment_std"),
        F.when(F.col("timed") > 0, F.col("days_min")).cast("int").alias("velocity_days_to_payment_min"),
        F.when(F.col("timed") > 0, -F.col("days_max_negated")).cast("int").alias("velocity_days_to_payment_max"),
        share("early", "due").alias("velocity_days_early_late_mean"), deviation("due", "early", "early_squared").alias("velocity_days_early_late_std"),
        F.col("late").alias("velocity_is_late_payment_sum"),
        half_even(F.lit(1.0) / (F.lit(1.0) + F.coalesce(days_std, F.lit(0.0))), 3).alias("velocity_payment_consistency"),
        half_even(F.coalesce(share("late", "transactions"), F.lit(0.0)), 3).alias("velocity_late_payment_rate"),
        *[half_even(share(c, "payments"), 3).alias(f"temporal_{n}_mean") for c, n in (
            ("weekend", "is_weekend"), ("month_end", "is_month_end"), ("holiday", "is_holiday_season"), ("business", "is_business_hours"))],
        half_even(share("hours", "dated"), 3).alias("temporal_hour_mean"),
        half_even(deviation("dated", "hours", "hours_squared"), 3).alias("temporal_hour_std"),
        usual.cast("int").alias("temporal_day_of_week_mode"))
