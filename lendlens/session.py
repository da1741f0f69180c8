"""Session set-up and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


# Runtime settings that are used unless the session sets its own.
DEFAULTS = {
    # Keeps the grouping by customer in memory; beyond it Spark sorts and spills.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "20000",
}


def with_defaults(spark: SparkSession) -> SparkSession:
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def build_session(app: str = "lendlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return with_defaults(builder.getOrCreate())


_own_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if spark.sparkContext.applicationId not in _own_folders:
        folder = tempfile.mkdtemp(prefix="lendlens-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folders[spark.sparkContext.applicationId] = folder
    return _own_folders[spark.sparkContext.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    return os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, label: str = "table") -> DataFrame:
    """Write once and read back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    folder = new_folder(spark, label)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def sized_table(df: DataFrame) -> DataFrame:
    """An aggregate that is usually small, written so that joins are chosen by its real size."""
    return materialize(df, "sized")


def with_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate as literals."""
    row = scalars.first()
    return df.withColumns({
        f.name: F.lit(row[f.name]).cast(f.dataType) for f in scalars.schema.fields
    })
