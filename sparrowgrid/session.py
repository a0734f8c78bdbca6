"""Session factory and table reader."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[1])


def get_session(app: str = "sparrowgrid", cores: str = "*", partitions: int = 8, **more: str) -> SparkSession:
    """A local session with the settings the queries assume: UTC and adaptive execution."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def share_code(spark: SparkSession) -> None:
    """Let Python workers find this package in local mode; on a cluster it is shipped (--py-files) and the path does no harm."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, by Spark's own reader."""
    share_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def read_spread(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table for heavy work on every row: one that comes in fewer pieces than there are cores is dealt out first; a large one is left as it lies."""
    rows = read(spark, sf_dir, table)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
