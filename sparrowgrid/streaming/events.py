"""Structured Streaming over the event log: an addition, the reference reads in batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream over Parquet files that land in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def weekly_counts(events: DataFrame, time: str = "ts", by: str = "event_type", late: str = "30 days") -> DataFrame:
    """Counts by ISO week (Monday to Monday) and type, with a watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = timed.groupBy(F.window(time, "7 days", startTime="4 days").alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("date").cast("string").alias("week"), by, "n")


def once_each(events: DataFrame, identity: list[str], time: str = "ts", late: str = "30 days") -> DataFrame:
    """Events without repeats of an identity inside the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(identity)


def sessions(events: DataFrame, user: str, time: str = "ts", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user: runs of events with no longer gap."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    found = timed.groupBy(user, F.session_window(time, gap).alias("s")).agg(F.count("*").alias("n"))
    return found.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there now and give the sink's rows; output and checkpoint lie in ``folder``."""
    spark, run = stream.sparkSession, f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{run}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{run}/out/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{run}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    # of a complete result only the last batch counts
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{run}/out")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(last)).drop("batch")
