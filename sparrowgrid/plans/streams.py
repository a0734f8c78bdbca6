"""Streaming queries over the event table, run to the end of what is there."""

from pyspark.sql import functions as F

from sparrowgrid.operators.tables import shared_dir
from sparrowgrid.plans.registry import query
from sparrowgrid.streaming import events as V


def _stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")


@query("stream_weekly_counts", "SELECT CAST(date_trunc('week', ts) AS DATE)::VARCHAR AS week, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_weekly_counts(spark, sf_dir):
    """Weekly counts by a stream with a watermark, complete mode."""
    return V.drain(V.weekly_counts(_stream(spark, sf_dir)), shared_dir(spark), "complete")


@query("stream_dedupe_watermark", "SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events) GROUP BY 1, 2")
def stream_dedupe_watermark(spark, sf_dir):
    """Events once a user, type and day, by a stream's state."""
    rows = _stream(spark, sf_dir).withColumn("day", F.col("ts").cast("date").cast("string"))
    once = V.drain(V.once_each(rows, ["user_id", "event_type", "day"]).select("user_id", "event_type", "day"), shared_dir(spark))
    return once.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "session_counts",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events)
       SELECT user_id, CAST(sum(fresh) AS BIGINT) AS sessions, count(*) AS n FROM g GROUP BY 1""",
)
def session_counts(spark, sf_dir):
    """Sessions of each user in batch: the same function a stream uses."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    found = V.sessions(rows, "user_id", gap="12 hours")
    return found.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))
