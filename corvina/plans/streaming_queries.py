"""Streams run over all there is, whose results equal the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.registry import register
from corvina.session import table
from corvina.streaming import monitors


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return monitors.events(spark, d, table(spark, d, "events").schema, pattern="events.parquet")


@register("x02_windowed_counts", """SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = monitors.run_available(monitors.windowed_counts(_stream(spark, d)), "update", ("window_start", "event_type"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
