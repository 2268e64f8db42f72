"""Structured Streaming forms of the monitoring jobs. Each takes a streaming DataFrame with an event
time column ts (timestamp) and returns one; sinks and triggers are the caller's."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvina.operators import analytics
from corvina.session import scratch_folder


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16, pattern: str = "*.parquet") -> DataFrame:
    """A file-source stream of events with a proper event time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and value sums (in hundredths) by event type and window."""
    cents = F.round(F.col("value") * 100).cast("long")
    grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum(cents).alias("cents")).select(F.col("window.start").alias("window_start"), "event_type", "n", "cents")


def session_windows(stream: DataFrame, key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end ``gap`` after their last event."""
    grouped = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key)
    return grouped.agg(F.count("*").alias("n_interactions")).select(key, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("expires_at"), "n_interactions")


def alerts(stream: DataFrame, confidence, response_time) -> DataFrame:
    """Stateless quality alerts, a row for each."""
    return analytics.quality_alerts(stream, confidence, response_time)


def first_alerts(alert_rows: DataFrame, active_minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """One row when a (component, metric) becomes active; later alerts of an active key only update
    it. A key is resolved by being quiet for ``active_minutes`` of event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        active = state.exists
        last = rows["ts"].iloc[-1]
        raised = (state.get[0] if active else 0) + len(rows)
        state.update((raised,))
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + active_minutes * 60_000)
        if not active:
            yield pd.DataFrame({"component": [key[0]], "metric": [key[1]], "first_at": [rows["ts"].iloc[0]], "severity": [rows["severity"].iloc[0]]})

    keyed = alert_rows.withWatermark("ts", late).groupBy("component", "metric")
    return keyed.applyInPandasWithState(step, "component string, metric string, first_at timestamp, severity string", "n_raised long", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, mode: str = "append", keys: tuple[str, ...] = (), folder: str | None = None) -> DataFrame:
    """Runs a stream over all there is and returns what it gave, for tests and backfills.

    Each micro-batch is written as Parquet under its number in a folder that the cluster shares, so that
    one that is run again replaces what it wrote. With mode update, the last row of each of ``keys`` counts."""
    spark = stream.sparkSession
    folder = folder or scratch_folder(spark, "stream")

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True)
    writer.option("checkpointLocation", f"{folder}/checkpoint").start().awaitTermination()
    found = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema.fields)}, batch long").parquet(f"{folder}/rows")
    if mode == "update":
        rest = F.struct(*[c for c in stream.columns if c not in keys])
        found = found.groupBy(*keys).agg(F.max_by(rest, "batch").alias("_r")).select(*keys, "_r.*")
    return found.select(*stream.columns)
