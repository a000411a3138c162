"""Screening and telemetry over streams; the plans are those of the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.screen import screen_input, screen_output
from ..sources.messages import stream_messages
from ..sources.policy import Policy


def screen_stream(spark: SparkSession, path: str, stage: str, policy: Policy = Policy()) -> DataFrame:
    """A stream of screened messages; stateless, so any trigger and append mode do."""
    messages = stream_messages(spark, path, stage)
    return screen_input(messages, policy) if stage == "input" else screen_output(messages, policy)


def start_screening(screened: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write a screened stream as Parquet, once over what there is."""
    return screened.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def announced_once(events: DataFrame, keys: list[str], time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The first event of each key within the delay; state older than that is dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def refusal_windows(events: DataFrame, width: str = "1 hour", time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Refusals per tumbling window, stage and verdict; late rows count until the watermark passes."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), "stage", "verdict").agg(F.count("*").alias("n_events"))


def refusal_bursts(events: DataFrame, gap: str = "10 minutes", time: str = "ts", delay: str = "1 hour", by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Runs of refusals of a source without a pause of ``gap``: their start, end and size. A late row joins or bridges its
    neighbours until the watermark passes; a run is told once, when the watermark has passed its end."""
    return events.withWatermark(time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n_events")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")
