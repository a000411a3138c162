"""Message tables in, screened tables and event logs out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

ROLES = {"input": "user", "output": "assistant"}
CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def read_messages(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The turns of one stage; the role filter and the columns reach the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("role") == ROLES[stage]).select("conv_id", "turn", "text")


def stream_messages(spark: SparkSession, path: str, stage: str, schema: str = CONVERSATIONS) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path).filter(F.col("role") == ROLES[stage]).select("conv_id", "turn", "text")


def spread(messages: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the scan has fewer parts than there are cores, as with a file of one row group, which
    no scan can split. A table of many files is left as it is."""
    cores = messages.sparkSession.sparkContext.defaultParallelism
    return messages.repartition(cores) if messages.rdd.getNumPartitions() < cores else messages


def write_events(events: DataFrame, path: str, batch: int = 0) -> None:
    """Event rows of one batch, a folder per stage. Writing a batch again replaces its rows, so a retried batch is not
    doubled: the batch is part of the path, and only the folders that are written are replaced."""
    rows = events.withColumn("batch", F.lit(batch).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "stage").parquet(path)


def log_stream(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of event rows. A batch that is played again after a failure lands where it was."""

    def step(rows: DataFrame, batch: int) -> None:
        write_events(rows, path, batch)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
