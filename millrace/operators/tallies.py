"""Counts by stage, category and verdict that add up: partial tallies are stored, and only new rows are counted.

A tally holds for each cell the number of messages and a theta sketch of the distinct conversations (exact up to some 4,000,
about 1.6 % error beyond); two tallies merge by adding the counts and uniting the sketches, so that the counts of two
halves are those of the whole, and the distinct numbers agree within that error. Cells are bounded by the taxonomy,
whatever the number of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ("stage", "category", "verdict")


def tally(screened: DataFrame, who: str = "conv_id") -> DataFrame:
    """screened rows → (stage, category, verdict, n_messages, who_sketch); rows without a verdict are of the cell none, none,
    allowed. A null conversation is nobody."""
    cells = screened.select(F.coalesce("verdict_stage", F.lit("none")).alias("stage"), F.coalesce("category", F.lit("none")).alias("category"), F.coalesce("verdict", F.lit("allowed")).alias("verdict"), F.col(who).alias("who"))
    return cells.groupBy(*CELL).agg(F.count("*").alias("n_messages"), F.theta_sketch_agg("who").alias("who_sketch"))


def merged(*tallies: DataFrame) -> DataFrame:
    rows = reduce(DataFrame.unionByName, tallies)
    return rows.groupBy(*CELL).agg(F.sum("n_messages").alias("n_messages"), F.theta_union_agg("who_sketch").alias("who_sketch"))


def add_batch(new_rows: DataFrame, path: str, batch: int, who: str = "conv_id") -> None:
    """Store the tally of one batch of screened rows; a batch that is counted again replaces itself."""
    tally(new_rows, who).withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def totals(stored: DataFrame) -> DataFrame:
    """(stage, category, verdict, n_messages, n_conversations) over the stored batches, with all subtotals."""
    sums = stored.rollup(*CELL).agg(F.sum("n_messages").alias("n_messages"), F.theta_union_agg("who_sketch").alias("who_sketch"))
    return sums.select(*CELL, "n_messages", F.theta_sketch_estimate("who_sketch").alias("n_conversations"))
