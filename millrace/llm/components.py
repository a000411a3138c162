"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two groupings over the edges and ends in a table in the shared folder; nothing is collected but the
number of edges that changed. Each edge keeps its smaller end as the other's parent, so stars of any size need one row
per member and no task holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, shared_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b): link every neighbour (greater ones if ``large``, else the others) to the smallest neighbour."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(low, "a")
    if large:
        return joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    tied = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return tied.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), both of one type; ``root`` is the smallest node it reaches."""
    spark = edges.sparkSession
    schema = edges.select("a", "b").schema

    def keep(df: DataFrame) -> tuple[DataFrame, str]:
        path = shared_path(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(schema).parquet(path), path

    now, path = keep(edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        now, new_path = keep(_star(_star(now, True), False))
        drop_path(spark, path)
        path = new_path
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
