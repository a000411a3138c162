"""Ordered scans over range partitions: row numbers, the value before, the last known value, over a whole table at once.

A window without partition columns runs in one task, and one by a key runs a hot key in one task. Here rows are dealt by
ranges of (key, order), so a key with a third of all rows lies in several partitions; windows run inside a partition, and
what a partition has to know of those before it, the last row of a key that goes on, is carried in a table of borders: one
row per partition, of bounded size, which is the only thing the driver sees.

Rows travel twice, once into ranges (written to the shared folder, so that a lost executor does not deal them anew) and once
by partition number; scan narrow rows and join wide ones afterwards, and store rows that are costly to make, as finding the
ranges reads them once more. Order columns have to order the rows of a key fully:
rows that tie stand in any order. Nulls come first, as keys and in the order. Empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import shared_folder


def _tasks(frame: DataFrame) -> int:
    return int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _borders(local: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, known: str) -> DataFrame:
    """(_part, first key, last key, and of the last key its rows, last value and last known value in the partition)."""
    place = F.struct(*order)
    keys = local.groupBy("_part", *by).agg(
        F.count("*").alias("n"), F.max_by(F.struct(F.col(value).alias("v")), place).alias("value"), F.max_by(F.struct(F.col(known).alias("v")), F.when(F.col(known).isNotNull(), place)).alias("known"), F.max(place).alias("end"),
    )
    key = F.struct(F.lit(0).alias("_"), *by)
    ends = F.max_by(F.struct("n", "value", "known"), key)
    return keys.groupBy("_part").agg(F.min(key).alias("first"), F.max(key).alias("last"), ends.alias("own"))


def _carried(borders: DataFrame, by: tuple[str, ...], schema: StructType) -> DataFrame:
    """(_part, key, rows, last value, last known value) of the key that each partition goes on with."""
    rows, carry = [], None
    for b in sorted(borders.collect(), key=lambda r: r["_part"]):
        first, last, own = tuple(b["first"])[1:], tuple(b["last"])[1:], b["own"]
        if carry is not None and carry[0] == first:
            rows.append((b["_part"], *carry[0], carry[1], carry[2], carry[3]))
        known = own["known"]["v"] if own["known"] is not None else None
        if carry is not None and carry[0] == last:
            carry = (last, carry[1] + own["n"], own["value"]["v"], known if known is not None else carry[3])
        else:
            carry = (last, own["n"], own["value"]["v"], known)
    return borders.sparkSession.createDataFrame(rows, schema)


def scanned(frame: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = (), value: str | None = None, known: str | None = None, tasks: int | None = None) -> DataFrame:
    """Adds ``n`` (the row's number in its key, from 1), ``before`` (``value`` in the row before, null in the first) and
    ``last_known`` (the latest ``known`` that is not null, this row's included)."""
    spark = frame.sparkSession
    value, known = value or order[0], known or order[0]
    path = shared_folder(spark, "scan")
    dealt = frame.repartitionByRange(tasks or _tasks(frame), *[F.col(c).asc_nulls_first() for c in (*by, *order)])
    dealt.withColumn("_part", F.spark_partition_id().cast("long")).write.parquet(path)
    rows = spark.read.schema(StructType([*frame.schema.fields, StructField("_part", LongType())])).parquet(path)
    inside = Window.partitionBy("_part", *by).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.row_number().over(inside).cast("long").alias("_n"), F.lag(value).over(inside).alias("_before"), F.last(known, ignorenulls=True).over(so_far).alias("_known"))
    kind = {f.name: f.dataType for f in frame.schema.fields}
    schema = StructType([StructField("_p", LongType()), *[StructField(f"_k{i}", kind[c]) for i, c in enumerate(by)], StructField("_rows", LongType()), StructField("_value", kind[value]), StructField("_last", kind[known])])
    # at most a row per partition
    carried = F.broadcast(_carried(_borders(rows, by, order, value, known), by, schema))
    same = reduce(lambda a, b: a & b, [local[c].eqNullSafe(carried[f"_k{i}"]) for i, c in enumerate(by)], local["_part"] == carried["_p"])
    return local.join(carried, same, "left").select(
        *[local[c] for c in frame.columns],
        (F.col("_n") + F.coalesce("_rows", F.lit(0))).alias("n"),
        F.when(F.col("_n") == 1, F.col("_value")).otherwise(F.col("_before")).alias("before"),
        F.coalesce("_known", "_last").alias("last_known"),
    )


def as_of(rows: DataFrame, versions: DataFrame, order: tuple[str, ...], version: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with the latest ``version`` that was in force at each: the last of ``versions`` (by, order, version) that
    does not come after the row. Rows before any version get null.

    Both sides are merged into one ordered scan; no row meets any other, and a version that holds for a third of all rows
    costs no more than one that holds for a few.
    """
    own = rows.withColumn("_is_row", F.lit(1)).withColumn(version, F.lit(None).cast(versions.schema[version].dataType))
    theirs = versions.select(*[F.col(c) if c in versions.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns], F.lit(0).alias("_is_row"), version)
    merged = scanned(own.unionByName(theirs), (*order, "_is_row"), by, known=version)
    return merged.filter("_is_row = 1").select(*rows.columns, F.col("last_known").alias(version))


def differs(scan: DataFrame, value: str) -> Column:
    """Whether a row's value differs from the one before; the first row's does."""
    return (scan["n"] == 1) | ~scan[value].eqNullSafe(scan["before"])
